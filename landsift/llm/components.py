"""Connected components by alternating large-star and small-star steps over DataFrames: each step is an aggregation and
a join, edges stay linear in number, and nothing is collected. Lineage is cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, fits, remove, sent


def _star(edges: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """edges (a, b), a < b. large: every neighbour above u is tied to the least of u and its neighbours; small: every
    neighbour below u, and u, are tied to it. few: their ends may be broadcast. A large step makes no more edges than it
    gets, and some of them twice."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(sent(least, few), "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = tied.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    out = out.filter(F.col("a") < F.col("b"))
    return out if large else out.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b), a < b, are stars: each b has one a and is no a itself."""
    ends = edges.select(F.col("b").alias("u"), F.lit(1).alias("below")).unionByName(edges.select(F.col("a").alias("u"), F.lit(0).alias("below")))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.min("below").alias("least")).filter("below > 1 or (below = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 50, few: bool = False) -> DataFrame:
    """(id, root): the least id of each id's component, for the ids that edges (a, b) name; a table of `cut`. Null ends
    make no edge; an edge may repeat or be a loop (a loop alone names no id); no edges give an empty table. More than
    `rounds` rounds raise an error. few: the edges are known to be small."""
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct(), few)
    for _ in range(rounds):
        if _settled(now):
            break
        few = fits(now)
        last, now = now, cut(_star(_star(now, True, few), False, few), few)
        remove(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = cut(now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()), fits(now))
    remove(now)
    return out
