"""Near-duplicate listings: the first earlier listing that matches gives a listing its root.

Candidates share type and municipio and lie in the 3 x 3 cells around; the join is an equi-join on (type, municipio,
cell), with differences, fingerprints and distance as residuals. Of all matches a window keeps the first in cell order,
then by date and id. Roots follow by pointer doubling, each round cut in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import floor_div, haversine
from ..functions.text import hamming, simhash64
from ..schema import CELL_DEGREES, HAMMING_MOST, M2_MOST, METRES_MOST
from ..sources.store import cut, ship


def parents(rows: DataFrame, hashed: bool = True) -> DataFrame:
    """(id, parent) of rows with an earlier match. rows: id, description, lat, lng, m2, type, municipio, listed_date."""
    ship(rows.sparkSession)
    base = rows.select(
        "id", "lat", "lng", "m2", "type", "municipio", "listed_date",
        (simhash64(F.coalesce("description", F.lit(""))) if hashed else F.col("simhash")).alias("simhash"),
        floor_div(F.col("lat"), CELL_DEGREES).alias("x"), floor_div(F.col("lng"), CELL_DEGREES).alias("y"),
    )
    base = cut(base)  # fingerprints are made once, not on both sides of the join
    around = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(i.alias("order"), (F.col("x") + F.floor(i / 3) - 1).alias("x"), (F.col("y") + i % 3 - 1).alias("y")))
    later = base.withColumn("near", F.explode(around)).alias("a")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    match = (
        (a("type") == b("type")) & (a("municipio") == b("municipio")) & (a("near.x") == b("x")) & (a("near.y") == b("y"))
        & (F.struct(b("listed_date"), b("id")) < F.struct(a("listed_date"), a("id")))
        & (F.abs(a("m2") - b("m2")) <= M2_MOST)
        & (hamming(a("simhash"), b("simhash")) <= HAMMING_MOST)
        & (haversine(a("lat"), a("lng"), b("lat"), b("lng")) <= METRES_MOST)
    )
    pairs = later.join(base.alias("b"), match).select(a("id").alias("id"), F.struct(a("near.order").alias("o"), b("listed_date").alias("d"), b("id").alias("id")).alias("hit"))
    return pairs.groupBy("id").agg(F.min("hit").alias("hit")).select("id", F.col("hit.id").alias("parent"))


def roots(parent_of: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, dup_of): the end of each chain of parents; a round doubles the reach."""
    now = cut(parent_of.select("id", F.col("parent").alias("dup_of")))
    for _ in range(rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.dup_of") == F.col("b.id"), "left").select(F.col("a.id").alias("id"), F.coalesce("b.dup_of", "a.dup_of").alias("dup_of"), F.col("b.id").isNotNull().alias("moved"))
        step = cut(step)
        now = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return now
    raise RuntimeError("chains of parents are too long")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """rows with dup_of, null where a row is an original."""
    return rows.drop("dup_of").join(roots(parents(rows)), "id", "left")


def duplicate_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("dup_of").alias("duplicates"), F.try_divide(F.count("dup_of").cast("double"), F.count(F.lit(1))).alias("rate"))
