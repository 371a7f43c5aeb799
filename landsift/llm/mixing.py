"""Mixing sources to target weights, DataFrame functions only.

Token counts are summed to cells (source, language, topic). The budget, a share of all tokens, is dealt to the values of
each dimension by their target shares; a value that has fewer tokens than that gives all it has, and the others of its
dimension share the rest in proportion to their targets. Iterative proportional fitting then rakes the cells' wanted
tokens until every marginal has what it was dealt, under the bound that no cell gives more than it has: a cell that
would, or whose value gives all it has, is held at its tokens, and the others are raked again. A document's probability is its cell's wanted over its
available tokens, and it stays if a hash of its id falls below that: the choice is the same on every run and after a
lost executor. `marginals` says what each value was meant to get, was dealt and reaches, and whether its target is met,
short of tokens, or barred by the other dimensions; if the sweeps end, or get no nearer, without a fit there is a warning as well.

Targets are given per dimension as shares by value; values that are not named share what is left in proportion to
their tokens. A dimension without targets is tempered: shares in proportion to tokens ** temperature. With the budget
None, the largest is taken that saturates no cell, so that all marginals are met exactly in expectation, however little
that may leave.

All sums are aggregations that combine within tasks first, and factors come back to the cells by a join, so neither a
language nor a source meets in one task. Topics come from a column or expression; by default they are the form of the
text (figures, list, long, short, prose).

Defined cases: null texts count as empty with one token, null categories as ''; rows with null ids are chosen by their
text's hash; repeated rows share one fate; targets for absent values are left out and the rest scaled; an empty table
gives an empty result; other columns, whatever their names, are kept by `mixed` and not read by `probabilities`.
"""

from __future__ import annotations

import warnings
from functools import reduce
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, remove

DIMS = ("source", "lang", "topic")
SMALL = 20_000  # rows up to which a table of cells or values is broadcast; more are joined by shuffle


def token_count(text: Column) -> Column:
    """Runs of characters that are not white space, 1 at least."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)).cast("long")


def form(text: Column, n_tokens: Column) -> Column:
    """The form of a text: the default topic."""
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (
        F.when(digits > 0.02 * F.length(text), "figures")
        .when(lines > 0.1 * n_tokens, "list")
        .when(n_tokens >= 1000, "long")
        .when(n_tokens < 50, "short")
        .otherwise("prose")
    )


def described(df: DataFrame, id_col: str, text: str, source: str, lang: str, topic: Column | None) -> tuple[DataFrame, str]:
    """df with a struct column that its name (which df hasn't) is returned of: u (uniform from the id's hash), n (tokens)
    and the three dimensions."""
    name = "_mix"
    while name in df.columns:
        name += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("mix"), t)).otherwise(F.xxhash64(F.lit("mix"), F.col(id_col)))
    df, n = df.withColumn(name, token_count(t)), F.col(name)  # a column of its own, so that it is counted once
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (source, lang)]
    form_ = F.coalesce(topic if topic is not None else form(t, n), F.lit(""))
    return df.withColumn(name, F.struct((F.shiftrightunsigned(key, 11) / float(1 << 53)).alias("u"), n.alias("n"), *[c.alias(d) for d, c in zip(DIMS, (*own, form_), strict=True)])), name


def goals(cells: DataFrame, given: dict[str, dict[str, float]], temperature: float, budget: float | None) -> DataFrame:
    """(dim, value, tokens, share, want): shares that sum to 1 over the values of a dimension that occur, and what the
    budget deals them; without a budget want is the share."""
    by = reduce(DataFrame.unionByName, [cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")) for d in DIMS])
    named = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("value") == k), F.lit(float(v))) for d in DIMS for k, v in (given.get(d) or {}).items()], F.lit(None).cast("double"))
    by = by.withColumn("named", named)
    sums = by.groupBy("dim").agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("taken"), F.sum(F.when(F.col("named").isNull(), F.col("tokens"))).alias("others"))
    left = F.greatest(F.lit(1.0) - F.col("taken"), F.lit(0.0)) * F.col("tokens") / F.col("others")
    raw = F.when(F.col("dim").isin(*[d for d in DIMS if given.get(d)]), F.coalesce("named", left)).otherwise(F.pow("tokens", F.lit(temperature)))
    by = by.join(F.broadcast(sums), "dim").select("dim", "value", "tokens", raw.alias("raw"))
    held = cut(by.join(F.broadcast(by.groupBy("dim").agg(F.sum("raw").alias("all"))), "dim").select("dim", "value", "tokens", (F.col("raw") / F.col("all")).alias("share")))
    if budget is None:
        return held.withColumn("want", F.col("share"))
    scale = dict.fromkeys(DIMS, budget)
    for _ in range(60):
        scaled = F.col("share") * reduce(lambda c, d: c.when(F.col("dim") == d, F.lit(scale[d])), DIMS, F.when(F.lit(False), F.lit(0.0)))
        full = scaled >= F.col("tokens")
        last, rows = dict(scale), held.groupBy("dim").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).collect()
        for d, taken, free in rows:
            if free > 0:
                scale[d] = (budget - taken) / free
        if all(scale[d] <= last[d] * (1 + 1e-12) for d in DIMS):
            break
    return held.withColumn("want", F.least("tokens", scaled))


def _off(now: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with reached: the tokens that the cells now give each value."""
    got = reduce(DataFrame.unionByName, [now.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("p")).alias("reached")) for d in DIMS])
    return goal.join(got, ["dim", "value"])


def fitted(cells: DataFrame, goal: DataFrame, values: dict[str, int], number: int, total: float, bounded: bool, tolerance: float, sweeps: int) -> tuple[DataFrame, float]:
    """cells with p, wanted over available tokens, and the largest miss of a marginal as a share of total. A cell's p is
    the product of its values' factors, 1 at most if bounded (else it may exceed 1); a step fits one dimension's factors.
    What a value gives whole isn't raked. Up to SMALL cells are one partition, in which a value's sums are windows: a
    sweep is then one task without exchange or broadcast, as each of these costs the driver memory and threads, however
    few the rows. More cells are summed by value and joined to that."""
    few = number <= SMALL

    def small(d: str, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if values[d] <= SMALL else table

    def summed(now: DataFrame, d: str, **parts: Column) -> DataFrame:
        """now with the sums of parts over the cells of each value of d."""
        if few:
            return now.withColumns({k: F.sum(part).over(Window.partitionBy(d)) for k, part in parts.items()})
        return now.join(small(d, now.groupBy(d).agg(*[F.sum(part).alias(k) for k, part in parts.items()])), d)

    def p(now: DataFrame) -> DataFrame:
        return now.withColumn("p", F.when(F.col("whole"), 1.0).otherwise(F.least(F.col("f"), F.lit(1.0)) if bounded else F.col("f")))

    def together(now: DataFrame) -> DataFrame:
        """now, in one partition if few: also what is read back has to be told so."""
        return now.coalesce(1) if few else now

    base = cells.withColumns({"whole": F.lit(False), "f": F.lit(1.0)})
    for d in DIMS:
        own = goal.filter(F.col("dim") == d).select(F.col("value").alias(d), F.col("want").alias(f"want_{d}"), (F.col("want") >= F.col("tokens") * (1 - 1e-9)).alias("all"))
        base = base.join(small(d, own), d).withColumn("whole", F.col("whole") | (F.col("all") if bounded else F.lit(False))).drop("all")
    now = base = cut(together(base.withColumn("miss", F.lit(0.0))))

    worst, least, since = 0.0, float("inf"), 0
    for _ in range(sweeps):
        last = now
        now = together(now).withColumn("miss", F.lit(0.0))
        for d in DIMS:
            full = (F.col("p") >= 1) if bounded else F.lit(False)
            part = F.when(F.col("whole"), 0.0).otherwise(F.col("tokens") * F.col("p"))
            now = summed(p(now), d, given_=F.when(F.col("whole"), F.col("tokens")).otherwise(0.0), held=F.when(full, part).otherwise(0.0), free=F.when(full, 0.0).otherwise(part))
            raked, open_ = F.col("held") + F.col("free"), F.col(f"want_{d}") - F.col("given_")
            grow, shrink = (open_ - F.col("held")) / F.col("free"), F.greatest(open_ / raked, F.lit(1e-6))
            x = F.when((F.col("free") > 0) & (open_ >= raked), grow).when(raked > 0, F.least(shrink, F.lit(1.0)) if bounded else shrink).otherwise(1.0)
            miss = F.abs(F.col("given_") + raked - F.col(f"want_{d}"))  # before the step
            now = now.withColumns({"f": F.col("f") * x, "miss": F.greatest("miss", miss)}).select(base.columns)
            if not few or d == DIMS[-1]:
                now = cut(now)
                remove(last)
                last = now
        worst = (together(now).agg(F.max("miss")).first()[0] or 0.0) / max(total, 1e-300)
        least, since = (worst, 0) if worst < 0.98 * least else (least, since + 1)
        if worst < tolerance or since == 6:  # fitted, or no longer getting nearer: the bounds bar it
            break
    done = cut(p(together(now)).select(*DIMS, "tokens", "whole", "p"))
    remove(now)
    return done, worst


def rates(rows: DataFrame, given: dict[str, dict[str, float]], temperature: float, budget: float | None, tolerance: float, sweeps: int) -> tuple[DataFrame, DataFrame, int, float]:
    """(cells with p, goals, number of cells, tokens wanted) of rows (n and the dimensions)."""
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("n").cast("double").alias("tokens")))
    counted = cells.agg(F.count(F.lit(1)), F.sum("tokens"), *[F.count_distinct(d) for d in DIMS]).first()
    number, total, values = counted[0], counted[1] or 0.0, dict(zip(DIMS, counted[2:], strict=True))
    wanted = budget * total if budget is not None else 1.0
    goal = cut(goals(cells, given, temperature, wanted if budget is not None else None))
    done, worst = fitted(cells, goal, values, number, wanted, budget is not None, tolerance, sweeps)
    if worst >= tolerance:
        warnings.warn(f"raking ended with a marginal off by {worst:.2g} of the wanted tokens; see marginals()", stacklevel=3)
    if budget is None and number:
        most = done.agg(F.max("p")).first()[0]
        done = done.withColumn("p", F.least(F.lit(1.0), F.col("p") / F.lit(most)))
        wanted = 1 / most
        goal = goal.withColumn("want", F.col("want") * F.lit(wanted))
    return done, goal, number, wanted


def _joined(rows: DataFrame, name: str, p: DataFrame, number: int) -> DataFrame:
    p = p.select(F.struct(*DIMS).alias(f"{name}cell"), F.col("p").alias(f"{name}p"))
    cell = F.struct(*[F.col(f"{name}.{d}").alias(d) for d in DIMS])
    return rows.join(F.broadcast(p) if number <= SMALL else p, cell == F.col(f"{name}cell"))


def probabilities(df: DataFrame, given: dict[str, dict[str, float]] | None = None, temperature: float = 0.5, budget: float | None = 0.5, topic: Column | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tolerance: float = 1e-4, sweeps: int = 60) -> DataFrame:
    """id, source, lang, topic, n_tokens, probability, selected of each row."""
    rows, name = described(df, id_col, text, source, lang, topic)
    rows = cut(rows.select(F.col(id_col).alias("id"), F.col(name)))
    p, _, number, _ = rates(rows.select(f"{name}.*"), given or {}, temperature, budget, tolerance, sweeps)
    own = [F.col(f"{name}.{d}").alias(d) for d in DIMS]
    return _joined(rows, name, p, number).select(F.col("id").alias(id_col), *own, F.col(f"{name}.n").alias("n_tokens"), F.col(f"{name}p").alias("probability"), (F.col(f"{name}.u") < F.col(f"{name}p")).alias("selected"))


def mixed(df: DataFrame, given: dict[str, dict[str, float]] | None = None, temperature: float = 0.5, budget: float | None = 0.5, topic: Column | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tolerance: float = 1e-4, sweeps: int = 60) -> DataFrame:
    """The rows of df that are selected, columns unchanged."""
    rows, name = described(df, id_col, text, source, lang, topic)
    p, _, number, _ = rates(rows.select(f"{name}.*"), given or {}, temperature, budget, tolerance, sweeps)
    return _joined(rows, name, p, number).filter(F.col(f"{name}.u") < F.col(f"{name}p")).select(*[F.col(f"`{c}`") for c in df.columns])


def marginals(df: DataFrame, given: dict[str, dict[str, float]] | None = None, temperature: float = 0.5, budget: float | None = 0.5, topic: Column | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tolerance: float = 1e-4, sweeps: int = 60) -> DataFrame:
    """dim, value, tokens, target, dealt, reached (shares of the wanted tokens) and status: met, short (the value has
    fewer tokens than its target, or stands in for one that has) or barred (the other dimensions' bounds keep it from
    what it was dealt)."""
    rows, name = described(df, id_col, text, source, lang, topic)
    p, goal, _, wanted = rates(rows.select(f"{name}.*"), given or {}, temperature, budget, tolerance, sweeps)
    shares = _off(p, goal).select("dim", "value", "tokens", F.col("share").alias("target"), *[(F.col(c) / F.lit(wanted)).alias(to) for c, to in (("want", "dealt"), ("reached", "reached"))])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-3
    return shares.withColumn("status", F.when(~near("reached", "dealt"), "barred").when(~near("dealt", "target"), "short").otherwise("met"))
