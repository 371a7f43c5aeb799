"""Exact dedup, DataFrame functions only.

Rows are grouped by a 128-bit content hash together with the text: the hash decides where a row goes and orders the
group, the text decides membership byte for byte, so a collision makes two groups, not one. Copies collapse before the
shuffle (partial aggregation), so a text that a third of all rows share sends one row a task. Only (hash, sha256,
id, size) of each group returns to the rows.

Defined cases: a null text counts as empty; null ids lose against every id; exactly one row of a group is kept, also
where rows repeat the id that stays or have null ids alone; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8."""
    return F.unhex(F.md5(text.cast("binary")))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256. keep: min or max, which id stays. Rows that
    repeat id and text are counted before they meet their group and told apart again after it."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    groups = (
        rows.groupBy(hashed(F.col("_text")).alias("_hash"), "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), (F.max if keep == "max" else F.min)("_id").alias("keep_id"))
        .select("_hash", F.sha2("_text", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    named = rows.select("_id", hashed(F.col("_text")).alias("_hash"), F.sha2("_text", 256).alias("text_sha256")).groupBy("_hash", "text_sha256", "_id").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    stays = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_time") == 1)
    return named.join(groups, ["_hash", "text_sha256"]).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), "text_sha256"
    )


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """df with one row of each group of equal texts: the one with the smallest (largest) id, by the other columns'
    order among rows that repeat an id. A null text is returned as empty. One shuffle, copies collapsed before it."""
    others = [id_col, *[c for c in df.columns if c not in (id_col, text)]]
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_row"), (F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()).alias("_last"))
    best = (
        rows.groupBy(content_hash(F.col("_text")).alias("_hash"), "_text")
        .agg((F.min if keep == "min" else F.max)(F.struct("_last", "_row")).alias("_best"))
    )
    return best.select(*[F.col("_text").alias(text) if c == text else F.col("_best._row")[f"c{others.index(c)}"].alias(c) for c in df.columns])
