"""Grouped and overall statistics, exact medians, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filterlang import apply_filter
from ..schema import FIELDS, PRICE_LADDER

GROUPS = 15


def per_m2(price: str = "price_mxn", m2: str = "m2"):
    """Price a square metre; null without area."""
    return F.try_divide(F.col(price).cast("double"), F.col(m2))


def overall(df: DataFrame, filter: str | None = None) -> DataFrame:
    """One row; without rows the count is 0 and the rest null."""
    return apply_filter(df, filter).agg(F.count(F.lit(1)).alias("count"), F.min("price_mxn").alias("price_min"), F.avg("price_mxn").alias("price_avg"), F.max("price_mxn").alias("price_max"), F.avg("m2").alias("m2_avg"), F.avg(per_m2()).alias("price_per_m2_avg"))


def by_field(df: DataFrame, by: str, filter: str | None = None, limit: int = GROUPS) -> DataFrame:
    """Groups by a filter field, most rows first; limit 0 gives none, below 0 all."""
    if by.lower() not in FIELDS:
        raise ValueError(f"Unknown field {by!r}, expected one of: {', '.join(FIELDS)}")
    if limit != int(limit):
        raise ValueError("limit must be a whole number")
    out = apply_filter(df, filter).groupBy(F.col(FIELDS[by.lower()]).alias("group")).agg(F.count(F.lit(1)).alias("count"), F.avg("price_mxn").alias("price_avg"), F.avg(per_m2()).alias("price_per_m2_avg")).orderBy(F.desc("count"), F.asc("group"))
    return out if limit < 0 else out.limit(int(limit))


def originals(df: DataFrame) -> DataFrame:
    return df.filter(F.col("dup_of").isNull())


def colonia_medians(df: DataFrame) -> DataFrame:
    """Per (colonia, municipio): rows, exact median price a m2 to cents; groups without area are left out."""
    out = originals(df).groupBy("colonia", "municipio").agg(F.count(F.lit(1)).alias("count"), F.round(F.median(F.when(F.col("m2") > 0, per_m2())), 2).alias("median_price_per_m2"))
    return out.filter(F.col("median_price_per_m2").isNotNull()).orderBy(F.desc("count"), "colonia", "municipio")


def price_ladder(df: DataFrame) -> DataFrame:
    """(bucket, bucket_max, count) of originals: buckets are (previous, max], the last is open; empty ones are kept."""
    spark, price = df.sparkSession, F.col("price_mxn")
    bucket = F.when(price > 0, F.size(F.filter(F.array(*map(F.lit, PRICE_LADDER)), lambda b: price > b)))
    counts = originals(df).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count")).filter(F.col("bucket").isNotNull())
    ladder = spark.range(len(PRICE_LADDER) + 1).select(F.col("id").cast("int").alias("bucket"), F.get(F.array(*map(F.lit, PRICE_LADDER)), F.col("id").cast("int")).cast("long").alias("bucket_max"))
    return ladder.join(counts, "bucket", "left").select("bucket", "bucket_max", F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("bucket")


def equal_width(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, high, count) of prices in equal bins, the maximum in the last; one bin if all are equal, none without
    rows or bins."""
    ends = df.agg(F.min("price_mxn").cast("double").alias("lo"), F.max("price_mxn").cast("double").alias("hi")).filter(F.col("lo").isNotNull() & F.lit(bins > 0))
    ends = ends.withColumn("n", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("n"))
    at = F.when(F.col("width") == 0, 0).otherwise(F.least(F.col("n") - 1, F.floor(F.try_divide(F.col("price_mxn") - F.col("lo"), F.col("width")))))
    counts = df.filter(F.col("price_mxn").isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = ends.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"), "lo", "width", "hi", "n")
    high = F.when(F.col("bin") == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width"))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), high.alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("bin")


def colonia_ranking(df: DataFrame, top: int = 20, order: str = "id") -> DataFrame:
    """Per colonia with area: exact median price a m2, rows and most frequent municipio (ties: the first seen by
    `order`); the `top` highest medians, ties to the colonia seen first."""
    rows = df.filter(F.col("m2") > 0)
    towns = rows.groupBy("colonia", "municipio").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    mode = towns.groupBy("colonia").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "municipio")).alias("m"), F.min("first").alias("first"))
    medians = rows.groupBy("colonia").agg(F.median(per_m2()).alias("median_price_per_m2"), F.count(F.lit(1)).alias("count"))
    return medians.join(mode, "colonia").orderBy(F.desc("median_price_per_m2"), "first").limit(top).select("colonia", F.col("m.municipio").alias("municipio"), "count", "median_price_per_m2")
