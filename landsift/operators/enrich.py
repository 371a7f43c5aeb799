"""Points to polygons, attributes by polygon, distances between sets of points."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, point_in_polygon
from ..schema import COVERAGE_TARGET, ENRICHED, ENRICHED_ESTADO

GRID = 0.05  # degrees of the cells that points and boxes share as a join key


def _cells(df: DataFrame, low: str, high: str, other_low: str, other_high: str, step: float) -> DataFrame:
    """df exploded to the grid cells of its box."""
    def span(a, b):
        return F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step))

    return df.withColumn("_x", F.explode(span(low, high))).withColumn("_y", F.explode(span(other_low, other_high)))


def batch_assign(points: DataFrame, polygons: DataFrame, by: tuple[str, ...] = (), step: float = GRID) -> DataFrame:
    """(id, ageb_id) of all points (id, lat, lng): the first polygon by ordinal that holds the point, or null. by:
    columns that point and polygon must share. An equi-join on grid cells, with the box and the exact test as residuals,
    takes the place of comparing every point with every polygon."""
    boxes = _cells(polygons.filter(F.size("ring") >= 3).select(*by, "ordinal", "ageb_id", "ring", "min_lat", "max_lat", "min_lng", "max_lng"), "min_lat", "max_lat", "min_lng", "max_lng", step)
    p = points.select("id", "lat", "lng", *by, F.floor(F.col("lat") / step).alias("_x"), F.floor(F.col("lng") / step).alias("_y"))
    near = p.join(boxes, [*by, "_x", "_y"]).filter(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lng").between(F.col("min_lng"), F.col("max_lng")))
    hits = near.filter(point_in_polygon(F.col("lat"), F.col("lng"), F.col("ring"))).groupBy("id").agg(F.min(F.struct("ordinal", "ageb_id")).alias("hit"))
    return points.select("id").join(hits, "id", "left").select("id", F.col("hit.ageb_id").alias("ageb_id"))


def with_columns(rows: DataFrame) -> DataFrame:
    """rows with the three enrichment columns, null where they were missing."""
    missing = [c for c in ENRICHED if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("double" if c.endswith("index") else "string") for c in missing}) if missing else rows


def enriched(rows: DataFrame, polygons: DataFrame, attributes: DataFrame, estado: str = ENRICHED_ESTADO) -> DataFrame:
    """rows with polygon, grade and index for those of one estado (null where nothing fits); others keep theirs."""
    rows = with_columns(rows)
    own = rows.filter(F.col("estado") == estado)
    found = batch_assign(own, polygons, ("municipio",)).join(attributes.select("ageb_id", F.col("grade").alias("_g"), F.col("index_value").alias("_i")), "ageb_id", "left").select("id", F.col("ageb_id").alias("_a"), "_g", "_i")
    here = F.col("estado") == estado
    new = dict(zip(ENRICHED, ("_a", "_g", "_i"), strict=True))
    return rows.join(found, "id", "left").withColumns({c: F.when(here, F.col(n)).otherwise(F.col(c)) for c, n in new.items()}).drop("_a", "_g", "_i").select(*rows.columns)


def coverage(rows: DataFrame, estado: str = ENRICHED_ESTADO) -> DataFrame:
    """(total, assigned, rate) of one estado; rate 0 without rows."""
    return rows.filter(F.col("estado") == estado).agg(F.count(F.lit(1)).alias("total"), F.count("ageb_id").alias("assigned")).withColumn("rate", F.coalesce(F.try_divide(F.col("assigned").cast("double"), F.col("total")), F.lit(0.0)))


def warn_of_coverage(one: DataFrame) -> dict:
    got = one.first().asDict()
    if got["rate"] < COVERAGE_TARGET:
        warnings.warn(f"only {got['rate']:.1%} of points were assigned", stacklevel=2)
    return got


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, meters) of all pairs of points (i, lat, lng) and (j, lat, lng): the full matrix is the feature."""
    return a.alias("a").join(b.alias("b"), F.lit(True)).select("i", "j", haversine(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")).alias("meters"))
