"""Map-only parts on streaming DataFrames: validation, filters, and polygon lookup against a static table. Duplicates,
global order and medians need the whole snapshot and stay batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point_in_polygon
from ..operators.clean import cleaned
from ..plans.filterlang import apply_filter


def validated(stream: DataFrame) -> DataFrame:
    """Raw rows with types and reason; ids that repeat over time are not judged."""
    return cleaned(stream)


def filtered(stream: DataFrame, expr: str | None) -> DataFrame:
    return apply_filter(stream, expr)


def located(stream: DataFrame, polygons: DataFrame) -> DataFrame:
    """Rows of the stream with the first polygon by ordinal of their municipality that holds them (ordinal, ageb_id), or
    null: one row each. A town's polygons are a static list, so nothing is kept between batches."""
    box = ("min_lat", "min_lng", "max_lat", "max_lng")
    towns = polygons.groupBy(F.col("municipio").alias("_town")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "ageb_id", "ring", *box))).alias("_rings"))

    def holds(p):
        return F.col("lat").between(p["min_lat"], p["max_lat"]) & F.col("lng").between(p["min_lng"], p["max_lng"]) & point_in_polygon(F.col("lat"), F.col("lng"), p["ring"])

    first = F.get(F.filter("_rings", holds), F.lit(0))
    return stream.join(towns, F.col("municipio") == F.col("_town"), "left").withColumns({"ordinal": first["ordinal"], "ageb_id": first["ageb_id"]}).drop("_town", "_rings")
