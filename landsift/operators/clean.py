"""Validation of raw rows: one ordered CASE names the first rule that a row breaks; of rows that break none the first
of each id stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..schema import LAT, LNG, QUERY_COLUMNS, TYPES

NUMBER = r"^[+-]?([0-9]+(_?[0-9]+)*\.?([0-9]+(_?[0-9]+)*)?|\.[0-9]+(_?[0-9]+)*)([eE][+-]?[0-9]+)?$"


def to_double(text: Column) -> Column:
    """A plain decimal number of stripped text, or null; underscores between digits are allowed, suffixes and names are
    not."""
    return F.when(text.rlike(NUMBER), F.translate(text, "_", "").try_cast("double"))


def rounded(c: Column) -> Column:
    """Half to even, as a long; null where it doesn't fit."""
    return F.when(F.abs(c) < 9e18, F.rint(c).cast("long"))


def valid_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def cleaned(raw: DataFrame) -> DataFrame:
    """Typed columns of raw string rows, and `reason`: the first rule broken, or null. Other columns stay. A price's $ and
    commas are ignored, blank bedrooms are none. Texts are stripped, read as numbers and rounded in projections of their
    own, so that each step is worked out once a value, however often the next one names it."""
    others = [F.col(f"`{c}`") for c in raw.columns if c not in QUERY_COLUMNS]

    def step(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
        return rows.select(*others, *[new.get(c, F.col(c)).alias(c) for c in QUERY_COLUMNS])

    rows = step(raw, {c: F.coalesce(strip(F.translate(c, "$,", "") if c == "price_mxn" else F.col(c)), F.lit("")) for c in QUERY_COLUMNS})
    numbers = {c: to_double(F.col(c)) for c in ("price_mxn", "m2", "lat", "lng")} | {"bedrooms": F.when(F.col("bedrooms") == "", 0.0).otherwise(to_double(F.col("bedrooms")))}
    rows = step(rows, numbers | {"type": F.lower("type")})
    rows = step(rows, {c: rounded(F.col(c)) for c in ("price_mxn", "m2", "bedrooms")})
    rows = step(rows, {"price_mxn": F.when(F.col("price_mxn") > 0, F.col("price_mxn"))})
    broken = [
        (F.col("id") == "", "missing_id"),
        (F.col("price_mxn").isNull(), "bad_price"),
        (~F.coalesce(F.col("m2") > 0, F.lit(False)), "bad_m2"),
        (~F.coalesce(F.col("bedrooms") >= 0, F.lit(False)), "bad_bedrooms"),
        (~F.col("type").isin(*TYPES), "bad_type"),
        ((F.col("colonia") == "") | (F.col("municipio") == "") | (F.col("estado") == ""), "missing_location"),
        (~F.coalesce(F.col("lat").between(*LAT) & F.col("lng").between(*LNG), F.lit(False)), "bad_coords"),
        (~valid_date(F.col("listed_date")), "bad_date"),
    ]
    return rows.withColumn("reason", F.coalesce(*[F.when(test, F.lit(name)) for test, name in broken]))


def first_of_id(rows: DataFrame, *order: str) -> DataFrame:
    """rows with reason duplicate_id on valid rows whose id an earlier valid row has; order: columns of the row's place.
    The window is over (id, validity), so broken rows without ids spread by their own place."""
    valid = F.col("reason").isNull()
    spread = F.when(valid, F.lit(0)).otherwise(F.pmod(F.xxhash64(*order), F.lit(1024)))
    n = F.row_number().over(Window.partitionBy("id", valid, spread).orderBy(*order))
    return rows.withColumn("reason", F.when(valid & (n > 1), "duplicate_id").otherwise(F.col("reason")))


def drop_statistics(rows: DataFrame) -> DataFrame:
    """(reason, n): kept rows under 'kept'."""
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason").isNull()).select(*QUERY_COLUMNS)
