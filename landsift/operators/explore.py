"""Query, export slice, sorting and strided samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.filterlang import apply_filter
from ..schema import QUERY_COLUMNS, SLICE_COLUMNS, TABLE_COLUMNS

ROWS, SLICE_ROWS, TABLE_ROWS, MARKERS = 20, 5000, 300, 400


def resolve_columns(names: str | None) -> list[str]:
    """Of a comma-separated list the known columns in the user's order, each once; all without a list."""
    wanted = [n.strip() for n in (names or "").split(",") if n.strip()]
    for n in wanted:
        if n not in QUERY_COLUMNS:
            raise ValueError(f"Unknown column {n!r}, expected one of: {', '.join(QUERY_COLUMNS)}")
    return list(dict.fromkeys(wanted)) or list(QUERY_COLUMNS)


def newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("listed_date"), F.asc("id"))


def query(df: DataFrame, filter: str | None = None, limit: float | None = ROWS, columns: str | None = None) -> DataFrame:
    """Newest rows that the filter admits; a limit of 0 or below is none."""
    limit = ROWS if limit is None else limit
    if limit > 0 and limit != int(limit):
        raise ValueError("limit must be a whole number")
    out = newest(apply_filter(df, filter))
    return (out.limit(int(limit)) if limit > 0 else out).select(*resolve_columns(columns))


def web_slice(df: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """The newest originals, 12 columns."""
    return newest(df.filter(F.col("dup_of").isNull())).limit(rows).select(*SLICE_COLUMNS)


def sort_listings(df: DataFrame, field: str, direction: str = "asc", order: str = "id") -> DataFrame:
    """Numbers by value, texts by Unicode collation; ties by `order`."""
    text = dict(df.dtypes)[field] == "string"
    key = F.collate(F.col(field), "UNICODE") if text else F.col(field)
    return df.orderBy(key.asc() if direction == "asc" else key.desc(), F.asc(order))


def table_rows(df: DataFrame, field: str = "listed_date", direction: str = "desc", rows: int = TABLE_ROWS) -> DataFrame:
    """The explorer's table: its 8 columns of the first rows by one of them."""
    if field not in TABLE_COLUMNS:
        raise ValueError(f"{field!r} is not a column of the table: {', '.join(TABLE_COLUMNS)}")
    return sort_listings(df, field, direction).limit(rows).select(*TABLE_COLUMNS)


def strided(df: DataFrame, order: list, most: int = MARKERS) -> DataFrame:
    """At most `most` rows at equal strides in the order given: rows floor(i * n / most). For slices that are capped
    already: ranking all rows is one task's work."""
    ranked = df.withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    # position p is chosen if some i has floor(i * n / most) = p, and the least such i is ceil(p * most / n)
    i = F.ceil(F.col("_at") * most / F.col("_n").cast("double"))
    return ranked.filter((F.col("_n") <= most) | ((i < most) & (F.floor(i * F.col("_n") / most) == F.col("_at")))).drop("_at", "_n")


def plottable(df: DataFrame) -> DataFrame:
    """Rows with finite coordinates that are not both 0."""
    def finite(c):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return df.filter(finite("lat") & finite("lng") & ~((F.col("lat") == 0) & (F.col("lng") == 0)))
