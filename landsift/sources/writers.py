"""Sinks: stored tables, updates by key, CSV, JSON and text output."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LISTING, QUERY_COLUMNS


def store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The 18-column table, missing columns null; sorted within files so that row groups can be skipped by town,
    neighbourhood and price."""
    full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in LISTING if f.name not in df.columns})
    full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LISTING]).sortWithinPartitions("municipio", "colonia", "price_mxn").write.mode(mode).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """A stored table by one that is derived from it: written beside it, then swapped by two renames. Readers see the old
    table or the new one, or for a moment between the renames none."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    store(df, new)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(place(path), place(old))
    fs.rename(place(new), place(path))
    fs.delete(place(old), True)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header, distributed; quotes only where needed, blanks kept, null as nothing."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def write_raw(df: DataFrame, folder: str, latin1: tuple[str, ...] = ()) -> None:
    """CSV files listings_<source>_<number>.csv of each source, those of `latin1` in that encoding: what
    readers.raw_listings takes."""
    spark, place = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, rows in (("ISO-8859-1", df.filter(F.col("source").isin(*latin1))), ("UTF-8", df.filter(~F.coalesce(F.col("source").isin(*latin1), F.lit(False))))):
        made = f"{folder}/_{uuid.uuid4().hex}"
        rows.withColumn("file", F.coalesce("source", F.lit(""))).write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", name).partitionBy("file").csv(made)
        found = fs.globStatus(place(f"{made}/file=*/part-*"))
        for i, status in enumerate(found or []):
            at = status.getPath()
            source = at.getParent().getName().removeprefix("file=")
            fs.rename(at, place(f"{folder}/listings_{source}_{i}.csv"))
        fs.delete(place(made), True)


def csv_text(rows: list, columns: list[str]) -> str:
    def cell(v) -> str:
        text = "" if v is None else str(v)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text

    return "".join(",".join(line) + "\n" for line in ([cell(c) for c in columns], *([cell(r[c]) for c in columns] for r in rows)))


def json_text(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2) + "\n"


def pick_format(name: str | None, out: str | None) -> str:
    """The format asked for, else by the file's ending, else JSON."""
    if name not in (None, "json", "csv"):
        raise ValueError(f"--format expects 'json' or 'csv', got {name!r}")
    return name or ("csv" if (out or "").lower().endswith(".csv") else "json")


def export(df: DataFrame, format: str | None = None, out: str | None = None) -> tuple[str, int]:
    """(text, rows) of a result for one reader, written to `out` if given. Large results go by write_csv or Parquet."""
    rows = [r.asDict() for r in df.toLocalIterator()]
    text = csv_text(rows, df.columns) if pick_format(format, out) == "csv" else json_text(rows)
    if out:
        os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
        with open(out, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return text, len(rows)


def slice_text(df: DataFrame) -> str:
    """A compact JSON array of a slice that is capped already."""
    return json.dumps([r.asDict() for r in df.collect()], ensure_ascii=False, separators=(",", ":"))


def write_slice(df: DataFrame, out: str) -> int:
    """slice_text as a file; returns its rows."""
    text = slice_text(df)
    with open(out, "w", encoding="utf-8") as f:
        f.write(text)
    return len(json.loads(text))


def number(value, digits: int = 0) -> str:
    return "-" if value is None or value != value else f"{value:,.{digits}f}"


def short_money(value) -> str:
    """1.2M, 34k or the number."""
    return f"{value / 1e6:.1f}M" if value >= 1e6 else f"{value / 1e3:.0f}k" if value >= 1e3 else f"{value:.0f}"


def text_table(rows: list[dict], columns: list[str]) -> str:
    if not rows:
        return "(no rows)"
    cells = [["" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    widths = [max(map(len, column)) for column in zip(columns, *cells, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)) for line in (columns, ["-" * w for w in widths], *cells))


__all__ = ["QUERY_COLUMNS", "csv_text", "export", "json_text", "number", "pick_format", "replace", "short_money", "slice_text", "store", "text_table", "write_csv", "write_raw", "write_slice"]
