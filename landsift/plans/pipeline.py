"""The batch pipeline: read, validate, label duplicates, store, enrich, summarise, export."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, dedupe, enrich, explore, stats
from ..sources import generate, readers, writers
from ..sources.store import cut


def build(spark: SparkSession, raw: str, table: str) -> dict:
    """The stored table from raw CSV files; an existing one is replaced."""
    rows = cut(clean.first_of_id(clean.cleaned(readers.raw_listings(spark, raw)), "_file", "_pos"))
    counts = {r["reason"]: r["n"] for r in clean.drop_statistics(rows).collect()}
    kept = counts.pop("kept", 0)
    labelled = cut(dedupe.with_duplicates(clean.kept(rows)))
    writers.store(labelled, table)
    return {"read": kept + sum(counts.values()), "rows": kept, "dropped": sum(counts.values()), "drop_reasons": counts, "duplicates": labelled.filter("dup_of is not null").count()}


def relabel(spark: SparkSession, table: str) -> dict:
    """Labels the duplicates of a stored table anew."""
    rows = cut(dedupe.with_duplicates(readers.stored(spark, table)))
    writers.replace(rows, table)
    return dedupe.duplicate_rate(rows).first().asDict()


def locate(spark: SparkSession, table: str, polygons: str, attributes: str) -> dict:
    """Polygons and attributes for the stored table's rows."""
    rows = cut(enrich.enriched(readers.stored(spark, table), readers.polygons(spark, polygons), readers.attributes(spark, attributes)))
    writers.replace(rows, table)
    return enrich.warn_of_coverage(enrich.coverage(rows))


def summary(df: DataFrame) -> dict:
    return {
        "generated_at": datetime.now(UTC).isoformat(),
        "total_listings": stats.originals(df).count(),
        "by_colonia": [r.asDict() for r in stats.colonia_medians(df).collect()],
        "histogram": [{"bucket_max_mxn": r["bucket_max"], "count": r["count"]} for r in stats.price_ladder(df).collect()],
    }


def write_summary(spark: SparkSession, table: str, out: str) -> dict:
    doc = summary(readers.stored(spark, table))
    with open(out, "w", encoding="utf-8") as f:
        f.write(json.dumps(doc, ensure_ascii=False, indent=2) + "\n")
    return doc


def export_slice(spark: SparkSession, table: str, out: str, rows: int = explore.SLICE_ROWS) -> int:
    return writers.write_slice(explore.web_slice(readers.stored(spark, table), rows), out)


def make(spark: SparkSession, raw: str, rows: str = "97000") -> dict:
    """Generated listings as raw CSV files, those of the second source in Latin-1."""
    writers.write_raw(generate.generate(spark, int(rows)), raw, (generate.SOURCES[1],))
    return {"files": len(readers.listing_files(spark, raw))}


#: stage -> (function, its arguments as the command line takes them)
STAGES: dict[str, tuple[Callable, str]] = {
    "generate": (make, "RAW [ROWS]"),
    "build": (build, "RAW TABLE"),
    "relabel": (relabel, "TABLE"),
    "locate": (locate, "TABLE POLYGONS ATTRIBUTES"),
    "summary": (lambda spark, table, out: {"groups": len(write_summary(spark, table, out)["by_colonia"])}, "TABLE OUT"),
    "slice": (lambda spark, table, out, rows=explore.SLICE_ROWS: {"rows": export_slice(spark, table, out, int(rows))}, "TABLE OUT [ROWS]"),
}


def main(argv: list[str], spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    """python -m landsift.plans.pipeline STAGE ARGUMENT...: one stage, whose figures are printed as JSON."""
    usage = "\n".join(f"python -m landsift.plans.pipeline {name} {words}" for name, (_, words) in STAGES.items())
    if not argv or argv[0] not in STAGES:
        say(usage)
        return 1
    run, words = STAGES[argv[0]]
    most = len(words.split())
    if not most - words.count("[") <= len(argv) - 1 <= most:
        say(usage)
        return 1
    say(json.dumps(run(spark or SparkSession.builder.appName("landsift").getOrCreate(), *argv[1:]), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
