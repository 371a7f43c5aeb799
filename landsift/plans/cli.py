"""Command line: query, stats and export over a stored table."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators import explore, stats
from ..schema import FIELDS
from ..sources import readers, writers
from .filterlang import FilterError, apply_filter, to_number

TABLE = "data/listings.parquet"
#: Commands, option names and what they default to are the interface; the wording is our own.
USAGE = f"""landsift - questions to a stored listings table

  landsift query [expr] [--db path] [--limit N] [--columns a,b,c] [--json]
  landsift stats [expr] [--db path] [--by field] [--limit N] [--json]
  landsift export [expr] [--out path] [--db path] [--format json|csv] [--columns a,b,c]

--db defaults to {TABLE}; --limit to {explore.ROWS} rows (0: all) and {stats.GROUPS} groups.
expr: field op value, joined by and / or (and binds tighter), with parentheses.
field: {", ".join(FIELDS)}; op: < <= > >= = and : (contains)."""


def parse_args(argv: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """Positionals and options; --k v, --k=v and bare --k; a value never begins with --."""
    rest, options, queue = [], {}, list(argv)
    while queue:
        word = queue.pop(0)
        if not word.startswith("--"):
            rest.append(word)
        elif "=" in word:
            key, value = word[2:].split("=", 1)
            options[key] = value
        else:
            options[word[2:]] = queue.pop(0) if queue and not queue[0].startswith("--") else True
    return rest, options


def text_option(options: dict, key: str) -> str | None:
    if options.get(key) is True:
        raise ValueError(f"--{key} was given without its value")
    return options.get(key)


def number_option(options: dict, key: str) -> float | None:
    raw = text_option(options, key)
    if raw is None:
        return None
    if (n := to_number(raw)) is None:
        raise ValueError(f"--{key} takes a number; {raw!r} is none")
    return n


def _query(df, expr, options, say: Callable[[str], None]) -> None:
    limit = number_option(options, "limit")
    limit = explore.ROWS if limit is None else limit
    out = explore.query(df, expr, limit, text_option(options, "columns"))
    rows = [r.asDict() for r in out.collect()]
    if options.get("json"):
        say(json.dumps(rows, ensure_ascii=False, indent=2))
        return
    more = f"; --limit cut the list at {limit:g}" if limit > 0 and len(rows) == limit else ""
    say(writers.text_table(rows, out.columns))
    say(f"({len(rows)} row{'' if len(rows) == 1 else 's'}{more})")


def _stats(df, expr, options, say: Callable[[str], None]) -> None:
    by, limit = text_option(options, "by"), number_option(options, "limit")
    total = stats.overall(df, expr).first().asDict()
    groups = [r.asDict() for r in stats.by_field(df, by, expr, stats.GROUPS if limit is None else limit).collect()] if by else None
    if options.get("json"):
        say(json.dumps({"overall": total} | ({"by": by.lower(), "groups": groups} if by else {}), ensure_ascii=False, indent=2))
        return
    n = writers.number
    say(f"listings: {n(total['count'])}")
    say(f"price_mxn: min {n(total['price_min'])}  avg {n(total['price_avg'])}  max {n(total['price_max'])}")
    say(f"m2: avg {n(total['m2_avg'], 1)}")
    say(f"price/m2: avg {n(total['price_per_m2_avg'])}")
    if by:
        say(f"\nby {by.lower()}:")
        say(writers.text_table([{by.lower(): g["group"], "count": n(g["count"]), "price_avg": n(g["price_avg"]), "price_per_m2_avg": n(g["price_per_m2_avg"])} for g in groups], [by.lower(), "count", "price_avg", "price_per_m2_avg"]))


def _export(df, expr, options, say: Callable[[str], None]) -> None:
    out, kind = text_option(options, "out"), text_option(options, "format")
    writers.pick_format(kind, out)
    rows = explore.newest(apply_filter(df, expr)).select(*explore.resolve_columns(text_option(options, "columns")))
    text, n = writers.export(rows, kind, out)
    say(f"{n} row{'' if n == 1 else 's'} as {writers.pick_format(kind, out)} in {os.path.abspath(out)}" if out else text.removesuffix("\n"))


def main(argv: list[str], spark: SparkSession | None = None, say: Callable[[str], None] = print, complain: Callable[[str], None] | None = None) -> int:
    complain = complain or (lambda line: print(line, file=sys.stderr))
    commands = {"query": _query, "stats": _stats, "export": _export}
    if not argv or argv[0] in ("--help", "-h"):
        say(USAGE)
        return 0 if argv else 1
    rest, options = parse_args(argv[1:])
    if "help" in options:
        say(USAGE)
        return 0
    if argv[0] not in commands:
        complain(f"no such command: {argv[0]}\n\n{USAGE}")
        return 1
    try:
        spark = spark or SparkSession.builder.appName("landsift").getOrCreate()
        commands[argv[0]](readers.stored(spark, text_option(options, "db") or TABLE), rest[0] if rest else None, options, say)
    except FilterError as e:
        complain(f"Error: {e} (position {e.position})")
        return 1
    except (ValueError, FileNotFoundError) as e:
        complain(f"Error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
