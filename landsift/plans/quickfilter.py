"""The explorer's filter box: tokens separated by blanks, all of which must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded
from .filterlang import to_number

NUMBERS = {"price": "price_mxn", "m2": "m2", "bedrooms": "bedrooms"}
TEXTS = ("title", "colonia", "municipio", "estado", "type")


def _split(token: str) -> tuple[str | None, str, str]:
    """(field, operator, value); no field makes the token a bare word. Operators are tried in a set order."""
    for op in ("<=", ">=", "<", ">", ":", "="):
        name, found, value = token.partition(op)
        if found and (name in NUMBERS or name in TEXTS):
            return name, op, value
    return None, "", token


def condition(token: str, normal=folded) -> Column:
    name, op, value = _split(token)
    if name in NUMBERS:
        number, column = to_number(value), F.col(NUMBERS[name])
        if number is None:
            return F.lit(False)
        if op == ":":
            return F.contains(column.cast("string"), F.lit(value))
        return {"<": column < number, "<=": column <= number, ">": column > number, ">=": column >= number, "=": column == number}[op]
    needle = F.lit(fold(value))
    return reduce(Column.__or__, [F.contains(normal(F.col(c)), needle) for c in ((name,) if name else TEXTS)]) if fold(value) else F.lit(True)


def quick_filter(df: DataFrame, query: str, normal=folded) -> DataFrame:
    return reduce(lambda d, t: d.filter(condition(t, normal)), query.split(), df)
