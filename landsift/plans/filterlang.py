"""The filter language: text -> tokens -> tree -> Column, or SQL fragment with parameters.

    expr := term ("or" term)* ; term := clause ("and" clause)* ; clause := field op value | "(" expr ")"
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..schema import FIELDS, NUMERIC


class FilterError(ValueError):
    """A filter that can't be used; position counts characters from 0."""

    def __init__(self, message: str, position: int):
        super().__init__(message)
        self.position = position


class LexError(FilterError):
    pass


class ParseError(FilterError):
    pass


class EvalError(FilterError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # NUMBER STRING WORD AND OR LPAREN RPAREN OP EOF
    value: str
    position: int


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: str
    kind: str  # of the value's token
    position: int


@dataclass(frozen=True)
class Logical:
    op: str  # and, or
    left: Comparison | Logical
    right: Comparison | Logical
    position: int


_SIMPLE = re.compile(r"(?P<blank>[ \t\n\r]+)|(?P<LPAREN>\()|(?P<RPAREN>\))|(?P<NUMBER>-?[0-9]+(?:\.[0-9]+)?)|(?P<OP><=|>=|[<>=:])")
_QUOTED = {q: re.compile(rf"(?:[^\\{q}]|\\[\\{q}])*") for q in "\"'"}


def _letter(c: str, first: bool) -> bool:
    kind = unicodedata.category(c)[0]
    return c == "_" or kind == "L" or (kind == "N" and not first)


def tokenize(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        c = source[at]
        if m := _SIMPLE.match(source, at):
            if m.lastgroup != "blank":
                out.append(Token(m.lastgroup, m[0], at))
            at = m.end()
        elif c in _QUOTED:
            body = _QUOTED[c].match(source, at + 1)
            if body.end() == len(source):
                raise LexError(f"String opened at {at} is never closed", at)
            if source[body.end()] == "\\":
                raise LexError(f"Bad escape in the string opened at {at}", body.end())
            out.append(Token("STRING", re.sub(r"\\(.)", r"\1", body[0], flags=re.S), at))
            at = body.end() + 1
        elif _letter(c, True):
            end = at + 1
            while end < len(source) and _letter(source[end], False):
                end += 1
            word = source[at:end]
            out.append(Token(word.upper() if word.lower() in ("and", "or") else "WORD", word, at))
            at = end
        else:
            raise LexError(f"Unexpected character {c!r} at {at}", at)
    return [*out, Token("EOF", "", len(source))]


def parse(source: str):
    """The tree of a filter, by precedence climbing: or binds 1, and binds 2, both to the left."""
    stream, power = tokenize(source), {"OR": 1, "AND": 2}

    def shown(t: Token) -> str:
        return "end of input" if t.kind == "EOF" else repr(t.value)

    def take(kinds: tuple[str, ...], wanted: str) -> Token:
        if stream[0].kind not in kinds:
            hint = " (a keyword; quote it to use it as a value)" if stream[0].kind in power and "STRING" in kinds else ""
            raise ParseError(f"Expected {wanted}, got {shown(stream[0])}{hint}", stream[0].position)
        return stream.pop(0)

    def clause():
        if stream[0].kind == "LPAREN":
            stream.pop(0)
            inner = climb(1)
            take(("RPAREN",), "')'")
            return inner
        name = take(("WORD",), f"a field ({', '.join(FIELDS)})")
        if name.value.lower() not in FIELDS:
            raise ParseError(f"Unknown field {name.value!r}, expected one of: {', '.join(FIELDS)}", name.position)
        op = take(("OP",), f"an operator after {name.value!r}")
        value = take(("NUMBER", "STRING", "WORD"), f"a value after '{name.value}{op.value}'")
        return Comparison(name.value.lower(), op.value, value.value, value.kind, name.position)

    def climb(least: int):
        left = clause()
        while power.get(stream[0].kind, 0) >= least:
            op = stream.pop(0)
            left = Logical(op.kind.lower(), left, climb(power[op.kind] + 1), op.position)
        return left

    tree = climb(1)
    take(("EOF",), "'and', 'or' or the end")
    return tree


_NUMBER = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\Z")
_RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)\Z")


def to_number(text: str) -> float | None:
    """What a browser's Number() makes of the text; blank is 0, not a number is None."""
    text = text.strip()
    if not text:
        return 0.0
    if _RADIX.match(text):
        return float(int(text, 0))
    return float(text.replace("Infinity", "inf")) if _NUMBER.match(text) else None


def _operand(node: Comparison):
    """The checked value of a comparison: a number, or text."""
    if node.op == ":":
        if node.field in NUMERIC:
            raise EvalError(f"':' (contains) doesn't fit the numeric field {node.field!r}", node.position)
        return node.value.lower()
    if node.field not in NUMERIC:
        return node.value
    number = to_number(node.value) if node.value.strip() else None
    if number is None or math.isnan(number):
        raise EvalError(f"Field {node.field!r} expects a number after {node.op!r}, got {node.value!r}", node.position)
    return int(number) if number.is_integer() else number


def to_sql(tree) -> tuple[str, list]:
    """(SQL condition with ? marks, parameters); logical operands are in parentheses."""
    if isinstance(tree, Logical):
        parts = [to_sql(x) for x in (tree.left, tree.right)]
        texts = [f"({sql})" if isinstance(x, Logical) else sql for x, (sql, _) in zip((tree.left, tree.right), parts, strict=True)]
        return f" {tree.op.upper()} ".join(texts), parts[0][1] + parts[1][1]
    value, column = _operand(tree), FIELDS[tree.field]
    if tree.op == ":":
        return f"LOWER({column}) LIKE ? ESCAPE '\\'", [f"%{re.sub(r'([\\%_])', r'\\\1', value)}%"]
    return f"{column} {tree.op} ?", [value]


def to_column(tree, unicode: bool = False) -> Column:
    """The condition. Contains lower-cases A-Z of the column only; unicode=True lower-cases all letters."""
    if isinstance(tree, Logical):
        left, right = to_column(tree.left, unicode), to_column(tree.right, unicode)
        return left & right if tree.op == "and" else left | right
    value, column = _operand(tree), F.col(FIELDS[tree.field])
    if tree.op == ":":
        return F.contains((F.lower if unicode else ascii_lower)(column), F.lit(value))
    return {"<": column.__lt__, "<=": column.__le__, ">": column.__gt__, ">=": column.__ge__, "=": column.__eq__}[tree.op](F.lit(value))


def compile_filter(source: str) -> tuple[str, list]:
    return to_sql(parse(source))


def apply_filter(df: DataFrame, source: str | None, unicode: bool = False) -> DataFrame:
    """df's rows that the filter admits; a blank filter admits all."""
    return df if source is None or not source.strip() else df.filter(to_column(parse(source), unicode))
