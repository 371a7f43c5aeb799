"""Chat formatting, DataFrame functions only.

A declarative template turns each conversation into segments: per turn a header (role), the text and a close, each with
a loss flag; only texts of the template's loss roles carry it. A finite-state machine over the roles says whether the
turn order is valid and at which turn it first fails. Control characters inside roles and texts become escape codes, so
a control string inside a text can't be read as one, and reading back is exact.

Defined cases: turns go by turn, then role, then text, nulls first; a null text or role counts as empty; a row whose
conversation id is null is a conversation of its own (nothing says that two such rows belong together, and so their
number makes no large group); repeated turns are turns of their own and mostly break the order; an empty table gives an
empty result; other columns are not read. A conversation is one output string, so its turns meet in one task by nature;
conversations spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escape codes: the escape character first. Every character that opens a control string, or ends a header, has one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


@dataclass(frozen=True)
class Template:
    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    ends: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    """A backslash in escaped text always begins a code, so the codes can be undone one kind after the other, the
    escape character's own last."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _state(template: Template, state: Column, role: Column) -> Column:
    moves = [F.when((state == s) & (role == r), F.lit(to)) for (s, r), to in template.moves.items()]
    return F.coalesce(*moves, F.lit("invalid"))


def format_conversations(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:  # noqa: B008
    """One row a conversation: conv, n_turns, segments (array of text, loss), formatted, valid, bad_turn (position from
    0 of the first turn that the machine refuses, else null)."""
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = df.select(F.col(conv).alias(conv), own.alias("_turn"))
    grouped = rows.filter(F.col(conv).isNotNull()).groupBy(conv).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    grouped = grouped.unionByName(rows.filter(F.col(conv).isNull()).select(conv, F.array("_turn").alias("_turns")))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(template.open), escape(t["role"]), F.lit(template.after_role)), F.lit(False)),
            segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        )

    def step(acc: Column, t: Column) -> Column:
        to = _state(template, acc["state"], t["role"])
        bad = F.when(acc["bad"].isNotNull(), acc["bad"]).when(to == "invalid", acc["at"])
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"), bad.cast("int").alias("bad"))

    walked = F.aggregate("_turns", F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")), step)
    return (
        grouped.select(conv, F.size("_turns").cast("long").alias("n_turns"), F.flatten(F.transform("_turns", segments)).alias("segments"), walked.alias("_end"))
        .select(conv, "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("_end.state").isin(*template.ends).alias("valid"), F.col("_end.bad").alias("bad_turn"))
    )


def read_back(formatted: DataFrame, template: Template = Template(), column: str = "formatted") -> DataFrame:  # noqa: B008
    """formatted with `turns` (array of role, text), parsed from the output string alone."""
    raw = F.slice(F.split(F.col(column), "\\Q" + template.close + "\\E"), 1, F.size(F.split(F.col(column), "\\Q" + template.close + "\\E")) - 1)

    def turn(s: Column) -> Column:
        at = F.instr(s, template.after_role)
        return F.struct(
            unescape(F.substring(s, F.lit(len(template.open) + 1), at - 1 - len(template.open))).alias("role"),
            unescape(F.substring(s, at + len(template.after_role), F.length(s))).alias("text"),
        )

    return formatted.withColumn("turns", F.transform(raw, turn))


def summary(df: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the output."""
    back = read_back(format_conversations(df))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
