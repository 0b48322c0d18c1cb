"""Chat formatting by a declarative template, in DataFrame operations alone.

Roles drive a finite-state machine that checks the order of turns. Each turn
gives text segments with a loss flag; control strings inside texts are escaped
reversibly, so turns can be read back from the formatted string.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

REJECT = "reject"


@dataclass(frozen=True)
class ChatTemplate:
    """``turns``: the opening and closing control string of each role; any other role is
    written between ``other[0]`` and ``other[1]`` and its text closed by ``other[2]``.
    ``moves``: state to role to next state; a missing move rejects. All control strings
    start with a character that occurs in none of them again."""

    begin: str = "<s>"
    turns: Mapping[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({self.begin, *(s for pair in self.turns.values() for s in pair), *self.other}, key=lambda s: (-len(s), s))


DEFAULT_TEMPLATE = ChatTemplate()


def escape(text: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """Doubles backslashes, then parts each control string by one after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls():
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _is(role: Column, template: ChatTemplate, named, other: Column) -> Column:
    out = None
    for name, marks in template.turns.items():
        out = (F if out is None else out).when(role == name, F.lit(named(marks)))
    return out.otherwise(other)


def turn_segments(role: Column, text: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """The three segments of a turn: opening, escaped text, closing. Loss lies on the text
    of a loss role alone."""
    head, middle, tail = template.other
    opening = _is(role, template, lambda m: m[0], F.concat(F.lit(head), escape(role, template), F.lit(middle)))
    closing = _is(role, template, lambda m: m[1], F.lit(tail))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    return F.array(segment(opening, F.lit(False)), segment(escape(text, template), role.isin(*template.loss_roles)), segment(closing, F.lit(False)))


def format_conversations(turns: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = 64) -> DataFrame:
    """One row a conversation: ``conv_id``, ``segments`` (array of text and loss flag),
    ``formatted`` (the segments' texts joined), ``state`` (where the machine ends) and
    ``valid`` (it ends in a final state).

    Turns go by number; equal numbers go by role, then text; a null number goes first.
    A null text or role is empty. Repeated rows are turns of their own. A conversation with
    a null id is one conversation. Conversations out of order are formatted too, with
    ``valid`` false. Other columns do not pass through. An empty table gives none.

    A conversation is gathered in two steps: blocks of ``block_turns`` turn numbers, each
    with the machine's map from state to state over the block, then the blocks in order.
    So all work on a turn is spread, also where one conversation holds very many; only the
    finished row of such a conversation, which is the result, comes together in one place.
    """
    states = ["start", *[s for s in template.moves if s != "start"]]
    states += sorted({to for row in template.moves.values() for to in row.values()} - set(states)) + [REJECT]
    moves = {f"{s}\n{role}": to for s, row in template.moves.items() for role, to in row.items()}
    move = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])
    known = F.array(*[F.lit(s) for s in states])

    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / block_turns))
    rows = rows.select("conv", "block", F.struct("turn", "role", "text", turn_segments(F.col("role"), F.col("text"), template).alias("segments")).alias("t"))
    blocks = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ends = F.transform(
        known,
        lambda start: F.aggregate(F.col("ts"), start, lambda at, t: F.coalesce(F.try_element_at(move, F.concat(at, F.lit("\n"), t["role"])), F.lit(REJECT))),
    )
    blocks = blocks.select("conv", F.struct("block", ends.alias("ends"), F.flatten(F.transform("ts", lambda t: t["segments"])).alias("segments")).alias("b"))
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    out = whole.select(
        F.col("conv").alias("conv_id"),
        F.concat(begin, F.flatten(F.transform("bs", lambda b: b["segments"]))).alias("segments"),
        F.aggregate(F.col("bs"), F.lit("start"), lambda at, b: F.element_at(b["ends"], F.array_position(known, at).cast("int"))).alias("state"),
    )
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.final).alias("valid"))


def read_turns(formatted: Column, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """Array of (role, text), read back from a formatted string."""
    head, middle, tail = map(re.escape, template.other)
    opening = "|".join([*(re.escape(o) for o, _ in template.turns.values()), f"{head}.*?{middle}"])
    closing = "|".join([*(re.escape(c) for _, c in template.turns.values()), tail])
    pattern = F.lit(f"(?s)({opening})(.*?)({closing})")
    pairs = F.arrays_zip(F.regexp_extract_all(formatted, pattern, 1).alias("o"), F.regexp_extract_all(formatted, pattern, 2).alias("t"))

    def role(o: Column) -> Column:
        free = unescape(F.substring(o, len(template.other[0]) + 1, F.length(o) - len(template.other[0]) - len(template.other[1])))
        out = None
        for name, marks in template.turns.items():
            out = (F if out is None else out).when(o == marks[0], F.lit(name))
        return out.otherwise(free)

    return F.transform(pairs, lambda p: F.struct(role(p["o"]).alias("role"), unescape(p["t"]).alias("text")))
