"""Conversations to training text by a declarative template, with loss flags, in DataFrame functions only.

A template names the marks around each role's text and whether its text is learned. A finite-state machine, a table of (state, role) to
state, judges the order of turns. A mark that occurs inside a text gets a backslash behind its first character, and one more if it has some
there already, so no text holds a mark and taking one backslash away restores it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import text_or_empty


@dataclass(frozen=True)
class Marks:
    """What stands before and after a text of a role, and whether the text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role. A turn of another role has its role between ``role`` marks, and its text between ``other`` ones.

    Every mark starts with a punctuation mark; opening marks differ from each other. ``moves`` gives the state after a turn, by
    state and role; a conversation is valid that starts at ``start``, has a move for every turn and ends in a state of ``ends``.
    """

    begin: str = "<s>"
    roles: dict[str, Marks] = field(default_factory=lambda: {"system": Marks("[SYS]", "[/SYS]"), "user": Marks("[INST]", "[/INST]"), "assistant": Marks("[OUT]", "</s>", True)})
    role: Marks = Marks("[ROLE]", "[/ROLE]")
    other: Marks = Marks("[TURN]", "[/TURN]")
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    ends: tuple[str, ...] = ("answered",)

    def marks(self) -> list[str]:
        pairs = [*self.roles.values(), self.role, self.other]
        return list(dict.fromkeys([self.begin, *(m for p in pairs for m in (p.open, p.close))]))


def _quote(x: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", x)


def mark_patterns(template: Template) -> list[str]:
    """By first character, the marks with any backslashes behind it, in groups of these three parts."""
    return [rf"({_quote(first)})(\\*)({'|'.join(_quote(m[1:]) for m in template.marks() if m[0] == first)})" for first in dict.fromkeys(m[0] for m in template.marks())]


def escape(text: Column, template: Template) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, F.lit(p), F.lit(r"$1$2\\$3")), mark_patterns(template), text)


def unescape(text: Column, template: Template) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, F.lit(p.replace(r"(\\*)", r"(\\*)\\")), F.lit("$1$2$3")), mark_patterns(template), text)


def _segments(turn: Column, template: Template) -> Column:
    text, role = escape(turn["text"], template), turn["role"]
    piece = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    around = lambda m, *before: F.array(piece(F.concat(*before, F.lit(m.open)), False), piece(text, m.loss), piece(F.lit(m.close), False))
    out = around(template.other, F.lit(template.role.open), escape(role, template), F.lit(template.role.close))
    for name, marks in template.roles.items():
        out = F.when(role == name, around(marks)).otherwise(out)
    return out


def turn_order(roles: Column, template: Template) -> Column:
    """The place of the first turn (from 1) that has no move; one more than there are if the last state is no end; else 0."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    seen = F.struct(F.lit(template.start).alias("state"), F.lit(1).alias("at"), F.lit(0).alias("bad"))

    def step(x: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(x["state"], F.lit("\n"), role))
        return F.struct(F.coalesce(to, x["state"]).alias("state"), (x["at"] + 1).alias("at"), F.when((x["bad"] == 0) & to.isNull(), x["at"]).otherwise(x["bad"]).alias("bad"))

    return F.aggregate(roles, seen, step, lambda x: F.when((x["bad"] == 0) & ~x["state"].isin(*template.ends), x["at"]).otherwise(x["bad"]))


def format_chats(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, n_turns, segments (text, loss), formatted, bad_turn, valid.

    ``formatted`` is the texts of ``segments`` in order; only texts of roles with a loss flag are learned, not their marks. ``bad_turn`` is what
    ``turn_order`` says, and ``valid`` is that it is 0. Invalid conversations are formatted all the same.

    Turns go by ``turn``, nulls first, and at ties by role and text; repeated rows are repeated turns. A null role or text is empty; rows with
    a null conv_id are one conversation. Other columns are not read, so none can clash. Texts are taken whole; a conversation is one string, so it
    has to fit in one. An empty table gives no rows.
    """
    own = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), text_or_empty(F.col(role)).alias("role"), text_or_empty(F.col(text)).alias("text")).alias("t"))
    held = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    made = held.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.concat(begin, F.flatten(F.transform("t", lambda x: _segments(x, template)))).alias("segments"), turn_order(F.transform("t", lambda x: x["role"]), template).alias("bad_turn"))
    return made.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "bad_turn", (F.col("bad_turn") == 0).alias("valid"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    opens = {m.open: name for name, m in template.roles.items()} | {template.other.open: None}
    closes = list(dict.fromkeys([*(m.close for m in template.roles.values()), template.other.close]))
    one_of = lambda x: "|".join(map(_quote, x))
    pattern = rf"(?s)(?:{_quote(template.role.open)}(.*?){_quote(template.role.close)})?({one_of(opens)})(.*?)(?:{one_of(closes)})"
    group = lambda i: F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i))
    named = F.create_map(*[F.lit(x) for mark, name in opens.items() if name is not None for x in (mark, name)])
    roles = F.zip_with(group(1), group(2), lambda r, mark: F.coalesce(F.try_element_at(named, mark), unescape(r, template)))
    return F.zip_with(roles, group(3), lambda r, t: F.struct(r.alias("role"), unescape(t, template).alias("text")))


def learned(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, as it was before it was formatted."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"], template)), "")
