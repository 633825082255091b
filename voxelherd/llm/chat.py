"""Chat formatting with DataFrame functions only.

A declarative template names the markers, the roles under the loss and the turns that
may follow each other. Turns of a conversation are checked by a finite-state machine
over roles and rendered as text segments, each with a loss flag. Control strings inside
texts are escaped so that the output can be read back exactly.

Defined results: a null role or text is empty; a null conversation id is a conversation
of its own; turns are ordered by (turn, role, text), null first, so ties and repeated
rows have one order and all stay; conversations that break the turn order are formatted
all the same and carry ``valid = false`` with ``bad_turn``, the first offending place
counted from 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKSLASH = "\\"


@dataclass(frozen=True)
class Template:
    """Markers of a turn, roles that are learned, and which role may follow which."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    # Role before ("" at the start) to the roles that may come next.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """Text in which no control string starts; every backslash opens a two-character code."""
    out = F.replace(text, F.lit(BACKSLASH), F.lit(BACKSLASH + "s"))
    return F.replace(out, F.lit("<|"), F.lit("<" + BACKSLASH + "p"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    out = F.replace(text, F.lit(BACKSLASH + "p"), F.lit("|"))
    return F.replace(out, F.lit(BACKSLASH + "s"), F.lit(BACKSLASH))


def escape_role(role: Column) -> Column:
    """A role is also kept on one line, as the line break ends it."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BACKSLASH + "n"))


def unescape_role(role: Column) -> Column:
    """Inverse of :func:`escape_role`."""
    return unescape(F.replace(role, F.lit(BACKSLASH + "n"), F.lit("\n")))


def _allowed(before: Column, role: Column, template: Template) -> Column:
    steps = [(before == a) & role.isin(*b) for a, b in template.follows.items()]
    return reduce(lambda a, b: a | b, steps, F.lit(False))


def check_turns(turns: Column, template: Template = CHATML) -> Column:
    """State of the machine after all turns: ``role``, ``at`` (place), ``bad`` (first bad place or 0)."""
    start = F.struct(F.lit("").alias("role"), F.lit(0).alias("at"), F.lit(0).alias("bad"))

    def step(state: Column, turn: Column) -> Column:
        at = state["at"] + 1
        ok = _allowed(state["role"], turn["role"], template)
        bad = F.when((state["bad"] == 0) & ~ok, at).otherwise(state["bad"])
        return F.struct(turn["role"].alias("role"), at.alias("at"), bad.alias("bad"))

    return F.aggregate(turns, start, step)


def _segments(turns: Column, template: Template) -> Column:
    """Three segments a turn: opening marker with role, text, closing marker."""

    def render(turn: Column) -> Column:
        head = F.concat(F.lit(template.start), escape_role(turn["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, render))


def format_chats(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per ``conv_id``: ``segments`` (text, loss), ``formatted``, ``valid``, ``bad_turn``.

    A conversation is one training example and so one row; its turns meet in one place
    by its id alone, the only shuffle of the operator.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("row"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    state = check_turns(F.col("turns"), template)
    made = chats.select("conv_id", _segments(F.col("turns"), template).alias("segments"), state.alias("state"))
    bad = F.col("state")["bad"]
    unfinished = ~F.col("state")["role"].isin(*template.final)
    bad_turn = F.when(bad > 0, bad).when(unfinished, F.col("state")["at"])
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        bad_turn.isNull().alias("valid"),
        bad_turn.cast("int").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.split(formatted, "\\Q" + template.start + "\\E", -1)
    bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def parse(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        begin = F.length(role) + 2
        size = F.length(body) - F.length(role) - 1 - len(template.end)
        return F.struct(
            unescape_role(role).alias("role"), unescape(F.substring(body, begin, size)).alias("text")
        )

    return F.transform(bodies, parse)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")
