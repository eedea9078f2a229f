"""Chat turns as text segments with loss flags, from a declarative template; roles checked by a finite-state machine."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns are gathered in blocks of this many turn numbers, so that a giant conversation is spread over tasks.
BLOCK = 256
INVALID = "invalid"


@dataclass(frozen=True)
class Template:
    """How turns are written and which order of roles is right.

    A turn is ``open + label + sep + text + close``. ``labels`` names the roles; any other role is written as ``?``
    and its own escaped name. ``moves`` maps a state and a role to the next state; what it lacks leads to ``invalid``
    for good. ``learned`` roles have their text (not the markers) under the loss mask. Control strings inside texts are
    written as a backslash and a digit, a backslash as two.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    labels: Mapping[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
    )
    learned: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("###", "</turn>")
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "informed",
            ("informed", "tool"): "informed",
            ("informed", "assistant"): "answered",
        }
    )

    @property
    def states(self) -> list[str]:
        return sorted({self.start, INVALID, *self.moves.values(), *(s for s, _ in self.moves)})


def escape(text: Column, controls: tuple[str, ...]) -> Column:
    """No control string is left in the result; ``unescape`` undoes it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for i, control in enumerate(controls):
        text = F.replace(text, F.lit(control), F.lit(f"\\{i}"))
    return text


def unescape(text: Column, controls: tuple[str, ...]) -> Column:
    """Every run of backslashes starts a code, so pairs can be split off from the left."""

    def plain(piece: Column) -> Column:
        for i, control in enumerate(controls):
            piece = F.replace(piece, F.lit(f"\\{i}"), F.lit(control))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _names(t: Template) -> tuple[str, ...]:
    """Controls inside a role's name: the separator as well."""
    return (*t.controls, t.sep)


def _label(role: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for pair in t.labels.items() for x in pair])
    return F.coalesce(known[role], F.concat(F.lit("?"), escape(role, _names(t))))


def _moved(roles: Column, state: str, t: Template) -> Column:
    table = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}|{r}", to)])
    step = lambda at, role: F.coalesce(table[F.concat(at, F.lit("|"), role)], F.lit(INVALID))
    return F.aggregate(roles, F.lit(state), step)


def format_turns(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """Segments of text with loss flags: ``conv_id, block, segments array<struct<text, loss>>, moves``.

    ``turns`` has ``conv_id, turn, role, text``; more columns are ignored. A conversation's turns are ordered by turn
    (null first), then role and text; repeated rows are turns of their own; null role or text is empty; null
    ``conv_id`` is a conversation of its own. One row per conversation and block of ``BLOCK`` turn numbers: the
    segments of all blocks in order are the conversation. ``moves`` is what the block does to each state of the
    machine, so states can be followed through blocks without their texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    blank = F.struct("turn", role.alias("role"), text.alias("text"))
    blocks = (
        turns.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), blank.alias("t"))
        .groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    written = lambda x: F.array(
        segment(F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.sep)), F.lit(False)),
        segment(escape(x["text"], t.controls), x["role"].isin(*t.learned)),
        segment(F.lit(t.close), F.lit(False)),
    )
    roles = F.transform("turns", lambda x: x["role"])
    moves = F.create_map(*[x for s in t.states for x in (F.lit(s), _moved(roles, s, t))])
    return blocks.select(
        "conv_id", "block", F.flatten(F.transform("turns", written)).alias("segments"), moves.alias("moves")
    )


def validity(blocks: DataFrame, t: Template = Template()) -> DataFrame:
    """``conv_id, state, valid``: where the machine ends, and whether that is an accepting state."""
    ordered = F.sort_array(F.collect_list(F.struct("block", F.map_entries("moves").alias("moves"))))
    follow = lambda at, b: F.map_from_entries(b["moves"])[at]
    return (
        blocks.groupBy("conv_id").agg(ordered.alias("b"))
        .select("conv_id", F.aggregate("b", F.lit(t.start), follow).alias("state"))
        .withColumn("valid", F.col("state").isin(*t.accepting))
    )


def read_back(blocks: DataFrame, t: Template = Template()) -> DataFrame:
    """Parse formatted text into turns again: ``conv_id, block, chars, turns array<struct<role, text>>, learned``.

    ``chars`` is the length of the formatted text, ``learned`` the unescaped text under the loss mask.
    """
    names = F.create_map(*[F.lit(x) for role, label in t.labels.items() for x in (label, role)])

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(t.open) + 1, F.length(piece))
        label = F.substring_index(body, t.sep, 1)
        rest = F.substring(body, F.length(label) + len(t.sep) + 1, F.length(body))
        literal = unescape(F.substring(label, F.lit(2), F.length(label)), _names(t))
        role = F.when(label.startswith("?"), literal).otherwise(names[label])
        return F.struct(role.alias("role"), unescape(rest, t.controls).alias("text"))

    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t.controls))
    pieces = F.split("formatted", re.escape(t.close), -1)
    return (
        blocks.select("conv_id", "block", text.alias("formatted"), F.array_join(learned, "").alias("learned"))
        .withColumn("pieces", pieces)
        .select(
            "conv_id", "block", F.length("formatted").cast("long").alias("chars"), "learned",
            F.transform(F.slice("pieces", F.lit(1), F.size("pieces") - 1), turn).alias("turns"),
        )
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back, one row per conversation.

    A hash needs its conversation's whole text in one value; blocks are written out first, so that is all that meets.
    """
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    part = F.struct("block", F.array_join(turns, "").alias("turns"), "learned")
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
            F.sort_array(F.collect_list(part)).alias("parts"),
        )
        .select(
            "conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"),
            F.length(joined("learned")).cast("long").alias("loss_chars"),
            F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars",
        )
    )
