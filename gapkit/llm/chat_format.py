"""Chat formatting by a finite-state machine over roles and a declarative template, in built-in functions only.

A template names the roles with their labels and whether their texts are learned, the strings that open and close a turn,
and the moves of the machine: (state, role) leads to a state. A conversation's turns, in order, go through the machine, and each
gives three segments with a loss flag: header, text, end of turn.

Texts are escaped reversibly. A backslash is doubled, and a control string gets a backslash after its first character, so no
text of any user holds a control string when formatted, and a formatted conversation is read back by splitting at the plain end
of a turn. The template is refused if control strings could overlap with each other or with what surrounds a text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.llm.fingerprint import let

START = "start"
_OTHER = "x"  # labels of roles the template lacks: x and the role's bytes in hexadecimal


@dataclass(frozen=True)
class Role:
    label: str
    learned: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """``open label mid text close`` is a turn. ``moves`` are those of the machine, which begins in ``start``; ``ends`` are the
    states in which a conversation may end. Roles that ``roles`` lacks are formatted under a label of their own and never learned."""

    roles: Mapping[str, Role] = field(default_factory=lambda: {
        "system": Role("System"), "user": Role("User"), "assistant": Role("Assistant", learned=True), "tool": Role("Tool")})
    moves: Mapping[tuple[str, str], str] = field(default_factory=lambda: {
        (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
        ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "tool"): "tool", ("tool", "assistant"): "assistant"})
    ends: tuple[str, ...] = ("assistant",)
    open: str = "### "
    mid: str = ": "
    close: str = "</turn>"
    after: str = "\n"

    def __post_init__(self):
        labels = [r.label for r in self.roles.values()]
        if len(set(labels)) < len(labels) or any(re.fullmatch(f"{_OTHER}[0-9A-F]*", x) or self.mid in x + self.mid[:-1] for x in labels):
            raise ValueError("labels differ, hold no separator, and are not of the form kept for other roles")
        control = (self.open, self.close)
        around = [*control, *(x + self.mid for x in ("", *labels, _OTHER)), self.close + self.after]
        if any(len(c) < 2 or "\\" in c for c in control) or self.open in self.close or self.close in self.open:
            raise ValueError("control strings have two characters at least, no backslash, and do not hold one another")
        if any(c in x + self.mid for x in labels for c in control) or any(
                c.startswith(text[i:]) for text in around for c in control for i in range(1, len(text))):
            raise ValueError("a control string could begin in another one or in what surrounds a text")


def escaped(text: Column, t: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (t.open, t.close):
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    """A backslash goes and leaves what follows it; the pattern has no repeats, so texts may be of any length."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _label(role: Column, t: ChatTemplate) -> Column:
    names = F.create_map(*[F.lit(x) for name, r in t.roles.items() for x in (name, r.label)])
    return F.coalesce(F.try_element_at(names, role), F.concat(F.lit(_OTHER), F.hex(role.cast("binary"))))


def _role(label: Column, t: ChatTemplate) -> Column:
    names = F.create_map(*[F.lit(x) for name, r in t.roles.items() for x in (r.label, name)])
    return F.coalesce(F.try_element_at(names, label), F.decode(F.unhex(F.substring(label, 2, 1 << 30)), "UTF-8"))


def segments(turns: Column, t: ChatTemplate) -> Column:
    """``text, loss`` of all segments of an array of ``role, text``."""

    def three(x: Column) -> Column:
        learned = x["role"].isin([name for name, r in t.roles.items() if r.learned])
        parts = ((F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.mid)), F.lit(False)), (escaped(x["text"], t), learned),
                 (F.lit(t.close + t.after), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    return F.flatten(F.transform(turns, three))


def checked(turns: Column, t: ChatTemplate) -> Column:
    """The machine's last state and the place, from 0, of the first turn it has no move for; null if it has one for all."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        return let(F.try_element_at(moves, F.concat_ws("\n", s["state"], x["role"])), lambda to: F.struct(
            F.coalesce(to, s["state"]).alias("state"), (s["n"] + 1).alias("n"),
            F.coalesce(s["bad"], F.when(to.isNull(), s["n"])).alias("bad")))

    return F.aggregate(turns, start, step, lambda s: F.struct(s["state"].alias("state"), s["bad"].alias("bad")))


def read_turns(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """``role, text`` of each turn, from a formatted conversation."""
    t = template
    pieces = F.filter(F.split(text, re.escape(t.close + t.after), -1), lambda x: x != "")

    def read(piece: Column) -> Column:
        head = F.substring_index(piece, t.mid, 1)
        body = F.substring(piece, F.char_length(head) + len(t.mid) + 1, F.char_length(piece))
        return F.struct(_role(F.substring(head, F.lit(len(t.open) + 1), F.char_length(head)), t).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, read)


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(F.filter(parts, lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")


def formatted(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conv_id, n_turns, segments, formatted, valid, bad_turn`` for each ``conv_id`` of ``conversations`` (``conv_id, turn, role,
    text``; other columns are left alone).

    Turns go by ``turn``, null first, ties by role and text; repeated rows are turns like others. A null text is empty, a null role
    is the empty one; roles the template lacks are kept under a label of their own. Rows without ``conv_id`` are one conversation.
    Conversations the machine refuses are formatted as well: ``valid`` is false and ``bad_turn`` the place of the first turn
    without a move, or null if only the end is missing. An empty table gives no rows.

    A conversation is one training example and one row, formed in one task from one shuffle; so it may take what one value of
    Spark may, 2 GB. Nothing in it is quadratic in turns or in characters.
    """
    t = template
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    read = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments(F.col("turns"), t).alias("segments"),
                        checked(F.col("turns"), t).alias("machine"))
    return read.select(
        "conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        (F.col("machine.bad").isNull() & F.col("machine.state").isin(*t.ends)).alias("valid"), F.col("machine.bad").alias("bad_turn"))
