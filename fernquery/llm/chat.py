"""Chat formatting: a finite-state machine over roles, and a template that is data.

Turns are formatted in order, one output row per segment: a mark of the template or a
text, each with its loss flag. Rows stream through sorted partitions with one
conversation's state at a time, so a conversation may be of any length. Texts are
escaped so that no control string of the template can occur in them, and the escape
can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a text of each role, which roles' texts are learnt, and which orders of roles are valid.

    ``turns[role] = (open, close)``; a role that is not listed is written between
    ``other`` marks, its name first. ``moves[state][role]`` is the next state.
    """

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    control: tuple[str, ...]
    loss: frozenset[str]
    moves: dict[str, dict[str, str]]
    start: str = "start"
    final: frozenset[str] = field(default_factory=frozenset)

    def pattern(self) -> re.Pattern:
        return re.compile(r"\\|" + "|".join(rf"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.control))


#: The marks of the default template.
INSTRUCT = Template(
    turns={"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")},
    other=("[ROLE] ", " [/ROLE] ", " [/TURN]"),
    control=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]"),
    loss=frozenset({"assistant"}),
    moves={"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "told"}, "told": {"user": "asked"}},
    final=frozenset({"told"}),
)


def escape(text: str, pattern: re.Pattern) -> str:
    """Double each backslash, and put one after the first character of each control string."""
    return pattern.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(turns: Iterable[tuple[str | None, str | None]], template: Template = INSTRUCT) -> Iterator[tuple[str | None, str, str, bool, bool]]:
    """``(role, kind, text, loss, valid)`` of one conversation's turns; kind is mark, text or end.

    valid is false from the first role that the state machine does not allow; the
    final ``end`` segment, empty, also tells whether the order is complete.
    """
    pattern, state, valid = template.pattern(), template.start, True
    for role, text in turns:
        valid = valid and role in template.moves.get(state, {})
        if valid:
            state = template.moves[state][role]
        text = escape(text or "", pattern)
        if role in template.turns:
            before, after = template.turns[role]
            yield role, "mark", before, False, valid
        else:
            before, between, after = template.other
            yield role, "mark", before + escape(role or "", pattern) + between, False, valid
        yield role, "text", text, role in template.loss, valid
        yield role, "mark", after, False, valid
    yield None, "end", "", False, valid and state in template.final


class Reader:
    """Takes the formatted text of one conversation piece by piece and finds its turns again."""

    def __init__(self, template: Template):
        self.template, self.waiting = template, ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.waiting += piece
        while (turn := self._turn()) is not None:
            yield turn

    def _turn(self) -> tuple[str, str] | None:
        for role, (before, after) in self.template.turns.items():
            if self.waiting.startswith(before):
                stop = self.waiting.find(after, len(before))
                if stop < 0:
                    return None
                text, self.waiting = self.waiting[len(before) : stop], self.waiting[stop + len(after) :]
                return role, unescape(text)
        before, between, after = self.template.other
        if self.waiting.startswith(before) and (middle := self.waiting.find(between, len(before))) >= 0:
            stop = self.waiting.find(after, middle + len(between))
            if stop >= 0:
                role, text = self.waiting[len(before) : middle], self.waiting[middle + len(between) : stop]
                self.waiting = self.waiting[stop + len(after) :]
                return unescape(role), unescape(text)
        return None


def _groups(batches: Iterable[pa.RecordBatch], key: str, names: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of equal ``key`` over sorted batches, lazily: a run is read as it is used."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in (key, *names))))
    for k, run in groupby(rows, key=lambda r: r[0]):
        yield k, (r[1:] for r in run)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_chats(turns: DataFrame, template: Template = INSTRUCT, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments ``(conv, seq, role, kind, text, loss, valid)`` of all conversations.

    Turns stand in the order of ``turn_col``, nulls first; rows of equal turn in the
    order of role and text, repeated rows included. A null text is empty; a null or
    unknown role breaks the order of roles but is formatted all the same; turns with a
    null id make one conversation. Conversations of invalid order are marked, not left
    out. Other columns are not looked at.
    """
    schema = pa.schema([("conv", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])

    def run(batches):
        def rows():
            for conv, own in _groups(batches, "conv", ["role", "text"]):
                for seq, segment in enumerate(segments(own, template)):
                    yield (conv, seq, *segment)

        yield from _batches(rows(), schema)

    named = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return named.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, "conv long, seq long, role string, kind string, text string, loss boolean, valid boolean")


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, from the formatted text alone and its loss mask.

    ``conv, n_turns, turns_sha256`` (role, newline, text, newline per turn), ``loss_chars,
    loss_sha256`` (text under the mask, unescaped), ``formatted_chars, valid``. Text
    that is no turn of the template raises ValueError.
    """
    schema = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches):
        def rows():
            for conv, own in _groups(batches, "conv", ["text", "loss", "valid"]):
                reader, turns, masked, n, learnt, chars, ok = Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                for text, loss, valid in own:
                    chars, ok = chars + len(text), valid
                    if loss:
                        plain = unescape(text)
                        learnt += len(plain)
                        masked.update(plain.encode())
                    for role, found in reader.feed(text):
                        n += 1
                        turns.update(f"{role}\n{found}\n".encode())
                if reader.waiting:
                    raise ValueError(f"conversation {conv}: {reader.waiting[:80]!r} is no turn")
                yield conv, n, turns.hexdigest(), learnt, masked.hexdigest(), chars, ok

        yield from _batches(rows(), schema)

    return formatted.select("conv", "seq", "text", "loss", "valid").repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
