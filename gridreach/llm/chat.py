"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are written as text segments with a loss flag each. Control
strings inside texts are escaped with a backslash, so the output can be read back.

Rows flow sorted by (conv_id, turn) through a streaming fold: a conversation is never
held in memory, however long it is.

Defined results: a null text or role is empty; equal turn numbers are ordered by role,
then text; repeated rows are turns of their own; null conv_ids form one conversation; an
empty table gives no rows; a conversation that breaks the turn order is formatted all the
same and marked invalid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import pick


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around a turn's text, by role, and which texts bear loss.

    ``turns``: role -> (opening, closing, loss). Any other role is written by ``other``:
    (opening, between role and text, closing), without loss.
    ``order``: state -> {role: next state}; conversations start in ``start`` and may end
    in ``accepting`` states. ``controls`` are escaped wherever a text or role holds them.
    """

    bos: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]\n", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("[ANS] ", " [/ANS]</s>", True),
    })
    other: tuple[str, str, str] = ("[ROLE] ", " [MSG] ", " [/MSG]\n")
    controls: tuple[str, ...] = (
        "<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[MSG]", "[/MSG]",
    )
    start: str = "start"
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accepting: tuple[str, ...] = ("answered",)

    def special(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *self.controls])))


class Writer:
    """Writes one conversation turn by turn, following the state machine."""

    def __init__(self, template: ChatTemplate):
        self.t, self.special = template, template.special()
        self.state, self.begun = template.start, False

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: "\\" + m[0], text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments (text, loss); moves the state, to None once the order is broken."""
        self.state = self.t.order.get(self.state, {}).get(role)
        if role in self.t.turns:
            opening, closing, loss = self.t.turns[role]
        else:
            (first, between, closing), loss = self.t.other, False
            opening = first + self.escape(role) + between
        if not self.begun:
            self.begun, opening = True, self.t.bos + opening
        return [(opening, False), (self.escape(text), loss), (closing, False)]

    def valid(self) -> bool:
        return self.state in self.t.accepting


class Reader:
    """Reads formatted text back, piece by piece; keeps no more than a turn."""

    def __init__(self, template: ChatTemplate):
        self.t = template
        self.escaped = re.compile(r"\\(" + template.special().pattern + ")")
        self.buffer, self.begun = "", False

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1], text)

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that are complete with this piece."""
        self.buffer += piece
        if not self.begun and self.buffer.startswith(self.t.bos):
            self.buffer, self.begun = self.buffer[len(self.t.bos):], True
        while turn := self._turn():
            yield turn

    def _turn(self) -> tuple[str, str] | None:
        for role, (opening, closing, _) in self.t.turns.items():
            if self.buffer.startswith(opening):
                end = self.buffer.find(closing, len(opening))
                if end < 0:
                    return None
                text, self.buffer = self.buffer[len(opening):end], self.buffer[end + len(closing):]
                return role, self.unescape(text)
        opening, between, closing = self.t.other
        if self.buffer.startswith(opening):
            middle = self.buffer.find(between, len(opening))
            end = self.buffer.find(closing, middle + len(between)) if middle >= 0 else -1
            if end < 0:
                return None
            role, text = self.buffer[len(opening):middle], self.buffer[middle + len(between):end]
            self.buffer = self.buffer[end + len(closing):]
            return self.unescape(role), self.unescape(text)
        return None


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_SEGMENTS_SQL = "conv_id long, seq long, segment string, loss boolean, valid boolean"


def _rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or weight >= chars:
            yield made()
            held, weight = [], 0
    if held:
        yield made()


def format_segments(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per text segment: conv_id, seq (place in the conversation), segment, loss, valid.

    ``valid`` is false from the first turn that breaks the order onwards, and on the last
    closing segment of a conversation that doesn't end in an accepting state.
    The partitions hold whole conversations, sorted by (conv_id, seq).
    """
    ship(conversations.sparkSession)
    template = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[tuple]:
            writer, now, seq, last = None, None, 0, None
            for conv, role, text in _rows(batches, "conv_id", "role", "text"):
                if writer is None or conv != now:
                    if last:
                        yield (*last[:4], writer.valid())
                    writer, now, seq, last = Writer(template), conv, 0, None
                if last:
                    yield last
                pieces = writer.turn(role, text)
                for piece, loss in pieces[:-1]:
                    yield conv, seq, piece, loss, writer.state is not None
                    seq += 1
                last = (conv, seq, *pieces[-1], writer.state is not None)  # its validity is known with the next row
                seq += 1
            if last:
                yield (*last[:4], writer.valid())

        yield from _batches(segments(), _SEGMENTS)

    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, _SEGMENTS_SQL)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()),
])
_DIGEST_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digest(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Reads ``format_segments``' output back: a row per conversation with counts and digests.

    Needs the rows as that function leaves them: whole conversations in a partition, in order.
    """
    template = template or ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            begun, now = False, None
            for conv, piece, loss, ok in _rows(batches, "conv_id", "segment", "loss", "valid"):
                if not begun or conv != now:
                    if begun:
                        yield now, n, turns.hexdigest(), lost, losses.hexdigest(), chars, valid
                    begun, now, reader = True, conv, Reader(template)
                    n, lost, chars, valid, turns, losses = 0, 0, 0, True, hashlib.sha256(), hashlib.sha256()
                chars += len(piece)
                valid = valid and ok
                if loss:
                    plain = reader.unescape(piece)
                    lost += len(plain)
                    losses.update(plain.encode())
                for role, text in reader.feed(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
            if begun:
                yield now, n, turns.hexdigest(), lost, losses.hexdigest(), chars, valid

        yield from _batches(rows(), _DIGEST)

    return segments.mapInArrow(run, _DIGEST_SQL)
