"""Repair of conversations by a Viterbi search over a grammar of roles.

A conversation should read ``(s?(ua)+)?`` by its roles' initials: nothing, or turns of a user and an
assistant, after a system row at most. Each row is kept (K), given the role of a user or assistant
(R) or deleted (D), and empty rows may be inserted (I) anywhere. A search goes forward over the
grammar's four states (nothing yet, after a system row, after a user, after an assistant), carries
the least (cost, edits) of each, and closes the layer before each row with the inserts, of which at
most two in a row can help. The edits of equal costs are compared as text. A shorter text never
begins a longer one of the same cost at the same row (inserts cost), so what is less stays less.

Long conversations are split: rows are dealt by ranges of (conversation, turn), so a range's task
holds one row at a time. A range that starts inside a conversation is searched from all four states;
the ranges' results, four by four, are joined in order as a product, and each range's best edits are
then applied to its rows. Only ``digests`` needs a conversation's rows in one task, where they
stream by; its hash is sequential.

Defined results: null texts and roles are one space, and a null turn sorts first; a null
conv_id is a conversation like any other; rows of equal turns are ordered by role and text, and rows
equal in all are copies, of which all but the first are duplicates; very long texts are never held
in the search, which sees a row's faults only; an empty table gives no rows; a conversation without
rows has nothing to edit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.shipping import ship
from .common import pick

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Parts over which the rows of a conversation are spread when repeated texts are marked.
SALTS = 8
#: Edits of a state beyond so many are put aside.
_LONG = 512

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow: the initial and the state after it.
_AFTER = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_SPACE = " \t\n\x0b\x0c\r"
_BLANK = r"^[\x20\x09-\x0D]*$"

#: Of each state None, or its least (cost, rank of the edits' head, the other edits, ...). All heads are equally long.
Best = list


def _less(a, b):
    return b if a is None or b is not None and b < a else a


def _then(x: tuple, cost: int, edit: str) -> tuple:
    return (x[0] + cost, x[1], x[2] + edit, *x[3:])


def start(state: int) -> Best:
    return [(0, 0, "") if s == state else None for s in range(4)]


def close(best: Best) -> Best:
    """With empty rows inserted: a user after anything but a user, an assistant after a user."""
    nothing, system, user, assistant = best
    for x in (nothing, system, assistant):
        if x is not None:
            user = _less(user, _then(x, INSERT, "I"))
    if user is not None:
        assistant = _less(assistant, _then(user, INSERT, "I"))
    return [nothing, system, user, assistant]


def step(best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    """The states after one more row."""
    after: Best = [None] * 4
    more = TRUNCATED if truncated else 0
    for state, x in enumerate(close(best)):
        if x is None:
            continue
        after[state] = _less(after[state], _then(x, DELETE, "D"))
        if must_go:
            continue
        for letter, to in _AFTER[state].items():
            if letter == initial:
                after[to] = _less(after[to], _then(x, more, "K"))
            elif letter != "s":
                after[to] = _less(after[to], _then(x, REROLE + more, "R"))
    return _without_hopeless(after)


def _without_hopeless(best: Best) -> Best:
    """Without states that cost more than others that can be continued alike.

    What follows a system row may follow an assistant; what follows nothing may follow an assistant
    too, if a system row that it keeps is deleted instead.
    """
    costs = [x[0] for x in (best[ASSISTANT],) if x] + [x[0] + INSERT for x in (best[USER],) if x]
    if costs:
        least = min(costs)
        if best[NOTHING] and best[NOTHING][0] > least + DELETE:
            best[NOTHING] = None
        if best[SYSTEM] and best[SYSTEM][0] > least:
            best[SYSTEM] = None
    return best


def settle(best: Best, heads: list) -> tuple[Best, list]:
    """Edits that have grown long move into the heads, of which only the order matters from then on.

    All states' edits are cut at the same place, so heads stay equally long, and comparing
    (rank of the head, the other edits) compares the whole.
    """
    at = min((len(x[2]) for x in best if x), default=0)
    if at < _LONG:
        return best, heads
    different = sorted({(x[1], x[2][:at]) for x in best if x})
    rank = {h: k for k, h in enumerate(different)}
    return [x and (x[0], rank[x[1], x[2][:at]], x[2][at:], *x[3:]) for x in best], [(heads[r], text) for r, text in different]


class Search:
    """A search over rows from one state; ``heads`` are chains of texts."""

    def __init__(self, state: int):
        self.best, self.heads = start(state), [None]

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        self.best, self.heads = settle(step(self.best, initial, must_go, truncated), self.heads)

    def whole(self) -> list:
        """(cost, edits) of each state."""
        out = []
        for x in self.best:
            texts, head = [x[2]] if x else [], self.heads[x[1]] if x else None
            while head:
                texts.append(head[1])
                head = head[0]
            out.append(x and (x[0], "".join(reversed(texts))))
        return out


def _least_ends(matrix: list, best: Best) -> Best:
    """The product: the least of each state, with the states at the ranges' starts, after one more range of (cost, edits)."""
    after: Best = [None] * 4
    for state, x in enumerate(best):
        if x is None or matrix[state] is None:
            continue
        for to, y in enumerate(matrix[state]):
            if y is not None:
                after[to] = _less(after[to], (*_then(x, *y)[:3], (x[3], state)))
    return after


# Damage and faults -----------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a hash of ``conv_id:turn``: rows dropped, emptied, cut, repeated or given to the user."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").withColumn("copies", F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode("copies").alias("copy")).drop("copy")


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in their order (``place``, and the ``part`` of them that a task holds), equal ones once with their number ``n``, and their faults.

    ``seen``: an earlier row has this role and text. The result is checkpointed; its partitions are the parts.
    """
    rows = pick(rows, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    once = once.withColumn("said", said).withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    repeated = once.groupBy("said").agg(F.min("when").alias("first"), F.count("*").alias("times")).filter("times > 1").select("said", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = once.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")).join(repeated, ["said", "salt"], "left")
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    marked = marked.select(
        "conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(_BLANK).alias("blank"),
        F.coalesce(F.col("first") < F.col("when"), F.lit(False)).alias("seen"), (~end.isin(".", "!", "?")).alias("open"),
    )
    dealt = marked.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 40)).sortWithinPartitions(*_order())
    return cut(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))


# Search over parts, and its product ------------------------------------------------------------

_PART = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())),
])
_PART_SQL = "conv_id long, part long, costs array<long>, edits array<string>, blank long, duplicate long, truncated long, illegal long, initials array<string>, turns array<long>"
_LEGAL = {"su", "ua", "au"}


def _rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, weight: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or chars >= weight:
            yield made(held)
            held, chars = [], 0
    if held:
        yield made(held)


class _Part:
    """A conversation's rows in one part: searches from each state it may start in, and counts."""

    def __init__(self, conv_id: int | None, part: int, states: Iterable[int]):
        self.key, self.searches = (conv_id, part), {s: Search(s) for s in states}
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initials: list[str] = []
        self.turns: list[int] = []  # first, last, number of different ones

    def add(self, turn: int | None, initial: str, blank: bool, seen: bool, open_: bool, n: int) -> None:
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        for copy in range(n):
            again = seen or copy > 0
            self.blank += blank
            self.duplicate += not blank and again
            cut_off = open_ and not blank and not again
            self.truncated += cut_off
            if self.initials:
                self.illegal += self.initials[1] + initial not in _LEGAL
            self.initials = [self.initials[0] if self.initials else initial, initial]
            for search in self.searches.values():
                search.row(initial, blank or again, cut_off)

    def row(self) -> tuple:
        ends = [self.searches[s].whole() if s in self.searches else [None] * 4 for s in range(4)]
        flat = [x for best in ends for x in best]
        return (*self.key, [x and x[0] for x in flat], [x and x[1] for x in flat], self.blank, self.duplicate, self.truncated, self.illegal, self.initials, self.turns)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple]:
        now = None
        for conv, part, turn, *faults in _rows(batches, "conv_id", "part", "turn", "initial", "blank", "seen", "open", "n"):
            if now is None or now.key != (conv, part):
                if now is not None:
                    yield now.row()
                # only a part's first conversation may have begun before it
                now = _Part(conv, part, range(4) if now is None else (NOTHING,))
            now.add(turn, *faults)
        if now is not None:
            yield now.row()

    yield from _batches(parts(), _PART)


_REPORT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ("pieces", pa.list_(pa.struct([("part", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))),
])
_REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, pieces array<struct<part: long, state: int, edits: string>>"


class _Whole:
    """A conversation's parts, joined in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.initial, self.turns = conv_id, [0, 0, 0, 0], None, []
        self.parts: list[tuple[int, list]] = []
        self.best = [x and (*x, None) for x in start(NOTHING)]

    def add(self, part: int, costs: list, edits: list, blank: int, duplicate: int, truncated: int, illegal: int, initials: list[str], turns: list[int]) -> None:
        matrix = [[(c, e) if c is not None else None for c, e in zip(costs[4 * s : 4 * s + 4], edits[4 * s : 4 * s + 4], strict=True)] for s in range(4)]
        self.parts.append((part, matrix))
        self.best, _ = settle(_without_hopeless(_least_ends(matrix, self.best)), [None] * 4)  # the texts are in the parts
        broken = self.initial is not None and self.initial + initials[0] not in _LEGAL
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal + broken), strict=True)]
        self.initial = initials[1]
        if turns:
            first, last, n = turns
            self.turns = [self.turns[0], last, self.turns[2] + n - (first == self.turns[1])] if self.turns else turns

    def row(self) -> tuple:
        ends = close([x and (*x[:3], (x[3], state)) for state, x in enumerate(self.best)])
        cost, _, edits, path = _less(ends[NOTHING], ends[ASSISTANT])
        last = edits[len(self.best[path[1]][2]) :]  # what is inserted at the end
        pieces = []
        for part, matrix in reversed(self.parts):
            to, path = path[1], path[0]
            pieces.append({"part": part, "state": path[1], "edits": matrix[path[1]][to][1]})
        pieces.reverse()
        pieces[-1]["edits"] += last
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (self.conv_id, gaps, *self.counts, cost, pieces)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def wholes() -> Iterator[tuple]:
        now = None
        for conv, *part in _rows(batches, *_PART.names):
            if now is None or now.conv_id != conv:
                if now is not None:
                    yield now.row()
                now = _Whole(conv)
            now.add(*part)
        if now is not None:
            yield now.row()

    yield from _batches(wholes(), _REPORT)


def search(faulty: DataFrame) -> DataFrame:
    """Of ``with_faults``' rows: a row per conversation with gaps, the faults' numbers, cost and ``pieces`` (part, state, edits)."""
    ship(faulty.sparkSession)
    parts = faulty.select("conv_id", "part", "turn", "initial", "blank", "seen", "open", "n").mapInArrow(_search, _PART_SQL)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join, _REPORT_SQL)


# Edits applied ---------------------------------------------------------------------------------

_REPAIRED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_REPAIRED_SQL = "conv_id long, part long, seq long, edit string, role string, text string"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's edits come first, then its rows."""

    def rows() -> Iterator[tuple]:
        state, edits, at, seq = NOTHING, "", 0, 0

        def inserted() -> Iterator[tuple]:
            nonlocal state, at, seq
            while at < len(edits) and edits[at] == "I":
                letter = "a" if state == USER else "u"
                state, at = _AFTER[state][letter], at + 1
                yield conv, part, seq, "I", "assistant" if letter == "a" else "user", ""
                seq += 1

        for conv, part, head, now, n, role, text in _rows(batches, "conv_id", "part", "edits", "state", "n", "role", "text"):
            if head is not None:
                state, edits, at, seq = now, head, 0, 0
                yield from inserted()
                continue
            for _ in range(n):
                edit, at = edits[at], at + 1
                if edit != "D":
                    letter = role[:1] if edit == "K" else "a" if state == USER else "u"
                    state = _AFTER[state][letter]
                    yield conv, part, seq, edit, role if edit == "K" else "assistant" if letter == "a" else "user", text
                    seq += 1
                yield from inserted()

    yield from _batches(rows(), _REPAIRED)


def apply_edits(faulty: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, part and seq (their order), edit (K, R or I), role, text."""
    heads = report.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", "p.part", F.lit(-1).cast("long").alias("place"), "p.edits", "p.state", F.lit(0).cast("long").alias("n"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = faulty.select("conv_id", "part", "place", F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("state"), "n", "role", "text")
    return heads.union(rows).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_edit, _REPAIRED_SQL)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of conversations (conv_id, turn, role, text); see ``search`` and ``apply_edits``."""
    faulty = with_faults(rows)
    report = cut(search(faulty))
    return report, apply_edits(faulty, report)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        begun, now, h = False, None, None
        for conv, role, text in _rows(batches, "conv_id", "role", "text"):
            line = f"{role}:{text}"
            if begun and conv == now:
                h.update(b"\n" + line.encode())
            else:
                if begun:
                    yield now, h.hexdigest()
                begun, now, h = True, conv, hashlib.sha256(line.encode())
        if begun:
            yield now, h.hexdigest()

    yield from _batches(rows(), _DIGEST)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of a conversation's ``role:text`` lines."""
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hash, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest: a row for every original conversation."""
    report, repaired = repair(damage(conversations))
    whole = report.withColumn("audit", F.array_join(F.transform("pieces", lambda p: p["edits"]), "")).drop("pieces")
    whole = whole.join(digests(repaired).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    ids = pick(conversations, "conv_id").select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
