"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. The automaton of
all items' word sequences is walked with each document's words; it gives at every word the
length of the longest match that ends there. A match of a full window (``window`` words, or a
whole shorter item) is a leak: its words are hit and its items known.

Broadcast: the automaton of one block of items, of at most ``block_words`` words in all. A larger
benchmark is walked in passes, a block each, and what a pass found is written out before the next
one's automaton is made, so driver and executors hold one block's at a time.

Defined results: null and empty texts have no words; an item without words matches nothing; an
item with a null id hits words and is listed as "null"; items that share an id count as one; a
repeated document gives its result again; a very long text is walked word by word, whole; without
documents there are no rows, without items nothing is hit; other columns, whatever their names, are
ignored, or kept by ``remove_leaks``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.shipping import ship
from .common import pick

WINDOW = 10
#: Words of the items in one automaton, at most (one longer item is a block by itself).
BLOCK_WORDS = 200_000

#: Byte -> itself in lower case if it belongs to a word, else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of several word sequences, and where windows end."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.window = window
        ends: list[tuple[int, int, str]] = []
        for item, words in items:
            state = 0
            for i, w in enumerate(words, 1):
                state = self._extend(state, w)
                if i >= window or i == len(words):
                    ends.append((state, min(i, window), item))
        # A window's words are the suffix of that many words of a state; a state is split by later
        # items, so its place is looked up when all are in.
        self.short: list[dict[int, set[str]] | None] = [None] * len(self.next)
        for state, n, item in ends:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            marks = self.short[state] = self.short[state] or {}
            marks.setdefault(n, set()).add(item)
        #: Words of the shortest window.
        self.least = min((n for marks in self.short if marks for n in marks), default=1)
        # The nearest state with windows on the way to the root, itself included.
        self.near = array("i", [0]) * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[v] = v if self.short[v] else self.near[self.link[v]]

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of p's longest string and w, parted from q, which also holds longer ones."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def windows(self, state: int, length: int) -> Iterator[tuple[int, set[str]]]:
        """The windows (words, ids) that end in a match of this length in this state."""
        v = self.near[state]
        while v:
            for n, ids in self.short[v].items():
                if n <= length:
                    yield n, ids
            v = self.near[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end), merged, and the ids of the items met."""
        step, link, lengths, near = self.next, self.link, self.length, self.near
        least = self.least
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = 0
        seen: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            after = step[state].get(w)
            if after is None:
                while state and after is None:
                    state = link[state]
                    after = step[state].get(w)
                if after is None:
                    length = 0
                    continue
                length = lengths[state] + 1
            else:
                length += 1
            state = after
            if length >= least and near[state]:
                most = 0
                for n, ids in self.windows(state, length):
                    most = max(most, n)
                    if (state, n) not in seen:
                        seen.add((state, n))
                        items |= ids
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, in blocks; they reach the driver one partition at a time."""
    held, n = [], 0
    for r in pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").toLocalIterator():
        if words := words_of((r["text"] or "").encode()):
            if held and n + len(words) > block_words:
                yield held
                held, n = [], 0
            held.append((r["i"], words))
            n += len(words)
    if held:
        yield held


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("text", pa.binary())])
_HITS_DDL = "doc_id long, n_words long, spans array<array<long>>, items array<string>"


def _passes(df: DataFrame, benchmark: DataFrame, window: int, block_words: int, step: Callable) -> DataFrame:
    """``step(df, automaton, last)`` for each block of items in turn; what it gives is written out in between."""
    ship(df.sparkSession)
    sc, blocks = df.sparkSession.sparkContext, _blocks(benchmark, block_words)
    block = next(blocks, [])
    while True:
        held, block = sc.broadcast(SuffixAutomaton(block, window)), next(blocks, None)
        df = step(df, held, block is None)
        if block is None:
            return df
        df = cut(df)
        held.destroy()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words (array of [start, end)), items (ids, sorted)."""

    def step(df: DataFrame, automaton, last: bool) -> DataFrame:
        wanted = len(_HITS) - last  # the text goes along until the last pass

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    n_words, all_spans, all_items = [], [], []
                    for text, spans, items in zip(*(b.column(i).to_pylist() for i in (4, 2, 3)), strict=True):
                        words = words_of(text or b"")
                        more, ids = automaton.value.scan(words)
                        n_words.append(len(words))
                        all_spans.append([list(s) for s in (_merged([*map(tuple, spans), *more]) if spans else more)])
                        all_items.append(sorted(ids | set(items)))
                    found = [pa.array(x, f.type) for x, f in zip((n_words, all_spans, all_items), list(_HITS)[1:4], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), *found, b.column(4)][:wanted], schema=pa.schema(list(_HITS)[:wanted]))

        return df.mapInArrow(run, _HITS_DDL + ("" if last else ", text binary"))

    read = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    none = F.array().cast("array<array<long>>"), F.array().cast("array<string>")
    read = read.select("doc_id", F.lit(0).cast("long").alias("n_words"), none[0].alias("spans"), none[1].alias("items"), "text")
    return _passes(read, benchmark, window, block_words, step)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words; what stood before and after stays, a line break between."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    out.append(text[end:])
    return b"\n".join(out)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without leaked spans; documents go of whose words more than the share ``max_coverage`` would be cut.

    Keeps all columns; ``text`` and, if it is there, ``n_chars`` are rewritten where a span was cut.
    Cutting is repeated until no window is left, since what remains can join to one; the share counts
    the words of all cuts. With several blocks of items, passes are repeated until none cuts.
    """
    names, fields = docs.columns, docs.schema.fields
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    # By position, and with the words there were and the words cut so far.
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    flat = flat.select("*", F.lit(-1).cast("long").alias("words"), F.lit(0).cast("long").alias("gone"))

    def step(df: DataFrame, automaton, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = automaton.value.scan
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    columns = list(b.columns)
                    texts, before, gone = (columns[i].to_pylist() for i in (at_text, -2, -1))
                    chars = columns[at_chars].to_pylist() if at_chars >= 0 else None
                    keep, changed = [], False
                    for i, text in enumerate(texts):
                        raw, hit = (text or "").encode(), False
                        words = words_of(raw)
                        before[i] = len(words) if before[i] < 0 else before[i]
                        spans, _ = scan(words)
                        while spans:
                            gone[i] += sum(e - a for a, e in spans)
                            if gone[i] > max_coverage * before[i]:
                                break
                            raw, hit = cut_spans(raw, spans), True
                            spans, _ = scan(words_of(raw))
                        keep.append(not spans)
                        if hit:
                            texts[i], changed = raw.decode(), True
                            if chars:
                                chars[i] = len(texts[i])
                    if changed:
                        columns[at_text] = pa.array(texts, columns[at_text].type)
                        if chars:
                            columns[at_chars] = pa.array(chars, columns[at_chars].type)
                    columns[-2:] = pa.array(before, pa.int64()), pa.array(gone, pa.int64())
                    yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

        return df.mapInArrow(run, flat.schema)

    blocks = _blocks(benchmark, block_words)
    several = next(blocks, None) is not None and next(blocks, None) is not None
    out = _passes(flat, benchmark, window, block_words, step)
    while several:  # a later block's cut can join what an earlier one looks for
        before = out = cut(out)
        total = before.agg(F.sum("gone")).first()[0]
        out = cut(_passes(before, benchmark, window, block_words, step))
        several = out.agg(F.sum("gone"), F.count("*")).first() != (total, before.count())
    return out.select(*[f"c{i}" for i in range(len(fields))]).toDF(*names)


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``find_leaks`` with counts and a digest of the items instead of lists."""
    found = find_leaks(docs, benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
