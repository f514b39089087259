"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links and, for each node, the number of tokens that are
popped when its link is taken. Walking a word's characters once then gives how many pieces
greedy longest-match-first tokenisation would make, without building any of them.

A word is a maximal run without ASCII white space, written after a word-start mark as the
vocabulary does. A character that no piece starts with counts as one token for each of its
UTF-8 bytes (byte fallback).

Defined results: a null or empty text has 0 words and 0 tokens; a repeated row gives its
result again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import pick

#: The word-start mark of sentencepiece vocabularies.
MARK = "▁"
#: Distinct words, and characters of them, that a worker remembers at most.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 16_000_000


def read_pieces(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


class LongestMatch:
    """The automaton; ``count`` is the number of greedy pieces of a string, in one pass over it."""

    def __init__(self, pieces: Iterable[str]):
        edges: list[dict[str, int]] = [{}]
        weight: list[int | None] = [None]  # tokens that a node's string counts as, if it is one
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    weight.append(None)
                node = edges[node][c]
            if node:
                weight[node] = 1
        for c, node in edges[0].items():  # a first character that is no piece falls back to bytes
            if weight[node] is None:
                weight[node] = len(c.encode())
        link, popped = [0] * len(edges), [0] * len(edges)
        queue = deque((0, c, v) for c, v in edges[0].items())
        while queue:
            parent, c, v = queue.popleft()
            if weight[v] is not None:  # the whole string is popped
                link[v], popped[v] = 0, weight[v]
            else:  # the parent's pops, then on from where they lead
                z, n = link[parent], popped[parent]
                while c not in edges[z] and z:
                    n += popped[z]
                    z = link[z]
                if c in edges[z]:
                    link[v], popped[v] = edges[z][c], n
                else:
                    link[v], popped[v] = 0, n + len(c.encode())
            queue.extend((v, x, w) for x, w in edges[v].items())
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, text: str) -> int:
        edges, link, popped, node, n = self.edges, self.link, self.popped, 0, 0
        for c in text:
            while (after := edges[node].get(c)) is None and node:
                n += popped[node]
                node = link[node]
            if after is None:
                n += len(c.encode())
            else:
                node = after
        while node:
            n += popped[node]
            node = link[node]
        return n


_WORKER: dict[int, tuple[LongestMatch, dict[str, int]]] = {}


def _automaton(pieces: list[str]) -> tuple[LongestMatch, dict[str, int]]:
    key = hash(tuple(pieces))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = LongestMatch(pieces), {}
    return _WORKER[key]


def count_words(words: list[str], automaton: LongestMatch, cache: dict[str, int]) -> int:
    try:
        return sum(map(cache.__getitem__, words))
    except KeyError:
        new = {w: automaton.count(MARK + w) for w in {*words} if w not in cache}
        if len(cache) + len(new) > CACHE_ENTRIES or sum(map(len, new)) > CACHE_CHARS // 16:
            cache.clear()
            known = new | {w: automaton.count(MARK + w) for w in {*words} - new.keys()}
            return sum(map(known.__getitem__, words))
        cache.update(new)
        return sum(map(cache.__getitem__, words))


def words_of(text: str) -> list[str]:
    """The maximal runs without ASCII white space; bytes.split cuts at exactly that."""
    return [w.decode() for w in text.encode().split()]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_words long, n_tokens long."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_pieces(model_path))  # bounded: a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = _automaton(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                words, tokens = [], []
                for text in b.column(1).to_pylist():
                    found = words_of(text)
                    words.append(len(found))
                    tokens.append(count_words(found, automaton, cache))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    read = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias(text_col))
    return read.mapInArrow(run, f"`{id_col}` long, n_words long, n_tokens long")
