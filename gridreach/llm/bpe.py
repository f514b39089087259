"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each vocabulary entry becomes a piece (its bytes mapped to printable characters) scored by
its negative rank; normalisation is the identity. Sentencepiece's merge order is then the
rank order. Texts are cut into pre-tokens, each pre-token is encoded on its own, and ids are
decoded by the inverse mapping of pieces to bytes.

Defined results: a null text is encoded as an empty one, which has no ids; a repeated row
gives its result again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import pick

#: Distinct pre-tokens, and characters of them, that a worker remembers at most.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 16_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    shifted = iter(range(256, 512))
    return [chr(b if b in plain else next(shifted)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model. Ids are ranks, which have to be 0, 1, 2, ...; one more id is unknown.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1 (piece 1, score 2,
    type 3), trainer_spec 2 (model_type 3, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43),
    normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks have to be 0, 1, 2, ... without gaps")
    letters, minus = byte_letters(), (1 << 64) - 1
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(letters[b] for b in token).encode()
        out += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", -len(ranks)) + _number(3, 2))
    out += _message(2, _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + _number(41, minus) + _number(42, minus) + _number(43, minus))
    out += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary; ``pattern`` cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.ranks, self.tokens = ranks, sorted(ranks, key=ranks.get)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def _learn(self, words: set[str]) -> None:
        """Encodes pre-tokens that the cache lacks."""
        if len(self.cache) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.cache, self.chars = {}, 0
        new, mapped = [w for w in words if w not in self.cache], []
        for w in new:
            raw = w.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[w] = (rank,)
            else:
                mapped.append((w, raw.decode("latin-1").translate(self.letters)))
            self.chars += len(w)
        if mapped:
            ids = self.model.encode([m for _, m in mapped], num_threads=1)
            self.cache.update((w, tuple(x)) for (w, _), x in zip(mapped, ids, strict=True))

    def encode(self, text: str) -> list[int]:
        words = self.cut(text)
        try:
            return list(chain.from_iterable(map(self.cache.__getitem__, words)))
        except KeyError:
            self._learn(unique := set(words))
            got = {w: self.cache[w] for w in unique} if len(self.cache) < len(unique) else self.cache
            return list(chain.from_iterable(map(got.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_WORKER: dict[object, ByteBpe] = {}


def _coder(shared, pattern: str) -> ByteBpe:
    """The worker's coder; tasks of one worker share it, and its cache."""
    key = (hashlib.sha256(shared.value).digest(), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        ranks, letters, proto = {}, {c: b for b, c in enumerate(byte_letters())}, shared.value
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for i in range(sp.get_piece_size() - 1):
            ranks[bytes(letters[c] for c in sp.id_to_piece(i))] = i
        _WORKER[key] = ByteBpe(ranks, proto, pattern)
    return _WORKER[key]


_ROWS = 256  # of a batch of ids


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens long, ids array<int>."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(coder: ByteBpe, key: list, texts: list[str]) -> pa.RecordBatch:
        ids = [coder.encode(t) for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return _run(docs, ranks_path, pattern, id_col, text_col, rows, f"`{id_col}` long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id column and ``decoded``, the bytes of the ids (null ids: none)."""
    spark = encoded.sparkSession
    ship(spark)
    tokens = spark.sparkContext.broadcast(sorted((r := read_ranks(ranks_path)), key=r.get))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b"".join(map(tokens.value.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return pick(encoded, id_col, ids_col).select(F.col(id_col).cast("long").alias(id_col), ids_col).mapInArrow(run, f"`{id_col}` long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, the sha256 of the ids in decimal joined by a space, and of the bytes they decode to."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(coder: ByteBpe, key: list, texts: list[str]) -> pa.RecordBatch:
        decimal = _DECIMAL.setdefault(len(coder.tokens), list(map(str, range(len(coder.tokens)))))
        counts, joined, decoded = [], [], []
        for t in texts:
            ids = coder.encode(t)
            counts.append(len(ids))
            joined.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(counts, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return _run(docs, ranks_path, pattern, id_col, text_col, rows, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_DECIMAL: dict[int, list[str]] = {}


def _run(docs, ranks_path, pattern, id_col, text_col, rows, schema) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model_proto(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                yield rows(coder, b.column(0).to_pylist(), b.column(1).to_pylist())

    read = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias(id_col), F.coalesce(text_col, F.lit("")).alias(text_col))
    return read.mapInArrow(run, schema)
