"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Words are runs without ASCII white space, lower-cased (A-Z); a document's set has its distinct
five-word shingles (the whole sequence, with fewer words). Documents with equal sets are one class.
Bands of minima give candidate buckets; two low bits of each minimum are packed, and bit counts of
packed signatures, corrected for chance agreement, sort out most candidates; the rest are confirmed
on the full sets. Links are documents with 100 * |intersection| >= 75 * |union|.

No group's pairs are listed: each bucket first compares its members with one centre (the member
whose buckets are the fullest) and links are contracted to components. In buckets that still hold
several, what isn't in the centre's component meets a few random members, twice. Only what is left
then is compared with every member of another component, so every candidate pair whose ends
aren't connected anyway is compared; that join weighs halved hashes of the sets and makes rows only
of pairs that are similar by them, which are then confirmed as all others are.

The texts of classes that share a bucket are sent by id once, compressed, and kept for all rounds.

Constants: 32 bands of 4 minima miss a link at similarity 0.75 with probability 5e-6, fewer above;
an estimate from 512 two-bit values is 5 standard deviations below 0.75 at ``FLOOR``.
Shingles are compared by 64-bit hashes, sets of classes by 128 bits.

Defined results: null and empty texts have no shingles and are linked with nothing; repeated rows
are copies; rows that share an id are judged each by its own text, and texts are not linked by it;
a null id has a null component and is kept; very long texts are hashed whole, some at a time; of
ties the smallest id stands for its class; an empty table gives no rows; other columns, whatever
their names, are ignored, or kept by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.checkpoints import cut, cut_compact, release
from ..plans.shipping import ship
from .common import pick

WORDS, SIMILARITY = 5, 75
BANDS, ROWS, MINIMA = 32, 4, 512
FLOOR = 0.63
#: Rounds in which what isn't connected yet meets random members of its buckets, and how many.
ROUNDS, MET = 2, 4
#: Bytes of text that are hashed together, about; pairs whose sets are held together.
_CHUNK, _PAIRS = 1 << 20, 64

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [_U(x) for x in _random.integers(0, 1 << 62, WORDS, dtype=_U) * _U(2) + _U(1)]
_FACTOR = (_random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_SHIFT = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_POWERS = np.ones(1, dtype=_U), np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * _CHUNK)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        if size > 8 * _CHUNK:
            return both[0], both[1]
        _POWERS = both[0], both[1]
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and each text's first place among them (and the end)."""
    joined = b"\n".join([*texts, b""]).lower()
    codes = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[codes]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(codes))
    sums = np.empty(len(codes) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(_BYTE[codes] * power[: len(codes)], dtype=_U, out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    with np.errstate(over="ignore"):
        hashes, at = _word_hashes(texts)
        if len(hashes) >= WORDS:
            n = len(hashes) - WORDS + 1
            rolled = np.zeros(n, dtype=_U)
            for i, step in enumerate(_STEP):
                rolled += hashes[i : i + n] * step
            rolled = _mix(rolled)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(_mix((hashes[a:b] * np.array(_STEP[: b - a], dtype=_U)).sum(dtype=_U, keepdims=True) + _U(b - a)))
            else:
                out.append(np.empty(0, dtype=_U))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) minima of 32-bit permutations; empty sets are not allowed."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    base = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    out = np.empty((len(sets), MINIMA), dtype=np.uint32)
    held = np.empty_like(base)
    for k in range(MINIMA):
        np.multiply(base, _FACTOR[k], out=held)
        np.add(held, _SHIFT[k], out=held)
        out[:, k] = np.minimum.reduceat(held, starts)
    return out


def signatures(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, and two bits of each minimum packed into 64-bit numbers."""
    with np.errstate(over="ignore"):
        rows = found[:, : BANDS * ROWS].reshape(len(found), BANDS, ROWS).astype(_U)
        keys = np.arange(1, BANDS + 1, dtype=_U)[None] * _BASE
        for i in range(ROWS):
            keys = _mix(keys + rows[:, :, i] + _U(1))
        mixed = found * np.uint32(0x9E3779B1)
        low = ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(3)).astype(_U).reshape(len(found), MINIMA // 32, 32)
        packed = (low << (np.arange(32, dtype=_U) * _U(2))).sum(axis=2, dtype=_U)
    return keys.view(np.int64), packed.view(np.int64)


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    start, size, texts = 0, 0, []
    for i, t in enumerate(b.column(column).to_pylist()):
        texts.append(t or b"")
        size += len(texts[-1])
        if size >= _CHUNK:
            yield b.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield b.slice(start), texts


_BITS = [f"b{i}" for i in range(MINIMA // 32)]


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes) and t, a hash that tells texts under one id apart."""
    text = F.col("text").cast("binary")
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def sign(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, t, n (set size), same (identity of the set), bands, b0 to b15; null where n is 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in _chunks(whole, 1):
                sets = shingle_sets(texts)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, packed = signatures(minima([sets[i] for i in full])) if full else (np.empty((0, BANDS), np.int64), np.empty((0, len(_BITS)), np.int64))
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                none = place < 0
                bits = [pa.array(np.where(none, 0, packed[place, j]) if full else np.zeros(len(sets), np.int64), mask=none) for j in range(len(_BITS))]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if p < 0 else keys[p] for p in place], pa.list_(pa.int64())), *bits,
                ], names=["doc_id", "t", "n", "same", "bands", *_BITS])

    return _read(docs).mapInArrow(run, "doc_id long, t long, n long, same binary, bands array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, t, size, packed: the compressed texts. Words' hashes would take thrice as much to send."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()),
            ], names=["doc_id", "t", "size", "packed"])

    return _read(docs).filter("text IS NOT NULL AND doc_id IS NOT NULL").mapInArrow(run, "doc_id long, t long, size long, packed binary")


def _unpacked(b: pa.RecordBatch, size: str, packed: str) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(p, n, asbytes=True) for n, p in zip(b.column(size).to_pylist(), b.column(packed).to_pylist(), strict=True)]


def _hashed(texts: DataFrame) -> DataFrame:
    """node, items: the distinct upper halves of the shingles' hashes, half of what the sets take."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _PAIRS):
                part = b.slice(at, _PAIRS)
                items = [np.unique((s >> _U(32)).astype(np.uint32)).view(np.int32) for s in shingle_sets(_unpacked(part, "size", "packed"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(items, pa.list_(pa.int32()))], names=["node", "items"])

    return texts.select("node", "size", "packed").mapInArrow(run, "node long, items array<int>")


def _estimate(a: str, b: str) -> Column:
    """Similarity from packed signatures: agreeing two-bit values, less those that agree by chance."""
    differ = F.lit(0)
    for bit in _BITS:
        x = F.col(f"{a}.{bit}").bitwiseXOR(F.col(f"{b}.{bit}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return ((1 - differ / MINIMA) - 0.25) / 0.75


def _plausible(a: str, b: str) -> Column:
    """What a link's set sizes and packed signatures fulfil."""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (low * 100 >= high * SIMILARITY) & (_estimate(a, b) >= FLOOR)


def _maybe_similar(a: str, b: str) -> Column:
    """What a link's halved hashes fulfil: at most as many common shingles are lost as hashes fell together in one set."""
    both = F.size(F.array_intersect(f"{a}.items", f"{b}.items")) + F.col(f"{a}.n") - F.size(f"{a}.items")
    return both * 100 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - both) * SIMILARITY


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAIRS):
                b = whole.slice(at, _PAIRS)
                ends = {}  # a node's set is made once for its neighbouring rows
                for end in ("src", "dst"):
                    first = {node: i for i, node in enumerate(b.column(end).to_pylist()) if node not in ends}
                    rows = b.take(pa.array(list(first.values()), pa.int64()))
                    ends.update(zip(first, shingle_sets(_unpacked(rows, f"{end}_size", f"{end}_packed")), strict=True))
                alike = []
                for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                    both = len(np.intersect1d(ends[x], ends[y], assume_unique=True))
                    alike.append(both * 100 >= (len(ends[x]) + len(ends[y]) - both) * SIMILARITY)
                yield b.select(["src", "dst"]).filter(pa.array(alike, pa.bool_()))

    for end in ("src", "dst"):  # the centres last, so that their pairs are neighbours
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("packed").alias(f"{end}_packed")), end)
    return pairs.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    spark = docs.sparkSession
    signed = cut(sign(docs))
    first = F.min(F.struct("doc_id", "t", "n", "bands", *_BITS))
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("same").agg(first.alias("s")).select("same", "s.*")
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    light = classes.select("node", "n", *_BITS)

    spread = classes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = cut_compact(spread.join(shared, "key"))
    fullness = buckets.groupBy("node").agg(F.sum("members").alias("fullness"))
    centres = buckets.join(fullness, "node").groupBy("key").agg(F.max_by("node", F.struct("fullness", -F.col("node"))).alias("centre"))
    centres = cut_compact(centres)
    buckets = buckets.select("key", "node")

    # The texts of all that is in a bucket with others are sent once.
    asked = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "t")
    texts = cut_compact(_packed(docs).join(asked, ["doc_id", "t"]).select("node", "size", "packed"), 5000)
    release(spark)

    def candidates(rows: DataFrame, one: str, other: str) -> DataFrame:
        """Distinct plausible pairs of two columns of nodes; src is the first one's."""
        found = rows.filter(F.col(one) != F.col(other)).select(F.col(one).alias("src"), F.col(other).alias("dst")).distinct()
        a, b = light.alias("a"), light.alias("b")
        return found.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).filter(_plausible("a", "b")).select("src", "dst")

    tested = cut_compact(candidates(buckets.join(centres, "key"), "node", "centre"))
    links = cut_compact(_confirmed(tested, texts))
    component = connected_components(links)
    release(spark)

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        known = component.select(F.col("v").alias(column), F.col("component").alias("__c"))
        return df.join(known, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")

    mixed = buckets
    for turn in range(ROUNDS + 1):
        mixed = labelled(mixed.select("key", "node"), "node", "component")
        several = mixed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
        middle = labelled(centres.join(several, "key"), "centre", "main").select("key", "main")
        mixed = cut_compact(mixed.join(middle, "key"))
        rest = mixed.filter("component != main")
        if turn < ROUNDS:
            met = [F.max_by("node", F.xxhash64("node", F.lit(turn * MET + i))) for i in range(MET)]
            chosen = mixed.groupBy("key").agg(F.array_distinct(F.array(*met)).alias("met"))
            fresh = candidates(rest.join(chosen, "key").select("node", F.explode("met").alias("other")), "node", "other")
        else:
            if rest.isEmpty():
                break
            # The halved sets go along and are compared in the join: pairs that are no links make no rows.
            items = _hashed(texts.join(mixed.select("node").distinct(), "node", "left_semi"))
            whole = cut_compact(classes.select("node", "n", "bands", *_BITS).join(items, "node"), 5000)
            x, y = rest.join(whole, "node").alias("x"), mixed.join(whole, "node").alias("y")
            once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")  # a pair that shares several buckets
            apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
            fresh = x.join(y, apart & _plausible("x", "y") & once & _maybe_similar("x", "y")).select(F.col("x.node").alias("src"), F.col("y.node").alias("dst")).distinct()
        fresh = cut_compact(fresh.join(tested, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            continue
        tested = tested.union(fresh)
        more = cut_compact(_confirmed(fresh, texts))
        if not more.isEmpty():
            links = links.union(more)
            component = connected_components(links)
        release(spark)

    nodes = classes.select("same", "node", F.col("doc_id").alias("least")).join(component.select(F.col("v").alias("node"), "component"), "node", "left")
    nodes = nodes.select("same", "least", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "same").join(nodes.join(least, "component").select("same", "component_id"), "same", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each component, of the smallest id; null ids and texts without shingles stay."""
    names = docs.columns
    rows = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    row, text = F.col(f"__c{names.index('doc_id')}").cast("long"), F.col(f"__c{names.index('text')}")
    known, free = rows.filter(row.isNotNull()), rows.filter(row.isNull())
    if known.groupBy(row).count().filter("count > 1").isEmpty():
        found = near_duplicates(known.select(row.alias("doc_id"), text.alias("text"))).filter("kept").select(F.col("doc_id").alias("__kept"))
        return known.join(found, row == F.col("__kept"), "left_semi").union(free).toDF(*names)
    # Repeated ids: rows get keys of their own, written out so that they stay the same.
    known = cut(known.withColumn("__row", F.monotonically_increasing_id()))
    groups = near_duplicates(known.select(F.col("__row").alias("doc_id"), text.alias("text"))).select(F.col("doc_id").alias("__row"), "component_id")
    first = groups.join(known.select("__row", row.alias("__id")), "__row").groupBy("component_id").agg(F.min(F.struct("__id", "__row"))["__row"].alias("__row"))
    return known.join(first, "__row", "left_semi").drop("__row").union(free).toDF(*names)
