"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are pairs of neighbouring UTF-8 bytes (digits folded to one) and buckets of a few whole-text
statistics. Weights by log count and inverse document frequency, then a truncated singular value
decomposition, both fitted on a bounded sample of labelled rows, give latent vectors. The sample's
vectors are broadcast; every document's cosine with all of them is computed exactly, in blocks,
and the nearest neighbours' labels are averaged, weighted by similarity and by how many labelled
rows a sampled one of its class stands for.

Bounds: ``per_class`` sampled rows of each label; all labelled rows count for the class weights.

Defined results: a null or empty text has the terms of an empty text and is scored like any other;
a text like no neighbour gets the share of label 1; neighbours as near as the last one that votes
vote too; a very long text is one count of its pairs, whatever its length; labels other than 0 and 1, null ids and labels
without a document are not learnt from; a repeated document gives its result again; without learnt
rows every score is 1 (nothing is known against a document); an empty table gives no rows; other
columns are kept, and one that is called like the score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship
from .common import pick

PER_CLASS, DIMENSIONS, NEIGHBOURS, BLOCK = 2000, 48, 24, 256

_PAIRS = 1 << 16
#: Buckets of each whole-text statistic; a statistic's two neighbouring buckets share its weight.
_BUCKETS = 12
_STATISTICS = 9
TERMS = _PAIRS + _STATISTICS * _BUCKETS
#: Weight of a statistic against the pairs' vector of length 1.
_STATISTIC_WEIGHT = 0.6

_FOLD = bytes(48 if 48 <= b <= 57 else b for b in range(256))
#: Words that are a mark and nothing else.
_MARKS = frozenset(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())
_CLASS = np.zeros(256, dtype=np.uint8)  # 1 lower or non-ASCII, 2 upper, 3 digit, 4 space, 0 other
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers (ascending) and raw values of a whole text: pair counts, then statistics."""
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    codes = np.frombuffer(raw, dtype=np.uint8)
    if len(codes) > 1:
        pairs = codes[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= codes[1:]
        if len(pairs) < 3000:
            terms, counts = np.unique(pairs, return_counts=True)
        else:
            counts = np.bincount(pairs, minlength=_PAIRS)
            terms = np.flatnonzero(counts)
            counts = counts[terms]
    else:
        terms = counts = np.empty(0, dtype=np.int64)
    lower, upper, digit, space = np.bincount(_CLASS[codes], minlength=5)[1:5] if len(codes) else (0, 0, 0, 0)
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    distinct = len({*words})
    lines = raw.split(b"\n")
    shares = (
        upper / max(1, upper + lower), (size - lower - upper - digit - space) / size, digit / size,
        sum(map(eq, words, words[1:])) / n, sum(map(_MARKS.__contains__, words)) / n, distinct / n, math.log1p(len(raw)) / 14, min(1.0, (lower + upper) / n / 12), len({*lines}) / len(lines),
    )
    numbers, values = [], []
    for i, share in enumerate(shares):
        at = min(max(share, 0.0), 1.0) * (_BUCKETS - 1)
        low = min(int(at), _BUCKETS - 2)
        numbers += [_PAIRS + i * _BUCKETS + low, _PAIRS + i * _BUCKETS + low + 1]
        values += [low + 1 - at, at - low]
    return np.concatenate([terms.astype(np.int32), np.array(numbers, np.int32)]), np.concatenate([counts.astype(np.float32), np.array(values, np.float32)])


@dataclass
class Model:
    """idf of the pairs, the projection of terms, the labelled vectors, their labels and weights."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS


def _weigh(numbers: np.ndarray, values: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a text's terms: the pairs' part has length 1, each statistic's a fixed share."""
    out = np.log1p(values) * idf[numbers]
    pairs = numbers < _PAIRS
    norm = math.sqrt(float(out[pairs] @ out[pairs]))
    out[pairs] /= norm or 1
    out[~pairs] = values[~pairs] * _STATISTIC_WEIGHT
    return out


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]], shares: dict[int, float], dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model | None:
    """``sample``: terms, values, label; ``shares``: label -> labelled rows that a sampled row stands for."""
    if not sample:
        return None
    frequency = np.zeros(TERMS, dtype=np.int64)
    for numbers, _, _ in sample:
        frequency[numbers] += 1
    idf = np.log((1 + len(sample)) / (1 + frequency)).astype(np.float32) + 1
    idf[frequency == 0] = 0
    seen = np.flatnonzero(frequency)
    place = np.full(TERMS, -1, dtype=np.int64)
    place[seen] = np.arange(len(seen))
    weighed = [_weigh(numbers, values, idf) for numbers, values, _ in sample]

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(sample), BLOCK):
            dense = np.zeros((min(BLOCK, len(sample) - at), len(seen)), dtype=np.float32)
            for row, (numbers, _, _), values in zip(dense, sample[at : at + BLOCK], weighed[at : at + BLOCK], strict=True):
                row[place[numbers]] = values
            yield at, dense

    # Randomised subspace iteration for the leading right singular vectors.
    k = min(dimensions, len(sample), len(seen))
    basis = np.random.default_rng(0).standard_normal((len(seen), min(k + 10, len(seen)))).astype(np.float32)
    for _ in range(4):
        turned = np.zeros_like(basis)
        for _, dense in blocks():
            turned += dense.T @ (dense @ basis)
        basis, _ = np.linalg.qr(turned)
    projection = np.zeros((TERMS, k), dtype=np.float32)
    small = np.concatenate([dense @ basis for _, dense in blocks()])
    _, _, right = np.linalg.svd(small, full_matrices=False)
    projection[seen] = basis @ right[:k].T
    vectors = np.stack([values @ projection[numbers] for (numbers, _, _), values in zip(sample, weighed, strict=True)])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    labels = np.array([x[2] for x in sample], dtype=np.float32)
    weights = np.array([shares[x[2]] for x in sample], dtype=np.float32)
    return Model(idf, projection, vectors.astype(np.float32), labels, weights, float((labels * weights).sum() / weights.sum()), neighbours)


def scores(model: Model | None, texts: list[str]) -> np.ndarray:
    """Scores of some texts: one block of the cosine products."""
    if model is None:
        return np.ones(len(texts))
    latent = np.zeros((len(texts), model.projection.shape[1]), dtype=np.float32)
    for row, text in zip(latent, texts, strict=True):
        numbers, values = features(text)
        row[:] = _weigh(numbers, values, model.idf) @ model.projection[numbers]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    near = latent @ model.vectors.T
    k = min(model.neighbours, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    weight = np.where(near >= np.maximum(least, 0), near, 0) ** 2 * model.weights
    total = weight.sum(axis=1)
    return np.where(total > 0, weight @ model.labels / np.where(total > 0, total, 1), model.prior).clip(0, 1)


def held_out(doc_id: Column | str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is 1 modulo 3 (a null id: too)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Fits on at most ``per_class`` rows of each label that are not held out."""
    ship(docs.sparkSession)
    known = pick(labels, "doc_id", label).toDF("doc_id", "label").filter(~held_out("doc_id") & F.col("label").isin(0, 1))
    totals = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = None
    for value in totals:  # a bounded sample: broadcast below
        part = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["doc_id", "label", "terms", "counts"])

    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    rows = texts.mapInArrow(run, "doc_id long, label int, terms array<int>, counts array<float>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], len(r["terms"])))
    sample = [(np.array(r["terms"], np.int32), np.array(r["counts"], np.float32), r["label"]) for r in rows]
    sizes = {v: sum(x[2] == v for x in sample) for v in totals}
    return fit(sample, {v: totals[v] / max(1, sizes[v]) for v in totals})


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """``docs`` with ``out`` double in place of any column of that name; all other columns stay."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by per_class and the number of terms
    kept = [i for i, c in enumerate(docs.columns) if c != out]
    fields = [docs.schema.fields[i] for i in kept]
    at = [f.name for f in fields].index("text")
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                found = scores(shared.value, [t or "" for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "score"])

    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in zip(kept, fields, strict=True)), T.StructField("score", T.DoubleType())])
    return flat.mapInArrow(run, schema).toDF(*[f.name for f in fields], out)
