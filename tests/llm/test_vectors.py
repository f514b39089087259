"""Lattice hashing and integer centroids against brute force."""

import hashlib
import random

import numpy as np
import pytest

from gridreach.llm import centroids, lattice

SCHEMA = "vec_id long, embedding array<float>, label int, Uid long, CELL string, cluster int"


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in vectors], SCHEMA.replace("float", kind))


def floats(m):
    return [[float(np.float32(x)) for x in row] for row in m]


def links(vectors):
    """{row: linked rows}, by all pairs in double precision."""
    good = [k for k, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {k: set() for k in range(len(vectors))}
    for a in good:
        for b in good:
            x, y = vectors[a][1], vectors[b][1]
            if a != b and len(x) == len(y):
                x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                    out[a].add(b)
    return out


def near_duplicates(vectors):
    found, rows = links(vectors), []
    for k, (i, _) in enumerate(vectors):
        seen, todo = {k}, [k]
        while todo:
            for b in found[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        least = min((vectors[b][0] for b in seen if vectors[b][0] is not None), default=None)
        rows.append((i, len(found[k]), least, i == least))
    return sorted(rows, key=repr)


def near(r, base, noise):
    return floats(base + r.normal(size=base.shape) * noise)


def test_nearest_lattice_point():
    r = np.random.default_rng(1)
    y = r.normal(size=(300, 8)) * 2
    point = lattice.nearest_e8(y)
    doubled = point * 2
    assert (doubled == np.rint(doubled)).all() and ((doubled % 2).sum(1) % 8 == 0).all() and (point.sum(1) % 2 == 0).all()
    apart = ((y - point) ** 2).sum(1)
    assert apart.max() <= 1 + 1e-9  # the covering radius is one
    for move in lattice._NEAR:  # no neighbour is nearer
        assert (((y - point - move) ** 2).sum(1) >= apart - 1e-9).all()
    assert lattice._NEAR.shape == (240, 8) and np.allclose((lattice._NEAR**2).sum(1), 2)


@pytest.mark.parametrize(("cosine", "least"), [(0.9, 0.96), (0.95, 0.999), (0.98, 1.0)])
def test_recall(cosine, least):
    """Pairs at just this cosine share a cell; strangers hardly ever do."""
    r = np.random.default_rng(2)
    x, y = (lattice.unit(r.normal(size=(4000, 64))) for _ in range(2))
    y = lattice.unit(y - (y * x).sum(1, keepdims=True) * x)
    a, b, c = (lattice.cells_of(m) for m in (x, cosine * x + np.sqrt(1 - cosine**2) * y, y))
    share = lambda p, q: np.array([bool(np.intersect1d(u, v).size) for u, v in zip(p, q, strict=True)]).mean()
    assert share(a, b) >= least and share(a, c) < 0.002


def test_near_duplicates_as_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 64))
    vectors = [(i, v) for i, v in enumerate(floats(base))]
    vectors += [(100 + 7 * i, v) for i, v in enumerate(near(r, base[:8], 0.1))] + [(300 + i, v) for i, v in enumerate(near(r, np.repeat(base[:1], 90, 0), 0.1))]
    vectors += [(500, vectors[3][1]), (3, vectors[3][1]), (3, floats(-base[3:4])[0]), (501, [2 * x for x in vectors[5][1]]), (None, vectors[6][1]), (None, floats(base[29:30] * -1)[0]), (None, None)]
    vectors += [(600, None), (601, []), (602, [0.0] * 64), (603, [None] + [1.0] * 63), (604, [float("nan")] * 64), (605, [float("inf")] + [1.0] * 63), (606, [1.0, 2.0]), (607, [1.0, 2.0]), (608, [1.0, 2.1, 0.0]), (609, [3e38] * 64), (610, [1e-40] * 64)]
    want = near_duplicates(vectors)
    assert sorted((tuple(x) for x in lattice.near_duplicates(frame(spark, vectors)).collect()), key=repr) == want
    assert sorted((tuple(x) for x in lattice.near_duplicates(frame(spark, vectors, "double")).collect()), key=repr) == want
    assert lattice.near_duplicates(frame(spark, [])).count() == 0
    assert lattice.near_duplicates(frame(spark, [(1, [0.0]), (2, None)])).count() == 2


def test_full_cells_in_blocks(spark, monkeypatch):
    """Groups of two blocks count a pair once, also in a cell with hundreds of classes."""
    monkeypatch.setattr(lattice, "BLOCK", 16)
    r = np.random.default_rng(4)
    base = r.normal(size=(3, 64))
    vectors = list(enumerate(near(r, np.repeat(base, [300, 60, 5], 0), 0.12)))
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)]
    assert sorted((tuple(x) for x in lattice.near_duplicates(frame(spark, vectors)).collect()), key=repr) == near_duplicates(vectors)


def lloyd(vectors, k=8, rounds=10):
    """The contract, with Python's integers and all distances."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centre = [v for _, v in sorted(kept, key=lambda x: (hashlib.sha256(f"3:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        own = [min((distance(v, c), j) for j, c in enumerate(centre)) for _, v in kept]
        if turn < rounds:
            members = [[v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j] for j in range(len(centre))]
            centre = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centre, strict=True)]
    total = [sum(d for d, c in own if c == j) for j in range(len(centre))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, j, d, total[j], sum(total), digest[j]) for (i, _), (d, j) in zip(kept, own, strict=True)), key=repr)


def clustered(df):
    return sorted((tuple(x)[:6] for x in centroids.cluster(df).collect()), key=repr)


def test_clusters_as_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = list(enumerate(floats(r.normal(size=(20, 64))[r.integers(0, 20, 400)] + r.normal(size=(400, 64)) * 0.3)))
    vectors += [(None, vectors[0][1]), (5, vectors[1][1]), (5, vectors[2][1]), (900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("-inf")] * 64)]
    df = frame(spark, vectors)
    assert clustered(df) == lloyd(vectors)
    assert sum(x["evaluated"] for x in centroids.cluster(df).collect()) < 0.75 * 88 * 403  # bounds leave distances out


def test_clusters_of_ties_and_few_vectors(spark):
    r = random.Random(6)
    grid = [(i, [float(r.choice((0, 1)) / 1024 * 2)] * 2 + [0.0] * 62) for i in range(60)]
    assert clustered(frame(spark, grid)) == lloyd(grid)
    few = [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.5] * 64)]
    assert clustered(frame(spark, few)) == lloyd(few)
    assert centroids.cluster(frame(spark, [])).collect() == []
    assert centroids.cluster(frame(spark, [(1, None)])).collect() == []


def test_clusters_of_large_components(spark):
    """Squares beyond 64 bits are still compared exactly; a distance beyond them is the largest one."""
    r = np.random.default_rng(7)
    vectors = [(i, v) for i, v in enumerate(floats(r.integers(-3, 4, (60, 64)) * np.array([1e6, 2e5, 3.0, 1e8])[r.integers(0, 4, 60)][:, None]))]
    most = (1 << 63) - 1
    want = lloyd(vectors)
    assert clustered(frame(spark, vectors)) == [(i, j, min(d, most), min(sum(min(x[2], most) for x in want if x[1] == j), most), most, h) for i, j, d, _, _, h in want]


def test_bounds_never_miss():
    """Rounds with bounds give what full rounds give, also where centroids jump or coincide."""
    r = np.random.default_rng(8)
    rows = r.integers(-20, 21, (500, 64))
    centre = [rows[i].tolist() for i in range(8)]
    bounds = centroids.Bounds(centre)
    state = bounds.first(rows)
    for turn in range(15):
        moved = [(np.array(c) + r.integers(-3, 4, 64) * (turn % 4)).tolist() for c in bounds.centroids]
        if turn % 5 == 4:
            moved[3] = moved[1]
        bounds = centroids.Bounds(moved, bounds.centroids)
        state = bounds.next(rows, *(x.copy() for x in state))
        full = np.stack([centroids.squared(rows, c) for c in moved], 1)
        assert (state[0] == full.argmin(1)).all()
        assert (state[1] >= np.sqrt(full[np.arange(500), state[0]])).all() and (state[2] <= np.sqrt(full)).all()
