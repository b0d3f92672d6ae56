"""Centroid clustering and M-tree search against plain Python, and on awkward rows."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from poolwright.llm import centroids, metrictree
from poolwright.llm.vectors import Scaled, packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n string, copies int, cell string, cluster string"


def vectors(seed=0, n=400, size=64, hot=60):
    """Random vectors, near copies, `hot` exact copies under other ids, repeated rows and ids, and rows that take no part."""
    r = random.Random(seed)
    some = lambda: [r.gauss(0, 0.1) for _ in range(size)]
    base = some()
    rows = [(i, some()) for i in range(n)]
    rows += [(n + i, base) for i in range(hot)] + [(n + hot + i, [x + r.gauss(0, 0.01) for x in base]) for i in range(40)]
    rows += [(100, rows[100][1])] * 3 + [(200, some()), (None, base), (None, some()), (-100, some()), (7, [0.0] * size)]
    rows += [(900, None), (901, some()[:-1]), (902, [*some()[:-1], None]), (903, [*some()[:-1], math.nan]), (904, [*some()[:-1], -math.inf]), (905, []), (1000, [*some(), 0.5]), (1001, [1e30] * size)]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    r.shuffle(rows)
    return [(*row, 1, "v", "n", 0, "c", "k") for row in rows]


def scaled(v, scale):
    return tuple(math.floor(scale * x) for x in v)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clusters(rows, k=16, rounds=3):
    kept = [(i, scaled(v, 64)) for i, v, *_ in rows if whole(v) and len(v) == 64 and max(map(abs, v)) < 2**21]
    order = sorted(kept, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), packed(np.array([x[1]]))))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def best(rows, k=10, every=100):
    kept = [(i, scaled(v, 1024)) for i, v, *_ in rows if whole(v) and sum((1024 * x) ** 2 for x in v) < 2**62]
    out = []
    for at, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), math.inf if j is None else j) for b, (j, v) in enumerate(kept) if b != at and len(v) == len(q)]
            out += [(i, n, None if j == math.inf else j, -s) for n, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_clusters_against_plain_python(spark):
    rows = vectors()
    got = centroids.query(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64, 0, "", "", 0, "", "") for i in (1, 1, 2)] + [(3, None, 0, "", "", 0, "", "")]
    assert sorted(map(tuple, centroids.query(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == clusters(rows)
    for empty in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows[3:], SCHEMA)):
        assert centroids.query(empty).count() == 0 and metrictree.query(empty).count() == 0


def test_large_components_stay_exact(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-(2**20), 2**20)) for _ in range(64)], 0, "", "", 0, "", "") for i in range(60)]
    got = centroids.query(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == clusters(rows)
    rows = [(i * 10, [x * 16 for x in v], *rest) for i, v, *rest in rows]
    got = metrictree.search(spark.createDataFrame(rows, SCHEMA), shard=20, page=4)
    assert sorted(map(tuple, got.collect()), key=repr) == best(rows)


@pytest.mark.parametrize("setting", [{}, {"shard": 50, "page": 8}, {"shard": 37, "page": 4, "block": 3}])
def test_search_against_all_scores(spark, setting):
    rows = vectors()
    got = metrictree.search(spark.createDataFrame(rows, SCHEMA).repartition(5), **setting)
    assert sorted(map(tuple, got.collect()), key=repr) == best(rows)


def test_repeated_query_rows(spark, monkeypatch):
    monkeypatch.setattr(metrictree, "TIMES", 3)
    rows = [(0, [1.0, 0.5], 0, "", "", 0, "", "")] * 8 + [(i, [i / 9, 0.1], 0, "", "", 0, "", "") for i in range(1, 12)]
    got = metrictree.search(spark.createDataFrame(rows, SCHEMA), k=4)
    assert sorted(map(tuple, got.collect()), key=repr) == best(rows, 4)


def grouped(seed, groups, each, size=16, spread=0.02):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (groups, size))
    return np.floor(1024 * (np.repeat(centres, each, axis=0) + r.normal(0, spread, (groups * each, size)))).astype(np.int64)


def test_bounds_spare_distances():
    """On grouped vectors a search computes few distances; on copies by the thousand, ids end it; either way it is exact."""
    points = grouped(3, 40, 50)
    for data in (points, np.repeat(points[:1], 2000, axis=0)):
        ids = np.arange(len(data))
        tree = metrictree.Tree.read(metrictree.Tree.build(ids, np.ones(len(data), np.int64), data, 16).row())
        query = metrictree.Query(0, 0, 1, data[0], 10)
        done = tree.search(query)
        score = data @ data[0]
        want = [(-int(score[i]), int(i)) for i in np.lexsort((ids, -score)) if i][:10]
        assert query.best == want and done < len(data) / 3


def test_packing_of_rows():
    r = random.Random(2)
    rows = np.array([[r.randint(-(2**b), 2**b - 1) for _ in range(5)] for b in (1, 7, 8, 15, 16, 31, 32, 60) for _ in range(4)])
    assert (unpacked(packed(rows), 5) == rows).all() and len(packed(np.array([[-128, 127]]))[0]) == 2 and len(packed(np.array([[-129, 0]]))[0]) == 4
    column = pa.array([[1.0], None, [], [None], [2.0, math.inf], [-0.001, 3.0]], pa.list_(pa.float32()))[1:]
    own = Scaled(column, 10)
    assert own.whole.tolist() == [False, True, False, False, True] and own.rows(np.array([4]), 2).tolist() == [[-1.0, 30.0]]
