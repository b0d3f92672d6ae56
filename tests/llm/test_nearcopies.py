"""Near copies against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from poolwright.llm import nearcopies
from poolwright.llm.simhash import BKTree


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("star", [False, True])
def test_representatives_are_those_of_all_pairs(spark, star, monkeypatch):
    """star: many variants of one text, about as alike as a link asks for to it and less so to each other."""
    monkeypatch.setattr(nearcopies, "BLOCK", 16 if star else nearcopies.BLOCK)
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, line = [], " ".join(r.choice(words) for _ in range(20))
    for _ in range(1 if star else 12):
        base = [r.choice(words) for _ in range(r.choice([60, 200, 600]))]
        rows.append(" ".join(base))
        for _ in range(120 if star else 8):
            other = list(base)
            for i in r.sample(range(len(base)), r.randint(1, max(2, len(base) // (20 if star else 30)))):
                other[i] = r.choice(words)
            rows.append(" ".join(other))
    rows += [line + " " + " ".join(r.choice(words) for _ in range(10)) for _ in range(15)] + ["a b", "A  b", "a c", "", None, " \n"]
    r.shuffle(rows)
    table = [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[5]), (None, "only here and nowhere else at all")]
    root = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            x, y = sets(table[i][1]), sets(table[j][1])
            if not x | y or len(x & y) >= 0.8 * len(x | y):
                a, b = root[i], root[j]
                root = [b if v == a else v for v in root]
    want = {}
    for (d, _), g in zip(table, root):
        want[g] = min([v for v in (want.get(g), d) if v is not None], default=None)
    got = nearcopies.representatives(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    key = lambda d: (d is None, d or 0)
    assert sorted((x.doc_id for x in got.collect()), key=key) == sorted(want.values(), key=key)
    assert len(want) < len(table) - 30


def test_empty(spark):
    assert nearcopies.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_give_the_nearest_and_all_within():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 12))) for b in base for _ in range(20)]
    for radius in (3, 28):
        tree = BKTree(radius)
        for i, v in enumerate(values):
            apart = [(v ^ w).bit_count() for w in values[:i]]
            near = tree.nearest(v)
            assert (near is None) == (min(apart, default=64) > radius) and (near is None or apart[near] == min(apart))
            assert sorted(tree.add(v)) == [j for j, d in enumerate(apart) if d <= radius]


def test_alike_sets_lie_within_the_radius():
    """Pairs at the least similarity, with shingles repeated: a fingerprint is that of the set."""
    r, apart = np.random.default_rng(2), []
    for n in (4, 9, 50, 400):
        for _ in range(500):
            whole = r.integers(0, 2**64, n + max(1, n // 4), dtype=np.uint64)
            x, y = whole[:n], whole  # n of n * 1.25, or 4 of 5
            if len(x) >= 0.8 * len(y):
                a, b = nearcopies.fingerprints(np.concatenate([x, np.repeat(x[:1], 300), y]), np.array([0, n + 300, n + 300 + len(y)])).tolist()
                apart.append(((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count())
    assert len(apart) == 2000 and max(apart) <= nearcopies.RADIUS and max(apart) > 16


def test_all_pairs_come_from_trees(monkeypatch):
    """Without a radius only equal fingerprints meet, in both searches: nothing beside the trees finds pairs."""
    words = [f"w{i}" for i in range(60)]
    texts = pa.array([" ".join(words), " ".join([*words, "end"]), " ".join(words).upper()])
    values, first = nearcopies.shingles(texts)
    fps, keys, tags = nearcopies.fingerprints(values, first).tolist(), nearcopies.band_keys(values, first), [1, 2, 3]
    key = int(next(k for k in keys[0] if all(k in row for row in keys)))
    rows = pa.RecordBatch.from_pydict({"key": [key] * 3, "part": [0] * 3, "tag": tags, "fp": fps, "least": [1] * 3, "least_fp": [fps[0]] * 3})
    shared = int(keys[0][(keys == keys[0]).all(axis=0)][0])
    found = lambda: ([p for b in nearcopies._nearest([rows]) for p in zip(*b.to_pydict().values())], nearcopies._met(shared, [0] * 3, tags, tags, fps, keys, texts))
    assert found() == ([(2, 1), (3, 1)], [(2, 1), (3, 1)])
    monkeypatch.setattr(nearcopies, "RADIUS", 0)
    assert found() == ([(3, 1)], [(3, 1)])
