"""Centroid clustering of vectors by weighted deduplication.

Vectors are quantised to whole numbers and identical ones become one row with its multiplicity. Lloyd's rounds run over
the distinct vectors: each task sums multiplicity times vector for each cluster, in whole numbers, and sends one row for
each cluster and component; the driver sees those sums alone, `k` times `size` numbers however many vectors there are.
The last assignment is joined back to the vector ids, hot vectors being dealt over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import discard, split_join, stored
from poolwright.llm.vectors import Scaled, packed, unpacked

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Beyond this a squared distance of 64 components may not fit a long.
LARGEST = 2**27
_ROWS = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])
_SUMS = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])
_NEAREST = pa.schema([("v", pa.binary()), ("n", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of each vector that has `size` of them, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Scaled(batch.column("embedding"), scale)
            at = np.flatnonzero(own.whole & (own.size == size))
            rows = own.rows(at, size)
            fits = (np.abs(rows) <= LARGEST).all(axis=1)
            at, rows = at[fits], rows[fits].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()).take(pa.array(at)), pa.array(packed(rows), pa.binary())], schema=_ROWS)

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number on ties, and its squared distance, exactly."""
    size = rows.shape[1]
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * size < 2**50:  # every sum is exact as a double
        x, c = rows.astype(float), centroids.astype(float)
        d = ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)
    else:
        d = np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(rows)), best]


def _sums(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        totals, counts = np.zeros((k, size), object), np.zeros(k, object)
        for batch in batches:
            rows, n = unpacked(batch.column("v").to_pylist(), size), batch.column("n").to_numpy(zero_copy_only=False)
            if not len(rows):
                continue
            own, _ = nearest(rows, centroids)
            small = int(np.abs(rows).max()) * int(n.sum()) < 2**62
            for c in np.unique(own).tolist():
                at = own == c
                weighted = n[at] @ rows[at] if small else n[at].astype(object) @ rows[at].astype(object)
                totals[c] += weighted.astype(object)
                counts[c] += int(n[at].sum())
        found = [c for c in range(k) if counts[c]]
        if found:
            columns = [np.repeat(found, size), np.tile(np.arange(size), len(found)), [int(t) for c in found for t in totals[c]], np.repeat([int(counts[c]) for c in found], size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(unpacked(batch.column("v").to_pylist(), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("n"), pa.array(cluster, pa.int32()), pa.array(distance)], schema=_NEAREST)

    return run


def start(rows: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of least SHA-256 of `seed:vec_id`; equal ids go by their packed vectors, a null id counts as empty text."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return unpacked([bytes(r.v) for r in first], size)


def fit(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds over (v, n): each non-empty centroid becomes the floor of the weighted mean of its vectors."""
    centroids = centroids.copy()
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(centroids), "cluster int, at int, total decimal(38,0), n long").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():
            centroids[r.cluster, r["at"]] = int(r.total) // r.n
    return centroids


def cluster(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>) for each vector with `size` components.

    Left out: null vectors, those of another size, those with a null, infinite or NaN component, and those with a component
    beyond 2**27 after scaling, whose distances may not fit a long. Repeated rows count as often as they occur; a null
    vec_id is carried. Ties go to the smaller cluster number; fewer vectors than `clusters` give as many clusters as there
    are; an inertia that does not fit a long is null; no vectors give no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, size, scale), "quantised")
    distinct = stored(rows.groupBy("v").agg(F.count("*").alias("n")), "distinct")
    centroids = start(rows, size, clusters, seed)
    if len(centroids):
        centroids = fit(distinct, centroids, rounds)
        own = stored(distinct.mapInArrow(_assigned(centroids), "v binary, n long, cluster int, distance long"), "assigned")
    else:
        own = distinct.select("v", "n", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    sums = {r.cluster: int(r.s) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
    fits = lambda n: n if n < 2**63 else None
    facts = spark.createDataFrame([(c, fits(s), fits(sum(sums.values())), centroids[c].tolist()) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    joined = split_join(rows, own.select("v", "n", "cluster", "distance"), ["v"], F.monotonically_increasing_id())
    if len(centroids):
        discard(distinct)
    return joined.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Iterable[int]) -> str:
    """SHA-256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def query(vectors: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return cluster(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


def oracle(size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """SQL for query()'s rows, the rounds written out."""
    steps = [
        f"""kept as (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as c, v as m
  from (select * from kept order by sha256('{seed}:' || vec_id), v limit {clusters}))""",
        "rows_ as materialized (select row_number() over () as r, vec_id, v from kept)",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d
  from (select r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from rows_, c{i}) group by r)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} as materialized (select c, coalesce(w, m) as m from c{i} left join (select c, list(f order by p) as w
  from (select c, p, cast(floor(sum(x) / count(*)) as bigint) as f from (select a.c, unnest(v) as x, generate_subscripts(v, 1) as p
    from rows_ join a{i} a using (r)) group by c, p) group by c) using (c))"""
            )
    last = f"""select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c) join rows_ using (r)"""
    return "with " + ",\n".join(steps) + "\n" + last
