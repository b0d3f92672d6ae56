"""Exact top-k search by inner product over M-trees.

Vectors are quantised to whole numbers and dealt to cells, the nearest of a bounded sample of pivots; a crowded cell is cut
into parts, so that one tree holds about SHARD vectors. Each cell part becomes one M-tree, stored as one row: pages of at
most PAGE entries, where a routing entry has a centre object, the radius that covers what is below it and the distance to its
parent's centre, and a leaf entry has an object and that distance.

Queries come in blocks of bounded size, each broadcast to the tasks that read the stored trees. A search is best first: pages
wait in a heap under an upper bound of the scores below them. With d the Euclidean distance, |q| and |x| lengths, and x
within r of centre c:

    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2   and   q.x <= q.c + |q| r

where d(q, x) >= |d(q, p) - d(c, p)| - r for the parent's centre p. The last needs stored distances only, so an entry that
can't reach the best k so far is passed over before its distance is computed. The best k go from tree to tree within a task,
and begin with those of the pivot sample. Rounding only ever widens a bound; scores are whole numbers throughout, and equal
scores go by vec_id, which pages bound too, so that copies by the million end a search early as well.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolwright.llm.common import shared_dir, stored
from poolwright.llm.vectors import Scaled, packed, unpacked

SCALE, K, EVERY = 1024, 10, 100
#: Vectors of a tree, entries of a page, most pivots sampled, queries sent to the tasks at once.
SHARD, PAGE, PIVOTS, BLOCK = 2048, 64, 1024, 8192
#: A query row that occurs more often is written out by several tasks.
TIMES = 4096
#: A vector whose squared length isn't below this takes no part: its scores may not fit a long.
LONGEST = 2.0**62
#: Stands for a null vec_id, which comes after all others.
_LAST = 2**63 - 1
_ROWS = "vec_id long, size int, v binary, cell int"
_ROWS_ARROW = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("v", pa.binary()), ("cell", pa.int32())])
_TREE = "size int, ids binary, copies binary, vectors binary, entry_object binary, entry_radius binary, entry_parent binary, entry_longest binary, entry_least binary, entry_page binary, page_first binary"
_TREE_ARROW = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.binary()) for x in _TREE.split(", ")])
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("times", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Tree:
    """An M-tree over distinct (vec_id, vector) rows. Entries of page p are those from page_first[p] to page_first[p + 1];
    entry_page is the page below a routing entry and -1 in leaves. Page 0 is the root, which has one entry."""

    FIELDS = {"ids": np.int64, "copies": np.int64, "entry_object": np.int64, "entry_radius": float, "entry_parent": float, "entry_longest": float, "entry_least": np.int64, "entry_page": np.int64, "page_first": np.int64}

    def __init__(self, size: int, vectors: np.ndarray, **arrays: np.ndarray):
        self.size, self.vectors = size, vectors
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.points = vectors.astype(float)
        self.squares = (self.points**2).sum(axis=1)
        self.centres = self.points[self.entry_object]
        self.most = math.sqrt(self.squares.max(initial=0))
        self.repeated = bool((self.copies > 1).any())

    @classmethod
    def build(cls, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, page: int = PAGE) -> Tree:
        points = vectors.astype(float)
        squares = (points**2).sum(axis=1)
        lengths = np.sqrt(squares)

        def far(at: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(np.maximum(((points[at] - points[centre]) ** 2).sum(axis=1), 0))

        def middle(at: np.ndarray) -> int:
            """The object nearest the mean: a centre with a small radius."""
            return int(at[((points[at] - points[at].mean(axis=0)) ** 2).sum(axis=1).argmin()])

        def groups(at: np.ndarray) -> list[np.ndarray]:
            """At most a page of parts, each smaller: around objects far from each other, or by vec_id where all are equal."""
            count = min(page, -(-len(at) // (page // 2)))
            chosen = [int(at[0])]
            near = far(at, chosen[0])
            own = np.zeros(len(at), np.int64)
            while len(chosen) < count and near.max() > 0:
                new = int(near.argmax())
                chosen.append(int(at[new]))
                d = far(at, chosen[-1])
                own[d < near] = len(chosen) - 1
                near = np.minimum(near, d)
            if len(chosen) == 1:
                return np.array_split(at, count)
            parts = [at[own == i] for i in range(len(chosen))]
            return [x for x in parts if len(x)]

        entries: list[list[tuple]] = [[]]

        def routing(at: np.ndarray, parent: int | None) -> tuple:
            c = middle(at)
            below = len(entries)
            entries.append([])
            if len(at) <= page:
                entries[below] = [(int(i), 0.0, float(d), float(lengths[i]), int(ids[i]), -1) for i, d in zip(at, far(at, c), strict=True)]
            else:
                entries[below] = [routing(x, c) for x in groups(at)]
            return (c, float(far(at, c).max()), 0.0 if parent is None else float(far(np.array([c]), parent)[0]), float(lengths[at].max()), int(ids[at].min()), below)

        order = np.lexsort((ids,))
        entries[0] = [routing(order, None)]
        flat = [e for p in entries for e in p]
        columns = zip(*flat, strict=True)
        arrays = dict(zip(("entry_object", "entry_radius", "entry_parent", "entry_longest", "entry_least", "entry_page"), columns, strict=True))
        arrays |= {"ids": ids, "copies": copies, "page_first": np.cumsum([0, *map(len, entries)])}
        return cls(vectors.shape[1], vectors, **{k: np.asarray(arrays[k], t) for k, t in cls.FIELDS.items()})

    def row(self) -> dict[str, bytes]:
        width = 2 if np.abs(self.vectors).max(initial=0) < 2**15 else 8
        return {"size": self.size, "vectors": self.vectors.astype(f"<i{width}").tobytes()} | {k: getattr(self, k).tobytes() for k in self.FIELDS}

    @classmethod
    def read(cls, row: dict) -> Tree:
        arrays = {k: np.frombuffer(row[k], t) for k, t in cls.FIELDS.items()}
        n, size = len(arrays["ids"]), row["size"]
        width = len(row["vectors"]) // (n * size) if n * size else 2
        return cls(size, np.frombuffer(row["vectors"], f"<i{width}").reshape(n, size).astype(np.int64), **arrays)

    def search(self, query: Query) -> int:
        """Brings the query's best up to date with this tree; returns how many distances were computed."""
        if query.size != self.size:
            return 0
        q, qq, length = query.point, query.square, query.length
        exact = length * self.most < 2**53
        slack = 1e-9 * (qq + self.most**2) + 1e-6
        done, heap = 0, [(-math.inf, 0, 0, 0.0)]
        while heap:
            bound, least, page, to_centre = heapq.heappop(heap)
            if not query.open(-bound, least):
                break
            at = np.arange(self.page_first[page], self.page_first[page + 1])
            radius, longest = self.entry_radius[at], self.entry_longest[at]
            if page:
                gap = np.maximum(np.abs(to_centre - self.entry_parent[at]) - radius, 0)
                at = at[(qq + longest**2 - gap**2) / 2 + slack >= query.worst]
                radius, longest = self.entry_radius[at], self.entry_longest[at]
                if not len(at):
                    continue
            done += len(at)
            objects = self.entry_object[at]
            score = (self.centres[at] @ q).astype(np.int64) if exact else self.vectors[objects] @ query.vector
            if self.entry_page[at[0]] < 0:
                hit = np.flatnonzero(score >= query.worst)
                for i in hit[np.lexsort((self.ids[objects[hit]], -score[hit]))].tolist():
                    s, o = int(score[i]), int(objects[i])
                    if not query.offer(s, int(self.ids[o]), int(self.copies[o]), self.vectors[o]):
                        break
                continue
            away = np.sqrt(np.maximum(qq + self.squares[objects] - 2.0 * score, 0))
            by_length = (qq + longest**2 - np.maximum(away - radius, 0) ** 2) / 2 + slack
            upper = np.minimum(by_length, score + length * radius * (1 + 1e-9) + (0 if exact else slack))
            for i, (u, least, below, d) in enumerate(zip(upper.tolist(), self.entry_least[at].tolist(), self.entry_page[at].tolist(), away.tolist(), strict=True)):
                if query.open(u, least):
                    heapq.heappush(heap, (-u, least, below, d))
        return done


class Query:
    """One query row and its best k so far, as (-score, vec_id) in order; `floor` is a rank that the best k reach for certain."""

    def __init__(self, number: int, vec_id: int, times: int, vector: np.ndarray, k: int):
        self.number, self.vec_id, self.times, self.vector, self.k = number, vec_id, times, vector, k
        self.size, self.point = len(vector), vector.astype(float)
        self.square = float(self.point @ self.point)
        self.length = math.sqrt(self.square)
        self.best: list[tuple[int, int]] = []
        self.floor: tuple[float, int] = (math.inf, 0)

    @property
    def worst(self) -> float:
        return -min(self.best[-1][0], self.floor[0]) if len(self.best) == self.k else -self.floor[0]

    def open(self, upper: float, least: int) -> bool:
        """May a row with a score of at most `upper` and an id of at least `least` be among the best?"""
        return (-upper, least) <= self.floor and (len(self.best) < self.k or (-upper, least) < self.best[-1])

    def own(self, vec_id: int, vector: np.ndarray) -> bool:
        return vec_id == self.vec_id and np.array_equal(vector, self.vector)

    def offer(self, score: int, vec_id: int, copies: int, vector: np.ndarray) -> bool:
        """Takes a row with its copies, the query's own row excepted; false if nothing after it in order can be taken."""
        if not self.open(score, vec_id):
            return False
        copies -= self.own(vec_id, vector)
        if copies:
            self.best = sorted(self.best + [(-score, vec_id)] * min(copies, self.k))[: self.k]
        return True

    def begin(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Sets the floor by a sample of rows, which the trees hold too."""
        score = vectors @ self.vector
        order = np.lexsort((ids, -score))[: self.k + 1].tolist()
        mine = next((i for i in order if self.own(int(ids[i]), vectors[i])), None)
        order = [i for i in order if i != mine]
        if len(order) >= self.k:
            self.floor = (-int(score[order[self.k - 1]]), int(ids[order[self.k - 1]]))


def _quantised(scale: int, pivots: dict[int, np.ndarray]):
    """Rows with their cells: the nearest pivot of their size, numbered through; -1 where there is none."""
    starts, n = {}, 0
    for size, p in pivots.items():
        starts[size], n = n, n + len(p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Scaled(batch.column("embedding"), scale)
            for size in np.unique(own.size[own.whole]).tolist():
                at = np.flatnonzero(own.whole & (own.size == size))
                rows = own.rows(at, size)
                with np.errstate(over="ignore"):
                    fits = (rows**2).sum(axis=1) < LONGEST
                at, rows = at[fits], rows[fits]
                if size in pivots:
                    p = pivots[size].astype(float)
                    cell = starts[size] + ((p**2).sum(axis=1) - 2 * (rows @ p.T)).argmin(axis=1)
                else:
                    cell = np.full(len(at), -1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()).take(pa.array(at)), pa.array(np.full(len(at), size), pa.int32()), pa.array(packed(rows.astype(np.int64)), pa.binary()), pa.array(cell, pa.int32())], schema=_ROWS_ARROW)

    return run


def rows_of(vectors: DataFrame, scale: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    return vectors.select("vec_id", "embedding").mapInArrow(_quantised(scale, pivots), _ROWS)


def _build(page: int):
    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        ids = pc.fill_null(rows.column("vec_id"), _LAST).to_numpy()
        tree = Tree.build(ids, rows.column("copies").to_numpy(), unpacked(rows.column("v").to_pylist(), size), page)
        return pa.Table.from_pylist([tree.row()], schema=_TREE_ARROW)

    return run


def index(vectors: DataFrame, scale: int = SCALE, shard: int = SHARD, page: int = PAGE, most_pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(stored distinct rows, stored trees, ids and vectors of the pivot sample by size): every row that takes part is in one
    tree.

    The sample is of at most `most_pivots` rows, those of least hash; it decides which rows lie together, not what is found.
    """
    count = vectors.count()
    sample = rows_of(vectors, scale, {}).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(max(1, min(most_pivots, -(-count // shard)))).collect()
    by_size = {size: [r for r in sample if r["size"] == size] for size in sorted({r["size"] for r in sample})}
    pivots = {size: (np.array([_LAST if r.vec_id is None else r.vec_id for r in own]), unpacked([bytes(r.v) for r in own], size)) for size, own in by_size.items()}
    rows = stored(rows_of(vectors, scale, {size: p for size, (_, p) in pivots.items()}).groupBy("cell", "size", "vec_id", "v").agg(F.count("*").alias("copies")), "vectors")
    cells = rows.groupBy("cell", "size").agg(F.count("*").alias("n"))
    parts = rows.join(cells, ["cell", "size"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / shard).cast("long")))
    trees = parts.select("cell", "size", "part", "vec_id", "v", "copies").groupBy("cell", "size", "part").applyInArrow(_build(page), _TREE)
    return rows, stored(trees, "trees"), pivots


def _found(queries: list[Query]) -> pa.RecordBatch:
    rows = [(x.number, x.vec_id, x.times, None if i == _LAST else i, -s) for x in queries for s, i in x.best]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _FOUND, strict=True)], schema=_FOUND)


def _searching(block, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sample = block.value
        queries = [Query(n, i, t, unpacked([v], size)[0], k) for n, i, t, size, v in asked]
        for query in queries:
            if query.size in sample:
                query.begin(*sample[query.size])
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.read(row)
                for query in queries:
                    tree.search(query)
        if any(x.best for x in queries):
            yield _found(queries)

    return run


def search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, shard: int = SHARD, page: int = PAGE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the `k` rows of highest integer
    inner product of floor(scale * x) vectors, its own row excepted; ties to the smaller vec_id.

    Vectors that are null, hold a null, infinite or NaN component, or are so long that scores may not fit a long take no
    part; vectors of different sizes have no product and don't meet. A row is its vec_id and vector: rows that repeat both
    are each a query, and candidates of each other; rows that share a vec_id alone are different rows. A null vec_id is no
    query, and as a candidate comes after all ids. Fewer than `k` candidates give fewer rows, an empty table none; other
    columns aren't read.
    """
    spark = vectors.sparkSession
    rows, trees, sample = index(vectors, scale, shard, page)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // block))
    asked = stored(asked.select(F.monotonically_increasing_id().alias("query"), "vec_id", "copies", "size", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block")), "queries")
    found_at = f"{shared_dir(spark)}/poolwright/found-{uuid.uuid4().hex}"
    kind = "query long, query_id long, times long, vec_id long, score long"
    for b in range(blocks):
        part = [(r.query, r.vec_id, r.copies, r["size"], bytes(r.v)) for r in asked.where(F.col("block") == b).collect()]
        sent = spark.sparkContext.broadcast((part, sample))
        trees.mapInArrow(_searching(sent, k), kind).write.mode("append").parquet(found_at)
        sent.unpersist()
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = stored(spark.read.schema(kind).parquet(found_at).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    few = best.where(F.col("times") <= TIMES).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    chunks = best.where(F.col("times") > TIMES).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), F.lit(TIMES).cast("long")))).repartition("query", "rank", "_from")
    many = chunks.withColumn("_each", F.explode(F.sequence("_from", F.least("times", F.col("_from") + TIMES - 1)))).drop("_from")
    return few.unionByName(many).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors)


ORACLE = f"""with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % {EVERY} = 0 and q.r <> c.r and len(q.e) = len(c.e)),
w as (select *, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as integer) as rank from s)
select query_id, rank, vec_id, score from w where rank <= {K}"""
