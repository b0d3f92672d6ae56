"""SimHash near-duplicates by BK-trees.

Fingerprints at 3 or fewer differing bits agree in one of four 16-bit blocks, so each block value is a shard: the
distinct fingerprints that share it come together, one BK-tree is built of them (children keyed by their Hamming distance
to the parent), and a search follows only edges within the radius. The trees stay where their queries are instead of
being broadcast, since all trees together grow with the corpus. A shard of more than SHARD fingerprints is split by the
same law over its remaining bits, down to 15 bits, where a shard's size is bounded by the bits themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import plain_rows, stored, text_slices, utf8, with_rows
from poolwright.llm.components import components

RADIUS, WORDS, SHARD = 3, 3, 4096
_FP = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints(docs: DataFrame, words: int = WORDS, number: str | None = None) -> DataFrame:
    """(id, doc_id, tag, fp): id is the column `number`, null where none is named; tag is a hash of the text, fp the 64 bits as a signed long. A bit is 1 if set in over half the shingles' XXH64 (seed 42); null or
    blank text: 0; fewer words than a shingle: the whole sequence is one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for a, b in text_slices(batch):
                hashes, counts = [], []
                for text in utf8(batch.column("text")[a:b]):
                    parts = text.lower().split()
                    joined, n = b" ".join(parts), len(parts)
                    if n <= words:
                        counts.append(1 if n else 0)
                        if n:
                            hashes.append(digest(joined, 42))
                        continue
                    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, n)) + np.arange(n)).tolist()
                    starts = [0, *[e + 1 for e in ends[: n - words]]]
                    hashes += [digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=True)]
                    counts.append(n - words + 1)
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("tag")[a:b], pa.array(majority(np.array(hashes, np.uint64), np.array(counts)))], schema=_FP)

    own = F.col(number) if number else F.lit(None)
    return docs.select(own.cast("long").alias("id"), "doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "id long, doc_id long, tag long, fp long")


def majority(hashes: np.ndarray, counts: np.ndarray, step: int = 200_000) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes."""
    ends = np.cumsum(counts)
    sums = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), step):  # bounded unpacking, also within one long text
        part = hashes[at : at + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        owner = np.searchsorted(ends, np.arange(at, at + len(part)), "right")
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        sums[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


class BKTree:
    """64-bit values, children keyed by their Hamming distance to the parent; searches follow only edges within the radius."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> list[int]:
        """Takes a value in and gives those within the radius that came before."""
        near = self.within(value)
        self.insert(value)
        return near

    def within(self, value: int) -> list[int]:
        near, radius, values, children = [], self.radius, self.values, self.children
        stack = [0] if values else []
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                near.append(node)
            stack += [c for k, c in children[node].items() if -radius <= d - k <= radius]
        return near

    def nearest(self, value: int) -> int | None:
        """The nearest value within the radius, which shrinks with what is found."""
        best, radius, values, children = None, self.radius + 1, self.values, self.children
        stack = [(0, 0)] if values else []
        while stack:
            least, node = stack.pop()
            if least >= radius:
                continue
            d = (values[node] ^ value).bit_count()
            if d < radius:
                best, radius = node, d
                if not d:
                    break
            stack += sorted(((abs(d - k), c) for k, c in children[node].items() if abs(d - k) < radius), reverse=True)
        return best

    def insert(self, value: int) -> None:
        values, children, at, new = self.values, self.children, 0, len(self.values)
        while new:
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = new
                break
            at = children[at][d]
        values.append(value)
        children.append({})


def _trees(radius: int):
    """Sorted (path, fp) rows to a spanning forest of each shard's links: one row for each value that has a link."""

    def forest(values: list[int]) -> list[tuple[int, int]]:
        tree, root = BKTree(radius), list(range(len(values)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, v in enumerate(values):
            for j in tree.add(v & 0xFFFFFFFFFFFFFFFF):
                root[find(j)] = find(i)
        return [(values[i], values[find(i)]) for i in range(len(values)) if find(i) != i]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, values, out = None, [], []
        for batch in batches:
            for p, v in zip(batch.column("path").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if p != path:
                    if len(values) > 1:
                        out += forest(values)
                    path, values = p, []
                values.append(v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)
                out = []
        if len(values) > 1 and (out := forest(values)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)

    return run


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of the blocks that `width` bits fall into."""
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(x: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else x


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that join all within `radius` bits of each other into the same
    components; one row at most for each fingerprint and shard, never all pairs of a group."""
    parts = radius + 1
    rows, width, out = distinct.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("path")), 64, None
    while True:
        spread = []
        for k, (start, w) in enumerate(_blocks(width, parts)):
            low = _bits(F.col("rest"), 0, start) if start else F.lit(0).cast("long")
            high = F.shiftrightunsigned("rest", start + w) if start + w < width else F.lit(0).cast("long")
            spread.append(F.struct(F.shiftleft(high, start).bitwiseOR(low).alias("rest"), F.xxhash64("path", F.lit(width + k), _bits(F.col("rest"), start, w)).alias("path")))
        keyed = rows.select("fp", F.explode(F.array(*spread)).alias("s")).select("fp", "s.rest", "s.path")
        width -= min(w for _, w in _blocks(width, parts))
        big = keyed.groupBy("path").count().where(F.col("count") > shard).select("path") if width > 15 else None
        big = stored(big, "shards") if big is not None else None
        more = big is not None and not big.isEmpty()
        small = keyed.join(big, "path", "left_anti") if more else keyed
        pairs = small.select("path", "fp").repartition("path").sortWithinPartitions("path", "fp").mapInArrow(_trees(radius), "a long, b long")
        out = pairs if out is None else out.unionAll(pairs)
        if not more:
            return out
        rows = stored(keyed.join(big, "path", "left_semi").select("fp", "rest", "path"), "shards")


def classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, number: str | None = None) -> DataFrame:
    """One row for each document: id (the column `number`, if one is named), doc_id, tag (hash of the text), fp (signed long), root (a fingerprint that names the class),
    component_id (smallest doc_id reachable over links of at most `radius` bits, itself included).

    Equal fingerprints are one node, so copies are never paired. Null text counts as empty; all texts without words share
    fingerprint 0 and are linked like any other. A null doc_id is carried and never names a component unless all its
    members' are null; repeated doc_ids are rows of their own. An empty table gives no rows; other columns aren't read.
    """
    own = stored(fingerprints(docs, words, number), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, radius))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(best, "root").select("fp", "root", "component_id")
    return own.join(label, "fp").select("id", "doc_id", "tag", "fp", "root", "component_id")


def representatives(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, all columns, of which no other row in the same class comes first: by doc_id (null last), then by
    text hash. Rows equal in both are copies, of which one stays. Null text counts as empty; an empty table gives no rows;
    columns of any name are carried."""
    rows = with_rows(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", "id")
    named = classes(rows.select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), words, radius, "id")
    first = named.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias("id"))
    gone = stored(rows.select("id").join(first, "id", "left_anti"), "gone")
    return plain_rows(rows.join(gone, "id", "left_anti"))


def query(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
