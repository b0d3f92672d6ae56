"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what these links join.

SimHash fingerprints of the sets (64 bits, each shingle once) are searched by BK-trees, as in `simhash`. Two sets of that
similarity have a cosine of 0.889 or more, so a bit differs with a chance of 0.15, in very short texts of 0.19, and more than
RADIUS of 64 do with a chance of about one in 15 million, in very short texts of two in a million. A radius that wide leaves
no blocks of bits to shard by, so shards are texts that share one of BANDS keys, each of ROWS least hashes over all shingles
of the text. At a similarity of 0.8 a pair shares none with a chance of (1 - 0.8^6)^40, or 5 in a million, and with less above.

Every link is confirmed by the similarity of the whole sets. First each text is held against its nearest one in the trees
of its keys, of about BLOCK texts and the key's least one each. Then, where a key still holds texts that aren't joined, they
meet in blocks of about BLOCK: a tree gives all within the radius, and each pair that has this key as its first one and isn't
joined yet is confirmed there, so nothing but links leaves a block. In large blocks, sketches (MARKS bits, one of each least
hash) that differ in more than FAR bits tell pairs apart before their sets are compared: at a similarity of 0.8 one bit in ten
differs, and more than FAR do with a chance of about one in a million.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import discard, plain_rows, release, split_join, stored, text_slices, with_rows
from poolwright.llm.components import components
from poolwright.llm.simhash import BKTree, majority
from poolwright.llm.wordarrays import Words, mix, ranges_hash

WORDS, SIMILARITY, RADIUS, BANDS, ROWS, MARKS, FAR, BLOCK = 5, 0.8, 28, 40, 6, 512, 85, 1024
_ALL = 0xFFFFFFFFFFFFFFFF
_TURNS = np.random.default_rng(5).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MARK_TURNS = np.random.default_rng(6).integers(0, 2**64, MARKS, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEYS = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each shingle of all texts and where each text's run starts (one more at the end). ASCII case is
    folded; a text of fewer words than a shingle is one, a text without words has none."""
    own = Words(column, fold=_FOLD)
    hashes, fits = own.windows(words)
    n = np.diff(own.first)
    short = np.flatnonzero((n > 0) & (n < words))
    at = own.first[:-1][short]
    hashes[at] = ranges_hash(own.hash, at, own.first[1:][short])
    fits[at] = True
    return hashes[fits], np.concatenate([[0], np.cumsum(np.where(n < words, np.minimum(n, 1), n - words + 1))])


def fingerprints(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each text's set of shingles, as a signed long; 0 for texts without words."""
    sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return majority(np.concatenate(sets) if sets else values, np.array([len(s) for s in sets], np.int64))


def band_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The keys of each text, a row of BANDS; all texts without words have the same."""
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(first) - 1, axis=0)
    held = np.flatnonzero(np.diff(first))
    if len(held):
        for i, turn in enumerate(_TURNS):
            out[held, i // ROWS] = mix(out[held, i // ROWS] + np.minimum.reduceat(values * turn, first[held]))
    return out.view(np.int64)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MARKS bits of each text, as a row of 64-bit numbers; 0 for texts without words."""
    bits = np.zeros((len(first) - 1, MARKS), np.uint8)
    held = np.flatnonzero(np.diff(first))
    if len(held):
        for i, turn in enumerate(_MARK_TURNS):
            bits[held, i] = (mix(np.minimum.reduceat(values * turn, first[held]) + turn) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch):
            values, first = shingles(batch.column("text")[a:b])
            keys, own = band_keys(values, first), pa.array(fingerprints(values, first))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("tag")[a:b], own, lists], schema=_KEYS)


def _nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and part to pairs: each text with its nearest one within the radius in a BK-tree of the key's least
    text and those before it."""
    group, tree, tags = None, BKTree(RADIUS), []
    for batch in batches:
        out = []
        for key, part, tag, fp, least, least_fp in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "tag", "fp", "least", "least_fp")), strict=True):
            if (key, part) != group:
                group, tree, tags = (key, part), BKTree(RADIUS), [least]
                tree.insert(least_fp & _ALL)
            if tag != least:
                near = tree.nearest(fp & _ALL)
                if near is not None:
                    out.append((tag, tags[near]))
                tree.insert(fp & _ALL)
                tags.append(tag)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Have two sets, sorted, the similarity asked for? Two empty ones have."""
    small, large = sorted((len(x), len(y)))
    if small < SIMILARITY * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (small + large - both)


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, right = None, None
    for batch in batches:
        out = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            if b != held:
                held, right = b, np.unique(shingles(pa.array([y.as_py()], pa.string()))[0])
            if alike(np.unique(shingles(pa.array([x.as_py()], pa.string()))[0]), right):
                out.append((a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)


def _met(key: int, blocks: list[int], tags: list[int], roots: list[int], fps: list[int], keys: np.ndarray, texts: pa.Array) -> list[tuple[int, int]]:
    """The links between texts of one key and block, or pair of blocks, that aren't joined; a BK-tree gives the pairs."""
    hashes, first = shingles(texts)
    sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    marks = sketches(hashes, first) if len(tags) > 24 else None
    join: dict[int, int] = {}
    tree = BKTree(RADIUS)
    tree.insert(fps[0] & _ALL)

    def find(x: int) -> int:
        while (y := join.get(x, x)) != x:
            x = y
        return x

    number = np.asarray(blocks)
    whole, out, root = bool((number == number[0]).all()), [], np.asarray(roots)
    for k in range(1, len(tags)):
        at = np.sort(np.array(tree.add(fps[k] & _ALL), np.int64))
        at = at[(root[at] != root[k]) & (whole | (number[at] != number[k]))]
        if marks is not None:
            at = at[np.bitwise_count(marks[at] ^ marks[k]).sum(axis=1) <= FAR]
        same = keys[at] == keys[k]
        at = at[keys[k][same.argmax(axis=1)] == key]  # the first key that both have
        for i in at.tolist():
            a, b = find(roots[i]), find(roots[k])
            if a != b and alike(sets[i], sets[k]):
                join[a] = b
                out.append((max(tags[i], tags[k]), min(tags[i], tags[k])))
    return out


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, lo and hi to the links of each block, or pair of blocks."""
    group, held = None, []

    def done() -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
        if rows is None or rows.num_rows < 2:
            return []
        keys = pa.concat_arrays([rows.column("keys")]).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
        return _met(group[0], rows.column("block").to_pylist(), rows.column("tag").to_pylist(), rows.column("root").to_pylist(), rows.column("fp").to_pylist(), keys, rows.column("text"))

    for batch in batches:
        names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True))
        at, out = 0, []
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[at]:
                if names[at] != group:
                    out += done()
                    group, held = names[at], []
                held.append(batch.slice(at, i - at))
                at = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)
    if out := done():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)


def links(keyed: DataFrame, firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): text hashes of texts of `rows` (id, row) that share a key of `keyed` (id, tag, fp, keys) and are alike. Pairs that
    other links join already are not all among them. `firsts` (id, tag) names one row of each text, so copies have no keys."""
    one = stored(keyed.join(firsts, "id", "left_semi").select("id", "tag", "fp", "keys"), "one")
    each = one.select(F.explode("keys").alias("key"), "tag", "fp")
    shared = each.groupBy("key").agg(F.min(F.struct("tag", "fp")).alias("l"), F.max("tag").alias("most"), F.count("*").alias("n")).where("l.tag < most")
    shared = stored(shared.select("key", F.col("l.tag").alias("least"), F.col("l.fp").alias("least_fp"), F.ceil(F.col("n") / BLOCK).alias("parts"), "n"), "shared")
    members = stored(split_join(each, shared, ["key"], F.xxhash64("tag")).withColumn("part", F.pmod(F.xxhash64("tag"), "parts")).drop("parts"), "members")
    texts = stored(rows.select("id", F.col("row.text").alias("text")).join(one.join(members.select("tag").distinct(), "tag", "left_semi").select("id", "tag"), "id").select("tag", "text"), "texts")
    release(rows.sparkSession)

    def confirm(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("tag").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("tag").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(sides.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long"), "links")

    shards = members.repartition("key", "part").sortWithinPartitions("key", "part", "tag")
    tried = stored(shards.mapInArrow(_nearest, "a long, b long").distinct(), "pairs")
    sure = confirm(tried)
    release(rows.sparkSession)
    roots = components(sure)
    named = members.join(roots, members.tag == roots.node, "left").select("key", "tag", F.coalesce("root", "tag").alias("root"))
    open_ = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2")
    left = stored(named.join(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks")), "key").withColumn("block", F.pmod(F.xxhash64("tag"), "n_blocks").cast("int")), "open")
    spread = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "tag", "root")
    facts = one.select("tag", "fp", "keys").join(texts, "tag")
    met = spread.join(facts, "tag").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = stored(met.select("key", "lo", "hi", "block", "tag", "root", "fp", "keys", "text").mapInArrow(_blocks, "a long, b long"), "links")
    discard(texts, members, tried, left, roots, one, shared)
    return sure.unionAll(more)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, of which no other row joined to them by links comes first: by doc_id (null last), then
    by text hash. Rows equal in both are copies, of which one stays. Null text counts as empty; texts without words are
    copies of each other. An empty table gives no rows; columns of any name are carried.

    Rows are stored once under a number each. Groups are decided on narrow columns, and what goes is taken out by its
    number, so whole rows are neither aggregated nor, where little goes, shuffled.
    """
    rows = with_rows(docs)
    narrow = rows.select("id", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("tag"), F.col("row.text").alias("text"))
    keyed = stored(narrow.mapInArrow(_keyed, "id long, doc_id long, tag long, fp long, keys array<long>"), "keyed")
    firsts = stored(keyed.groupBy("tag").agg(F.min("id").alias("id"), F.count("*").alias("n")), "firsts")
    roots = components(links(keyed, firsts, rows))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", "id")
    labels = stored(firsts.join(roots, firsts.tag == roots.node, "left").select("tag", "n", F.coalesce("root", "tag").alias("root")), "labels")
    named = split_join(keyed.select("id", "doc_id", "tag"), labels, ["tag"], F.col("id"))
    first = named.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias("id"))
    gone = stored(keyed.select("id").join(first, "id", "left_anti"), "gone")
    discard(keyed, roots, firsts, labels)
    return plain_rows(rows.join(gone, "id", "left_anti"))
