"""Substring deduplication by level-wise doubling.

A window of 50 words can only repeat where the shorter windows inside it repeat, so lengths double from level to level
(13, 25, 50 words, halves rounded up) and only windows that repeat in another document are extended:

- 13 words: of each 50-word window, the inner windows of least hash. Equal windows have equal ones, so about one window
  in twenty is looked at and no repeat is lost.
- 25 words: each survivor is extended to the left and to the right; every 50-word window around it holds one of the two.
- 50 words: all windows that hold a surviving 25-word window, under 96-bit hashes.

A window survives a level if it occurs in two documents: minimum and maximum by hash, aggregated before the shuffle, so a
passage that a third of all documents share costs each task one row; when survivors are looked up, rows of a hot key are
dealt over many tasks. Exact copies of a text with a smaller doc_id lose
whatever lies in a window and are no sources, for the first of them has the same windows; they are told apart by SHA-256
first, and the levels count texts, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import SPREAD, maybe_in, release, split_join, stored, text_slices
from poolwright.llm.wordarrays import Words, mix, ranges_hash, sliding

WINDOW = 50
_ANCHORS = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("d", pa.int8()), ("left", pa.int64()), ("right", pa.int64())])
_LONGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text string, h1 array<long>, h2 array<int>"
_LONGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("text", pa.string()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int32()))])
_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_DIGEST_ARROW = pa.schema(list(_LONGEST_ARROW)[:5])


def levels(window: int) -> tuple[int, int]:
    """The two lengths below `window`; each is half the next, rounded up."""
    half = (window + 1) // 2
    return (half + 1) // 2, half


def _anchors(window: int):
    first, half = levels(window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, deal = batch.column("t"), batch.column("d")
            for a, b in text_slices(batch):
                words = Words(batch.column("text")[a:b])
                n = len(words.starts)
                if n < window:
                    continue
                short, _ = words.windows(first)
                at = np.arange(n)
                last = words.first[1:][words.doc]
                width = window - first + 1
                least = sliding(short, width, np.minimum)
                least[at[: len(least)] + window > last[: len(least)]] = 0
                padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(n - len(least), np.uint64)])
                chosen = np.flatnonzero((sliding(padded, width, np.maximum)[:n] == short) & (at + first <= last) & (short > 0))
                half_hash, fits = words.windows(half)
                back = chosen - (half - first)
                has_left = back >= words.first[:-1][words.doc[chosen]]
                left = np.where(has_left, half_hash[np.maximum(back, 0)], 0)
                right = np.where(fits[chosen], half_hash[chosen], 0)
                doc = words.doc[chosen]
                _, once = np.unique(mix(mix(mix(short[chosen]) + left) + right) + mix(doc.astype(np.uint64)), return_index=True)
                doc, short, left, right = doc[once], short[chosen][once], left[once], right[once]
                yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64)), ids[a:b].take(pa.array(doc)), deal[a:b].take(pa.array(doc)), pa.array(left.view(np.int64), mask=left == 0), pa.array(right.view(np.int64), mask=right == 0)], schema=_ANCHORS)

    return run


def digest(words: list[bytes], whole: bool) -> tuple[str, str | None]:
    """SHA-256 of the kept words, and with `whole` the words themselves."""
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest(), kept.decode() if whole else None


def _window_hashes(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows at these positions."""
    return ranges_hash(words.hash, at, at + window).view(np.int64), ranges_hash(words.hash, at, at + window, 0xA0761D6478BD642F).astype(np.uint32).view(np.int32)


def _longest(window: int, whole: bool):
    _, half = levels(window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                rows = []
                for doc, text, found, copy_of in zip(batch.column("doc_id")[a:b].to_pylist(), batch.column("text")[a:b], batch.column("found")[a:b], batch.column("copy_of")[a:b].to_pylist(), strict=True):
                    raw = (text.as_py() or "").encode()
                    at = np.zeros(0, np.int64)
                    if copy_of and hashlib.sha256(raw).digest() in copy_of:
                        parts = raw.split()
                        gone = len(parts) if len(parts) >= window else 0
                        rows.append((doc, len(parts), gone, *digest([] if gone else parts, whole), None, None, None))
                        continue
                    if found.is_valid and doc is not None:
                        words = Words(pa.array([raw], pa.binary()))
                        n = len(words.starts)
                        hashes, fits = words.windows(half)
                        hit = np.flatnonzero(fits & np.isin(hashes.view(np.int64), found.values.to_numpy(zero_copy_only=False)))
                        around = np.zeros(n + 1, np.int64)
                        np.add.at(around, np.maximum(hit - (window - half), 0), 1)
                        np.add.at(around, hit + 1, -1)
                        at = np.flatnonzero(np.cumsum(around[:n]) > 0)
                        at = at[at + window <= n]
                    if not len(at):
                        parts = raw.split()
                        rows.append((doc, len(parts), 0, *digest(parts, whole), None, None, None))
                        continue
                    h1, h2 = _window_hashes(words, at, window)
                    _, once = np.unique(mixed(h1, h2), return_index=True)
                    rows.append((doc, n, None, None, None, text.as_py(), h1[once], h2[once]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LONGEST_ARROW, strict=True)], schema=_LONGEST_ARROW)

    return run


def _removed(window: int, whole: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, n, hits in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("n_words").to_pylist(), batch.column("hits"), strict=True):
                raw = text.as_py().encode()
                parts, gone = raw.split(), 0
                if hits.is_valid:
                    words = Words(pa.array([raw], pa.binary()))
                    at = np.arange(max(0, n - window + 1))
                    h1, h2 = _window_hashes(words, at, window)
                    got = hits.values
                    keys = mixed(got.field("h1").to_numpy(zero_copy_only=False), got.field("h2").to_numpy(zero_copy_only=False))
                    hit = at[np.isin(mixed(h1, h2), keys)]
                    covered = np.zeros(n + 1, np.int64)
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + window, -1)
                    over = np.cumsum(covered[:n]) > 0
                    gone = int(over.sum())
                    parts = [w for w, x in zip(parts, over.tolist(), strict=True) if not x]
                rows.append((doc, n, gone, *digest(parts, whole)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST_ARROW, strict=True)], schema=_DIGEST_ARROW)

    return run


def mixed(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One name for a pair within a document: complex numbers would lose bits, so the second half turns the first."""
    return h1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h2.view(np.uint32).astype(np.uint64)


def _repeated(rows: DataFrame, document: str, *key: str) -> DataFrame:
    """The keys that occur in two documents, with the smallest of them and the number of rows."""
    return rows.groupBy(*key).agg(F.min(document).alias("least"), F.max(document).alias("most"), F.count("*").alias("n")).where("least < most").drop("most")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, found array<long>, copy_of array<binary>): the half-length windows of each first text that survive the levels
    below `window`, and the SHA-256 of texts that are copies of an earlier document's."""
    own = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = stored(own.select("doc_id", F.xxhash64("text").alias("t"), F.unhex(F.sha2("text", 256)).alias("s")), "texts")
    firsts = stored(texts.groupBy("s", "t").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "firsts")
    copies = split_join(texts, firsts.where("n > 1"), ["s", "t"], F.xxhash64("doc_id")).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("s").alias("copy_of"))
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("byte").alias("d")
    anchors = own.select(F.xxhash64("text").alias("t"), dealt, "text").mapInArrow(_anchors(window), "h long, t long, d byte, left long, right long")
    first = stored(_repeated(anchors.select("h", "t"), "t", "h").select("h", "n"), "anchors")
    release(docs.sparkSession)
    halves = split_join(anchors, first, ["h"], F.col("d"), "left_semi").select("t", F.explode(F.array("left", "right")).alias("h")).where("h is not null").distinct()
    halves = stored(halves, "halves")
    release(docs.sparkSession)
    second = stored(_repeated(halves, "t", "h").select("h", "n"), "repeated")
    found = split_join(halves, second, ["h"], F.xxhash64("t"), "left_semi").groupBy("t").agg(F.collect_list("h").alias("h"))
    by_doc = firsts.join(found, "t").groupBy(F.col("least").alias("doc_id")).agg(F.flatten(F.collect_list("h")).alias("found"))
    return by_doc.join(copies, "doc_id", "full")


def deduplicate(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of `docs`; kept, the words that stay joined by one space, is
    null if `texts` is false.

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id; windows are judged
    on the input. Null text has no words. A row with null doc_id is kept whole and is no source for others; rows that
    repeat a doc_id are one document by order and so don't remove each other's words. Texts shorter than a window are
    kept; a table without rows gives none; other columns are not read.

    Only texts that may have findings, by a filter of bounded size, are shuffled to them and stored; all others are read
    once more where they lie.
    """
    found = stored(repeats(docs, window), "found")
    marked = maybe_in(docs.select("doc_id", "text"), found, "doc_id")
    judged = marked.where("_maybe").join(found, "doc_id", "left").select("doc_id", "text", "found", "copy_of")
    judged = stored(judged.mapInArrow(_longest(window, texts), _LONGEST), "longest")
    other = marked.where("not _maybe").select("doc_id", "text", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("found", "copy_of")]).mapInArrow(_longest(window, texts), _LONGEST)
    release(docs.sparkSession)
    windows = judged.where("h1 is not null").select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("w")).select("doc_id", "w.h1", "w.h2")
    sources = stored(_repeated(windows, "doc_id", "h1", "h2"), "sources")
    hits = split_join(windows, sources, ["h1", "h2"], F.xxhash64("doc_id")).where("doc_id > least").groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))
    cut = judged.where("h1 is not null").select("doc_id", "text", "n_words").join(hits, "doc_id", "left").select("doc_id", "text", "n_words", "hits")
    done = judged.where("h1 is null").unionAll(other).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    return done.unionAll(cut.mapInArrow(_removed(window, texts), _DIGEST))
