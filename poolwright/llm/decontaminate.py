"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased, so punctuation and case don't matter. One
pass over the corpus counts in how many documents each n-gram of the items occurs. An item's seeds are its n-grams that
are rare for it: at most RARE times the median of its own counts, so that an item which leaked into a third of all
documents keeps its seeds while phrases of common words lose theirs. A second pass finds the seeds of each document and
aligns the words around them with the item. What is broadcast is the items alone; it is measured first, and a larger
benchmark is run in blocks of items of at most BLOCK_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import text_slices
from poolwright.llm.wordarrays import Words, forget_powers

SEED_WORDS, RARE, SCORE, BLOCK_BYTES = 4, 4.0, 0.6, 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_SPLIT = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_FOUND = "doc_id long, item_id long, score double, word_start long, word_end long"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("word_start", pa.int64()), ("word_end", pa.int64())])


@dataclass
class Items:
    """The test items of a block: word hashes end to end, and the n-grams at each position. An item of fewer words than n is
    one gram of its own length; `sizes` are the lengths in use."""

    ids: list[int]
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray
    sizes: list[int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> Items:
        words = _words(pa.array([t or "" for _, t in rows], pa.string()))
        size = np.diff(words.first)
        hashes, fits = words.windows(n)
        short = np.unique(size[(size > 0) & (size < n)]).tolist()
        for k in short:
            own, starts = words.windows(k)[0], words.first[:-1][size == k]
            hashes[starts], fits[starts] = own[starts], True
        at = np.flatnonzero(fits)
        return cls([i for i, _ in rows], words.hash, words.first, hashes[at], at, [*short, n])

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def _words(column: pa.Array) -> Words:
    return Words(pc.utf8_lower(pc.fill_null(column, "")), _SPLIT)


class Lookup:
    """Which of many hashes are in a small sorted set: a bit table first, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[hashes >> np.uint64(44)])
        spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        return at[self.keys[spot] == hashes[at]]


def _gram_hits(words: Words, lookup: Lookup, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where in the words a gram of the set begins, and its hash."""
    at, found = [], []
    for k in sizes:
        hashes, fits = words.windows(k)
        here = lookup.find(hashes)
        here = here[fits[here]]
        at.append(here)
        found.append(hashes[here])
    return np.concatenate(at), np.concatenate(found)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best score and the passage words [start, end) it covers. A row of the matrix is
    one numpy step: gaps along the passage are a running maximum. The start is carried along with the score."""
    n = len(passage)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    shift, best = np.arange(n + 1) * -GAP, (0, 0, 0)
    for word in item:
        step = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = score[1:] + GAP
        row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        row[1:] = np.maximum(np.maximum(step, down), 0)
        start[1:] = np.where(row[1:] == 0, start[1:], np.where(step >= down, begin[:-1], begin[1:]))
        lifted = row + shift
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, begin = top - shift, start[source]
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(begin[at]), at)
    return best


def _counts(items: Items):
    """How many documents of a task hold each n-gram of the items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(items.grams)
        seen = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for a, b in text_slices(batch):
                words = _words(batch.column("text")[a:b])
                at, hashes = _gram_hits(words, lookup, items.sizes)
                gram = np.searchsorted(lookup.keys, hashes)
                seen += np.bincount(np.unique(np.stack([words.doc[at], gram]), axis=1)[1], minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(lookup.keys.view(np.int64)), pa.array(seen)], names=["gram", "n"])

    return run


def rare_seeds(items: Items, counts: dict[int, int], rare: float = RARE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and item positions of the n-grams that are rare for their item."""
    n = np.array([counts.get(int(g), 0) for g in items.grams.view(np.int64)], np.float64)
    owner = items.owner(items.gram_at)
    keep = np.zeros(len(n), bool)
    for i in np.unique(owner):
        own = owner == i
        keep |= own & (n <= rare * max(1.0, np.median(n[own])))
    return items.grams[keep], items.gram_at[keep]


class Aligner:
    """Finds the seeds of a block of items in texts and aligns the words around them."""

    def __init__(self, items: Items, grams: np.ndarray, positions: np.ndarray, threshold: float):
        order = np.argsort(grams, kind="stable")
        self.items, self.threshold, self.lookup = items, threshold, Lookup(grams)
        self.grams, self.owner = grams[order], items.owner(positions[order])
        self.offset, self.length = positions[order] - items.first[self.owner], np.diff(items.first)

    def find(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, end word) of the passages that reach the threshold, the best for row and item."""
        items, words = self.items, _words(column)
        at, hashes = _gram_hits(words, self.lookup, items.sizes)
        if not len(at):
            return []
        low, high = np.searchsorted(self.grams, hashes, "left"), np.searchsorted(self.grams, hashes, "right")
        at = np.repeat(at, high - low)
        k = np.concatenate([np.arange(x, y) for x, y in zip(low, high, strict=True)])
        doc, item, start = words.doc[at], self.owner[k], at - self.offset[k]  # start: where the item would begin
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        # hits of one document and item whose beginnings lie within an item's length of each other are one passage
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start) > self.length[item[1:]])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        heads = np.flatnonzero(new)
        for x, y in zip(heads, [*heads[1:], len(doc)], strict=True):
            d, i = int(doc[x]), int(item[x])
            own, base = items.words[items.first[i] : items.first[i + 1]], int(words.first[d])
            left = max(base, int(start[x]) - len(own) // 2)
            right = min(int(words.first[d + 1]), int(start[y - 1]) + 3 * len(own) // 2 + 1)
            score, s, e = align(own, words.hash[left:right])
            share = score / (MATCH * len(own))
            if share >= self.threshold and share > best.get((d, i), (0.0,))[0]:
                best[d, i] = (share, left + s - base, left + e - base)
        return [(d, i, *x) for (d, i), x in best.items()]


def _aligned(aligner: Aligner):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                ids = batch.column("doc_id")[a:b]
                rows = [(ids[d].as_py(), aligner.items.ids[i], *x) for d, i, *x in aligner.find(batch.column("text")[a:b])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def _kept(aligner: Aligner):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, b in text_slices(batch):
                keep[[a + x[0] for x in aligner.find(batch.column("text")[a:b])]] = False
            yield batch.filter(pa.array(keep))

    return run


def _aligners(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, block: int) -> Iterator[Aligner]:
    """One for each block of items of about `block` bytes; the seed counts are those of all of `docs`."""
    own, tests = docs.select("text"), benchmark.select("item_id", "text")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block + 1
    for k in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = Items.of([(r.item_id, r.text) for r in part.collect()], n)
        if len(items.grams):
            counted = own.mapInArrow(_counts(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            grams, positions = rare_seeds(items, {r.gram: r.n for r in counted.collect()})
            forget_powers()
            if len(grams):
                yield Aligner(items, grams, positions, threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, threshold: float = SCORE, block: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, word_start, word_end): documents with a passage that aligns with a test item.

    `score` is the best local alignment over that of the item with itself (1: an exact copy), at least `threshold`; one
    row for a row of `docs` and an item. Null or empty texts and items match nothing; an item shorter than a seed is a seed
    itself, so it matches where all its words stand in order; a null doc_id or item_id is carried; repeated rows give repeated rows; other columns are not read; empty tables: no
    rows. Whole texts are read at any length, hot items need no special case: nothing is shuffled but the seed counts.
    """
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for aligner in _aligners(docs, benchmark, n, threshold, block):
        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(_aligned(aligner), _FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, threshold: float = SCORE, block: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all their columns, without those in which a passage aligns with a test item (see leaks).
    Rows are independent: null texts stay, repeated rows stay or go together, an empty table gives none, columns may have any
    name; an empty benchmark changes nothing."""
    out = docs
    for aligner in _aligners(docs, benchmark, n, threshold, block):
        out = out.mapInArrow(_kept(aligner), docs.schema)
    return out
