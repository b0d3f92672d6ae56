"""Language identification by a linear-chain conditional random field.

Each word of a text carries a language: its affixes, letter trigrams and the word itself (the learned lexicon) weigh for
each language, and transitions between neighbouring words are learned too, so code-switched text is labelled word by word.
Forward-backward gives each word's probabilities; a document's language is the one with the largest mean.
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
from poolwright.llm.wordarrays import Words, _powers, forget_powers, mix

BITS, BLOCK, SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_CHARS, EPOCHS = 18, 64, 300, 60_000, 50_000, 6
_SPLIT = np.array([not (c >= 128 or chr(c).isalpha()) for c in range(256)])
_RNG_BYTE = np.random.default_rng(97).integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15


def lang_words(column: pa.Array) -> Words:
    """Lower-cased runs of ASCII letters and non-ASCII characters."""
    return Words(pc.utf8_lower(pc.fill_null(column, "")), _SPLIT)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features end to end and where each word's begin: whole word, prefixes and suffixes of 1 to 3 bytes, and its
    byte trigrams."""
    data, starts, ends = words.data, words.starts, words.ends
    size = ends - starts
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_RNG_BYTE[data] * _powers(_P, n), out=sums[1:])
    back = _powers(pow(_P, -1, 2**64), n + 1)

    def hashed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return (mix((sums[b] - sums[a]) * back[a] + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)

    fixed = [hashed(starts, ends, 1)]
    for k in (1, 2, 3):
        cut = np.minimum(size, k)
        fixed += [hashed(starts, starts + cut, 10 + k), hashed(ends - cut, ends, 20 + k)]
    grams = np.maximum(size - 2, 0)
    each = len(fixed) + grams
    begin = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(begin[-1], np.int64)
    for k, f in enumerate(fixed):
        out[begin[:-1] + k] = f
    at = np.repeat(starts, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    spot = np.repeat(begin[:-1] + len(fixed), grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    out[spot] = hashed(at, at + 3, 3)
    return out, begin


def forward_backward(score: np.ndarray, first: np.ndarray, trans: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginal probabilities of each position, for sequences that begin at `first` (one more at the end).

    score: positions x labels, trans: labels x labels, both logs. Sequences are cut into blocks of `block` positions: the
    transfer matrix of every block is made at once, the few blocks of a sequence are chained, and then all blocks run
    again from their true boundary vectors. This is exact, and a long text costs no more steps than a short one.
    """
    n, labels = score.shape
    if not n or not labels:
        return np.zeros_like(score)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    length = np.diff(first)
    blocks = -(-length // block)
    total = int(blocks.sum())
    seq_first = np.concatenate([[0], np.cumsum(blocks)])
    k = np.arange(total) - np.repeat(seq_first[:-1], blocks)
    begin = np.repeat(first[:-1], blocks) + k * block
    size = np.minimum(np.repeat(first[1:], blocks) - begin, block)
    order = np.argsort(-size, kind="stable")
    sorted_begin, sorted_size = begin[order], size[order]
    live = np.searchsorted(-sorted_size, -np.arange(block), "left")  # blocks with a position at each step
    matrix = np.tile(np.eye(labels), (total, 1, 1))
    for s in range(block):
        m = live[s]
        if not m:
            break
        step = (matrix[:m] @ t) * e[sorted_begin[:m] + s][:, None, :]
        matrix[:m] = step / step.sum(axis=(1, 2), keepdims=True)
    by_block = np.empty_like(matrix)
    by_block[order] = matrix
    left, right = np.full((total, labels), 1 / labels), np.ones((total, labels))
    most = int(blocks.max())
    for j in range(1, most):
        at = seq_first[:-1][blocks > j] + j
        v = np.einsum("bi,bij->bj", left[at - 1], by_block[at - 1])
        left[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(most - 2, -1, -1):
        at = seq_first[:-1][blocks > j + 1] + j
        v = np.einsum("bij,bj->bi", by_block[at + 1], right[at + 1])
        right[at] = v / v.sum(axis=1, keepdims=True)
    alpha, out = np.empty((n, labels)), np.empty((n, labels))
    v = left[order]
    for s in range(block):
        m = live[s]
        if not m:
            break
        v[:m] = (v[:m] @ t) * e[sorted_begin[:m] + s]
        v[:m] /= v[:m].sum(axis=1, keepdims=True)
        alpha[sorted_begin[:m] + s] = v[:m]
    v = right[order]
    for s in range(block - 1, -1, -1):
        m = live[s]
        if not m:
            continue
        at = sorted_begin[:m] + s
        p = alpha[at] * v[:m]
        out[at] = p / p.sum(axis=1, keepdims=True)
        v[:m] = (v[:m] * e[at]) @ t.T
        v[:m] /= v[:m].sum(axis=1, keepdims=True)
    return out


@dataclass
class Field:
    """Feature weights (buckets x languages) and transitions of a trained field."""

    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray

    def emissions(self, features: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if len(begin) < 2:
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[features], begin[:-1], axis=0).astype(np.float64)

    def words(self, column: pa.Array) -> tuple[Words, np.ndarray]:
        """The words of a column and the probabilities of their languages."""
        words = lang_words(column)
        return words, forward_backward(self.emissions(*word_features(words)), words.first, self.trans)

    def documents(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        words, p = self.words(column)
        n = len(column)
        sums = np.stack([np.bincount(words.doc, p[:, k], n) for k in range(len(self.langs))], axis=1) if len(self.langs) else np.zeros((n, 0))
        count = np.diff(words.first)
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False) & (count > 0) & (len(self.langs) > 0)
        best = np.argmax(sums, axis=1) if len(self.langs) else np.zeros(n, np.int64)
        score = np.where(lettered, sums[np.arange(n), best] / np.maximum(count, 1), 0.0) if len(self.langs) else np.zeros(n)
        return [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.clip(score, 0, 1)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = 0.2, seed: int = 5, switch: int = 24) -> Field:
    """A field from whole texts with their languages.

    Training sequences are code-switched: runs of about `switch` words from different texts in turn, so transitions are
    learned. Gradient: expected less observed features under forward-backward, by AdaGrad over batches of sequences.
    """
    names, rng = sorted(set(langs)), np.random.default_rng(seed)
    words = lang_words(pa.array(texts, pa.string()))
    features, begin = word_features(words)
    gold = np.array([names.index(x) for x in langs])[words.doc] if len(langs) else np.zeros(0, np.int64)
    n_lang = len(names)
    field = Field(names, np.zeros((1 << BITS, n_lang), np.float32), np.zeros((n_lang, n_lang)))
    if n_lang < 2 or not len(gold):
        return field
    cuts = np.concatenate([np.arange(a, b, switch) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    stops = np.minimum(cuts + switch, words.first[1:][words.doc[cuts]])
    grown, grown_t = np.full((1 << BITS, n_lang), 1e-3, np.float32), np.full((n_lang, n_lang), 1e-3)
    for _ in range(epochs):
        mixed = rng.permutation(len(cuts))
        for part in np.array_split(mixed, max(1, len(mixed) // 400)):
            at = np.concatenate([np.arange(cuts[i], stops[i]) for i in part])
            size = (begin[1:] - begin[:-1])[at]
            local = np.concatenate([[0], np.cumsum(size)])
            f = features[np.repeat(begin[at] - local[:-1], size) + np.arange(local[-1])]
            ends = np.cumsum(stops[part] - cuts[part])
            first = np.concatenate([[0], ends[2:-1:3], [len(at)]])  # three runs make a sequence
            score = field.emissions(f, local)
            p = forward_backward(score, np.unique(first), field.trans)
            y = np.eye(n_lang)[gold[at]]
            error = (p - y).astype(np.float32) / len(at)
            rows = np.repeat(error, size, axis=0)
            touched, where = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(where, rows[:, k], len(touched)) for k in range(n_lang)], axis=1).astype(np.float32)
            grown[touched] += g * g
            field.weights[touched] -= rate * g / np.sqrt(grown[touched])
            inside = np.ones(len(at), bool)
            inside[first[:-1]] = False
            i = np.flatnonzero(inside)
            pair = p[i - 1][:, :, None] * np.exp(field.trans)[None] * np.exp(score[i] - score[i].max(axis=1, keepdims=True))[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            gt = (pair.sum(axis=0) - np.einsum("na,nb->ab", y[i - 1], y[i])) / len(at)
            grown_t += gt * gt
            field.trans -= rate * gt / np.sqrt(grown_t)
    return field


def bucket_of(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, most_words: int = SAMPLE_WORDS) -> tuple[list[str], list[str]]:
    """About `per_lang` texts of each language outside the held-out fold, those of least text hash, until the language has
    `most_words` words; of a text longer than SAMPLE_CHARS a training example is its beginning. Counts by language are over
    all documents."""
    own = docs.where((bucket_of() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, per_lang / n) * (1 << 30)))) for k, n in counts.items()])
    rows = own.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30))).where(F.col("h") < limit).select("h", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "lang").distinct()
    texts, langs, words = [], [], dict.fromkeys(counts, 0)
    for r in sorted(rows.orderBy("h", "text").limit(2 * per_lang * len(counts)).collect(), key=lambda r: (r["h"], r["text"])):
        if words[r["lang"]] < most_words:
            texts.append(r["text"])
            langs.append(r["lang"])
            words[r["lang"]] += r["text"].count(" ") + 1
    return texts, langs


_ROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs`.

    The field learns from text and lang where the crc32 of the doc_id as text, modulo 4, is not 2; rows without doc_id or
    lang teach nothing. `und` and 0 where the text is null, has no letter, or nothing could be learned. Rows are judged
    by their text alone; repeated rows give repeated rows, an empty table none, other columns are not read.
    """
    field = field or train(*training_sample(docs))
    forget_powers()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                lang, score = field.documents(batch.column("text")[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], schema=_ROW)

    got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", F.coalesce(bucket_of() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
