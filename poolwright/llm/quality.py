"""Quality classifier with weak labels.

Overlapping heuristic labellers vote on every document. Expectation-maximisation over the counts of their vote patterns, of
all documents, estimates how often each labeller fires on good and on bad text and so a posterior for each pattern. The
posteriors are the labels of a linear scorer over hashed features, which judges every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import text_slices
from poolwright.llm.wordarrays import Words

BUCKETS, EXTRA, SAMPLE, THRESHOLD = 4096, 8, 6000, 0.5
#: The share of good texts on which a labeller that speaks against a text may fire, while the estimate is being started.
FALSE_ALARMS = 0.004
#: Frequent words of the languages the corpus is known to hold (fixed values).
FUNCTION_WORDS = (
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their "
    "de la le et les des en un du une que est pour qui dans par sur au plus ne se pas avec ce il sont "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so dass sie nach wird bei "
    "el los y del las por con no su para al lo como o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son"
).split()
#: Name and sense of each labeller: what it fires on speaks against (-1) or for (+1) a text.
LABELLERS = {"repeats": -1, "capitals": -1, "exclaims": -1, "symbols": -1, "bars": -1, "few_kinds": -1, "no_sentence": -1, "sentences": 1, "function_words": 1, "letters": 1}


def statistics(words: Words) -> dict[str, np.ndarray]:
    """Counts and shares of each text that the labellers read."""
    data, offsets, n_docs = words.data, words.offsets, len(words.offsets) - 1
    table = np.zeros(256, np.uint8)
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
    table[128:] = 1
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    table[[ord(c) for c in "#$%&*^~<>{}=\\_@"]] = 3
    table[ord("!")], table[ord("|")] = 4, 5
    kind = table[data]
    high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) else []
    kind[high] = 2  # capitals of the Latin-1 letters

    def per(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, flags, n_docs)

    n = np.diff(words.first).astype(np.float64)
    again = np.zeros(len(words.starts), bool)
    if len(again) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    last = data[words.ends - 1] if len(again) else np.zeros(0, np.uint8)
    known = np.isin(words.hash, _function_hashes()) if len(again) else np.zeros(0, bool)
    kinds = np.sort(words.doc.astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24))  # by document, 40 bits of each word
    kinds = (kinds[np.diff(kinds, prepend=~kinds[:1]) != 0] >> np.uint64(40)).astype(np.int64)
    letters, capitals, size = per((kind == 1) | (kind == 2)), per(kind == 2), np.maximum(np.diff(offsets), 1)
    written = np.maximum(per(~np.isin(data, [32, 9, 10, 11, 12, 13, *range(48, 58)])), 1)
    each = np.maximum(n, 1)
    return {
        "n": n,
        "again": of_words(again) / each,
        "capitals": capitals / np.maximum(letters, 1),
        "exclaims": per(kind == 4) / each,
        "symbols": per(kind == 3) / size,
        "bars": per(kind == 5) / each,
        "kinds": np.log(np.maximum(np.bincount(kinds, minlength=n_docs), 1)) / np.log(np.maximum(n, 2)),
        "stops": of_words(np.isin(last, [46, 63])) / each,
        "known": of_words(known) / each,
        "letters": letters / written,
    }


def _function_hashes() -> np.ndarray:
    return np.concatenate([Words(pa.array([" ".join(FUNCTION_WORDS)])).hash, Words(pa.array([" ".join(w.capitalize() for w in FUNCTION_WORDS)])).hash])


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """0 or 1 for each text and labeller."""
    long = s["n"] >= 20
    fired = {
        "repeats": (s["again"] > 0.1) & (s["n"] >= 4),
        "capitals": s["capitals"] > 0.4,
        "exclaims": s["exclaims"] > 0.25,
        "symbols": s["symbols"] > 0.04,
        "bars": s["bars"] > 0.15,
        "few_kinds": long & (s["kinds"] < 0.6),
        "no_sentence": long & (s["stops"] < 0.004),
        "sentences": (s["stops"] > 0.01) & (s["stops"] < 0.5),
        "function_words": (s["known"] > 0.08) | (s["n"] < 8),
        "letters": s["letters"] > 0.86,
    }
    return np.stack([fired[k] for k in LABELLERS], axis=1).astype(np.int64)


def hashed(words: Words, s: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, and EXTRA columns of the statistics `s`, for each text."""
    data, offsets, n_docs = words.data.astype(np.uint32), words.offsets, len(words.offsets) - 1
    out = np.zeros((n_docs, BUCKETS + EXTRA), np.float32)
    if len(data) >= 3:
        bucket = (((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)).astype(np.int64)
        doc = np.repeat(np.arange(n_docs), np.diff(offsets))
        same = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][same] * BUCKETS + bucket[same], minlength=n_docs * BUCKETS).reshape(n_docs, BUCKETS)
        out[:, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    if n_docs:
        out[:, BUCKETS:] = np.stack([np.sqrt(s[k]) if k != "kinds" else s[k] for k in ("again", "capitals", "exclaims", "symbols", "bars", "kinds", "stops", "letters")], axis=1)
    return out


@dataclass
class Accuracies:
    """What expectation-maximisation found: the share of good texts, and how often each labeller fires on bad and good."""

    good: float
    fires: np.ndarray  # 2 x labellers, row 0 bad, row 1 good

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.good, self.good])) + patterns @ np.log(self.fires).T + (1 - patterns) @ np.log(1 - self.fires).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Accuracies:
    """EM for two classes over vote patterns with counts. It starts from labellers that are right more often than not, and
    each keeps its sense: one that speaks against a text never fires more on good texts than on bad ones. EM finds the
    optimum nearest to its start, so it is first run with false alarms bounded by FALSE_ALARMS, which keeps kinds of bad
    text that one or two labellers know out of the good class, and then goes on without that bound until it settles."""
    sense = np.array(list(LABELLERS.values()))
    fires = np.where(np.array([[1], [-1]]) * -sense > 0, [[0.5], [0.5]], [[0.05], [0.05]]).astype(float)
    fires[0, sense > 0], fires[1, sense > 0] = 0.5, 0.95
    found, total = Accuracies(0.8, fires), max(counts.sum(), 1)
    for bound in (FALSE_ALARMS, 1.0):
        for _ in range(rounds):
            p = found.posterior(patterns)
            weight = np.stack([(1 - p) * counts, p * counts])
            fires = (weight @ patterns + 0.5) / (weight.sum(axis=1, keepdims=True) + 1)
            wrong = (fires[1] - fires[0]) * sense < 0
            fires[:, wrong] = fires[:, wrong].mean(axis=0)
            fires[1, sense < 0] = np.minimum(fires[1, sense < 0], bound)
            good = float(np.clip(weight[1].sum() / total, 0.02, 0.98))
            moved = abs(good - found.good) + np.abs(fires - found.fires).max()
            found = Accuracies(good, np.clip(fires, 1e-4, 1 - 1e-4))
            if moved < 1e-7:
                break
    return found


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels, Adam over the whole sample; both classes weigh the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    weight = (y / share + (1 - y) / (1 - share)) / 2
    for t in range(1, rounds + 1):
        if not len(y):
            break
        error = (Scorer(w, b).score(x) - y) * weight / len(y)
        g = np.append(x.T @ error.astype(np.float32) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return Scorer(w, float(b))


def _patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << len(LABELLERS), np.int64)
    for batch in batches:
        for a, b in text_slices(batch):
            v = votes(statistics(Words(batch.column("text")[a:b])))
            seen += np.bincount(v @ (1 << np.arange(v.shape[1])), minlength=len(seen))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pattern", "n"])


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch):
            words = Words(batch.column("text")[a:b])
            s = statistics(words)
            v, x = votes(s), hashed(words, s)
            yield pa.RecordBatch.from_arrays([batch.column("h")[a:b], batch.column("g")[a:b], pa.array(v @ (1 << np.arange(v.shape[1]))), pa.array([zlib.compress(r.tobytes(), 1) for r in x.astype(np.float16)], pa.binary())], names=["h", "g", "pattern", "x"])


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(len(LABELLERS))) & 1


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Accuracies, Scorer]:
    """Accuracies over all documents; the scorer from about `sample` of them, those with the least hash of id and text."""
    own = docs.select("text").where("text is not null")
    counted = own.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    patterns, counts = _unpack(counted["pattern"].to_numpy(np.int64)), counted["n"].to_numpy(np.float64)
    found = estimate(patterns, counts)
    share = min(1.0, sample / max(counts.sum(), 1))
    chosen = docs.where("text is not null").withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).where(F.col("h") < int(share * (1 << 30)))
    made = chosen.select("h", F.xxhash64(F.lit(1), "text").alias("g"), "text").mapInArrow(_examples, "h long, g long, pattern long, x binary")
    rows = made.orderBy("h", "g").limit(2 * sample).select("pattern", "x").toPandas()
    x = np.empty((len(rows), BUCKETS + EXTRA), np.float32)
    for i, packed in enumerate(rows["x"]):
        x[i] = np.frombuffer(zlib.decompress(packed), np.float16)
    return found, fit(x, found.posterior(_unpack(rows["pattern"].to_numpy(np.int64))).astype(np.float32))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])


def _judged(found: Accuracies, scorer: Scorer, column: pa.Array, threshold: float):
    words = Words(column)
    n, s = np.diff(words.first), statistics(words)
    score = np.where(n > 0, np.round(scorer.score(hashed(words, s)).astype(np.float64), 6), 0.0)
    return n, found.posterior(votes(s)), score, score >= threshold


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, posterior, score, keep) for each row of `docs`.

    posterior is what the labellers say of the text together, score what the linear scorer says (1: good); keep is score
    >= threshold. Texts without words, null ones included, score 0 and go. Null and repeated doc_ids are carried, other
    columns are not read, an empty table gives no rows.
    """
    found, scorer = train(docs, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                n, posterior, score, keep = _judged(found, scorer, batch.column("text")[a:b], threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), pa.array(n), pa.array(np.where(n > 0, posterior, 0.0)), pa.array(score), pa.array(keep)], schema=_SCORED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, posterior double, score double, keep boolean")


def kept(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that classify() keeps."""
    found, scorer = train(docs, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_judged(found, scorer, batch.column("text")[a:b], threshold)[3] for a, b in text_slices(batch)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
