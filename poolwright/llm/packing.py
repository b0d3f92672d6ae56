"""Packing by the sum-of-squares rule.

Each document goes, as it comes, to the fill level at which placing it leaves the smallest sum of squared counts of
partially filled windows; a level array holds these counts. A task packs the documents of its own input split, so
nothing is shuffled, and the order of a split is that of its file, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from poolwright.llm.common import text_slices, utf8

WINDOW, END_ID = 2048, 1
#: Distinct words whose ids a worker process keeps from task to task; the table starts anew beyond it, which changes no result.
WORDS_KEPT = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Levels:
    """Windows of `size` tokens under the sum-of-squares rule."""

    def __init__(self, size: int = WINDOW):
        self.size, self.counts, self.begun = size, np.zeros(size + 1, np.int64), 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, n: int) -> tuple[int, int]:
        """The window and the fill level at which n tokens (1 to size) go; equal sums: the fullest window, a new one last."""
        level, counts = 0, self.counts
        gain = 0 if n == self.size else 2 * counts[n] + 1
        room = np.flatnonzero(counts[1 : self.size - n + 1]) + 1
        if len(room):
            grown = 2 * counts[room + n] + 1
            grown[room + n == self.size] = 0
            cost = grown - 2 * counts[room] + 1
            best = len(room) - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= gain:
                level = int(room[best])
        if level:
            window = self.open[level].pop()
            counts[level] -= 1
        else:
            window, self.begun = self.begun, self.begun + 1
        if level + n < self.size:
            counts[level + n] += 1
            self.open[level + n].append(window)
        return window, level


class Ids:
    """Token ids of a text as little-endian bytes.

    The tokenizer drops white space and case, so a text is split at ASCII white space and each distinct word is encoded
    once. Closing punctuation after a letter or digit is told apart from it by the tokenizer and is looked up apart. Words of plain letters
    are encoded many at a time and told apart by the tokenizer's mark at the end of a word; all others one by one.
    """

    CLOSING = string.punctuation.encode()

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        vocab, mark = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if mark and t.endswith(mark)]] = True

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]  # names of special tokens keep their case
        known, new, open_ = self.words, set(), []
        found = [list(map(known.get, words)) for words in split]
        for words, got in zip(split, found, strict=True):
            if None in got:
                at = [i for i, ids in enumerate(got) if ids is None]
                open_.append((words, got, at))
                new.update([words[i] for i in at])
        self.learn(new)
        for words, got, at in open_:
            for i in at:
                got[i] = known[words[i]]
        return [b"".join(got) for got in found]

    def learn(self, new: set[bytes]) -> None:
        cut = {}
        for w in new:
            stem = w.rstrip(self.CLOSING)
            if stem and len(stem) < len(w) and b"<|" not in w and (stem[-1:].isalnum() or stem[-1] > 127 and stem.decode()[-1].lower().isalpha()):
                cut[w] = stem, w[len(stem) :]
        self.encode(list({p for pair in cut.values() for p in pair}.union(new.difference(cut)).difference(self.words)))
        for w, (stem, tail) in cut.items():
            self.words[w] = self.words[stem] + self.words[tail]

    def encode(self, new: list[bytes], step: int = 2000) -> None:
        plain = [w for w in new if w.isalpha() or not w.isascii() and (t := w.decode()).isalpha() and max(t) < "\u0250" and "\u0130" not in t]
        rest = list(set(new).difference(plain))
        for at in range(0, len(plain), step):
            part = plain[at : at + step]
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                rest += part
                continue
            data, stops = ids.tobytes(), (4 * stops).tolist()
            for w, a, b in zip(part, [0, *stops[:-1]], stops, strict=True):
                self.words[w] = data[a:b]
        for at in range(0, len(rest), step):
            part = rest[at : at + step]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.words[w] = np.asarray(e.ids, "<u4").tobytes()


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This process's table for a tokenizer file."""
    if path not in _IDS:
        _IDS.clear()
        _IDS[path] = Ids(path)
    return _IDS[path]


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each document: see SCHEMA, and `ids`, the token ids of the piece (array<int>), unless
    `with_ids` is false.

    A document is its ids and `end_id`; null or empty text: `end_id` alone. Longer documents fill whole windows of their
    own and their rest is placed. Rows are independent: a null or repeated doc_id is carried as it is, other columns are
    not read, an empty table gives no rows. Windows are closed at the end of a split; sequence_id names split and window.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids, levels = ids_of(tokenizer or public_tokenizers.path("word_bpe_49k.json")), Levels(size)
        end, base = np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in text_slices(batch):
                rows, tokens = [], []
                for doc, data in zip(batch.column("doc_id")[a:b].to_pylist(), ids(utf8(batch.column("text")[a:b])), strict=True):
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        window, level = levels.place(length)
                        part = data[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(part), n, base + window, level))
                        tokens.append(part)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(t) // 4 for t in tokens])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(tokens), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
