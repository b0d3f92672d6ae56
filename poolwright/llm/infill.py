"""Fill-in-middle transformation by bit-parallel big integers.

A text's UTF-8 bytes are one big integer for each class of bytes, a bit a byte, the first byte the highest bit:
bytes.translate writes the class as '0' and '1' and int(_, 2) reads it. A unit starts at the first byte and behind each line
break, so starts are the break mask shifted by one place; bit_count() gives the number of units; a ranked start is selected
by recursive halving, each step counting one half of what is left, so a text costs linear time however many units it has.
Characters are counted the same way, on the mask of bytes that begin one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import text_slices, utf8

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BREAKS = bytes(49 if b == 10 else 48 for b in range(256))
_LEADS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def mask(data: bytes, table: bytes) -> int:
    """The bytes of a class as a big integer, the first byte the highest of len(data) bits."""
    return int(data.translate(table), 2) if data else 0


def unit_starts(data: bytes) -> int:
    """The mask of bytes that begin a unit `[^\\n]*\\n|[^\\n]+`."""
    return mask(data, _BREAKS) >> 1 | 1 << len(data) - 1 if data else 0


def select(bits: int, width: int, rank: int) -> int:
    """The place, counted from the highest of `width` bits, of the set bit that `rank` others stand before."""
    at = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        count = high.bit_count()
        if rank < count:
            bits, width = high, width - low
        else:
            rank, at, bits, width = rank - count, at + width - low, bits & (1 << low) - 1, low
    return at


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from the SHA-256 of `seed:doc_id`; a null doc_id counts as empty text."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(data: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(number of units, form, characters of the prefix and of the middle, output) of a text."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    starts, width = unit_starts(data), len(data)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or h3 % 100 >= rate or any(m in data for m in marks):
        return n, "plain", None, None, data
    a, b = (width if k == n else select(starts, width, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    leads = mask(data, _LEADS)
    first, second = ((leads >> width - at).bit_count() for at in (a, b))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row: its text with prefix, middle and suffix of whole
    lines set apart by marks, `rate` percent of texts, `spm` percent of those suffix first.

    Null text counts as empty; an empty text, and one with a mark in it, stays plain with null lengths. Cuts depend on the
    doc_id and the number of lines alone, so rows that repeat a doc_id are rows of their own, cut by the same draws; a null
    doc_id draws as empty text. Texts of any length take linear time, one text at a time; an empty table gives no rows;
    other columns aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                ids = batch.column("doc_id")[a:b].cast(pa.int64())
                rows = [rearranged(data, i, seed, rate, spm) for i, data in zip(ids.to_pylist(), utf8(batch.column("text")[a:b]), strict=True)]
                n, form, first, middle, output = zip(*rows, strict=True)
                texts = pa.array(output, pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), texts], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text again from output and form, as a Column expression. Marks can't occur in a marked text, and none can arise
    where one is put beside it, since they begin with `<`, end with `>` and hold neither inside."""
    head = lambda x, mark: F.substring_index(x, mark, 1)
    tail = lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(tail(head(output, SUFFIX), PREFIX), tail(output, MIDDLE), tail(head(output, MIDDLE), SUFFIX))
    spm = F.concat(tail(head(output, MIDDLE), PREFIX), tail(output, MIDDLE), tail(head(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(docs: DataFrame) -> DataFrame:
    made = transform(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = f"""with h as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || doc_id) as s, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units from documents),
d as (select *, len(units) as n, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2, cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form from d),
p as (select *, coalesce(array_to_string(units[1:a], ''), '') as x, coalesce(array_to_string(units[a + 1:b], ''), '') as y, coalesce(array_to_string(units[b + 1:n], ''), '') as z from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(x) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(y) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y else '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y end) as output_sha256,
  sha256(text) as restored_sha256 from p"""
