"""Fill-in-middle against a plain version by regular expression and slices."""

import hashlib
import random
import re
import time

import pytest

from poolwright.llm import infill

SCHEMA = "doc_id long, text string, n string, output string, form int"


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


def texts():
    r = random.Random(5)
    pieces = ["a", "é", "日本", "😀", " ", "\t", "\r", " ", "<", "P>", "<S", ">", "M", "\n", "\n", "\n\n"]
    out = [None, "", "\n", "\n\n\n", "one line", "no end\nlast", "end\n", "x<P>y\n", "x\n<M", "<S>", "\n" * 5000, "long " * 20_000 + "\n", "z\n" * 30_000]
    return out + ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(300)]


def test_against_plain_version(spark):
    rows = [*enumerate(texts()), (None, "null id\nof two\nlines"), (3, "repeated id\n\nx"), (3, "repeated id\n\nx"), (-5, "a\nb")]
    docs = spark.createDataFrame([(i, t, "n", "o", 1) for i, t in rows], SCHEMA).repartition(4)
    for setting in ({}, {"seed": 11, "rate": 60, "spm": 20}):
        made = infill.transform(docs, **setting)
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
        assert got == sorted(((i, *plain(i, t, **setting)) for i, t in rows), key=repr)
        back = made.select("doc_id", infill.restored(made.output, made.form).alias("t")).collect()
        assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_query_digests(spark):
    rows = list(enumerate(texts()))[:60]
    got = {r.doc_id: r for r in infill.query(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)).collect()}
    for i, t in rows:
        out = plain(i, t)[4]
        assert got[i].output_sha256 == hashlib.sha256(out.encode()).hexdigest() and got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    assert infill.query(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 7, 64, 1000])
def test_select_finds_every_rank(width):
    r = random.Random(width)
    bits = r.getrandbits(width) | 1
    places = [i for i in range(width) if bits >> (width - 1 - i) & 1]
    assert [infill.select(bits, width, k) for k in range(len(places))] == places


def test_long_texts_take_linear_time():
    took = []
    for n in (200_000, 3_200_000):
        data = b"ab\n" * n
        began = time.perf_counter()
        infill.rearranged(data, 1)
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * 8 * max(took[0], 0.002)
