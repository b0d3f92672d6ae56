"""Expressions against plain Python, case by case."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from poolwright.functions import answers as A
from poolwright.functions import hygiene as H
from poolwright.functions import motif as Q
from poolwright.functions import stats as X
from poolwright.functions import text as T


def values(spark, inputs, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_numeric(spark):
    cases = {
        "1,234.50": "1234.5", "007": "7", "+5": "5", "-0": "-0", "0.0": "0", "100": "100", "-12.3400": "-12.34", "7e3": "7000", "1.50e1": "15", "2.5e-3": "0.0025", "1e40": "1e+40", "12e-40": "1.2e-39",
        "12345678901234567890123456789": "12345678901234567890123456789", "": None, "abc": None, "nan": None, "1.2.3": None, "5.": "5", ".5": "0.5", None: None, " 3 ": "3",
    }
    assert values(spark, list(cases), A.canonical_numeric) == list(cases.values())


def test_canonical_numeric_is_decimal(spark):
    tokens = [f"{s}{w}{p}" for s in ("", "-", "+") for w in ("0", "10", "0123", "99999", "120") for p in ("", ".0", ".50", ".001", ".10e2", "e-2", "e5")]
    for token, got in zip(tokens, values(spark, tokens, A.canonical_numeric), strict=True):
        assert Decimal(got) == Decimal(token) and ("." not in got or not got.endswith("0")), token


def test_extract_numeric(spark):
    cases = {
        r"so 3, hence \boxed{42}": "42", r"\boxed{7} then \boxed{x}": "7", "12 apples": "12", "it is 1,234,567.0 in all": "1234567", "none": None, "": None, "Final answer: -3.50": "-3.5", "5 or 6": "6",
    }
    assert values(spark, list(cases), A.extract_numeric) == list(cases.values())


def test_extract_tail(spark):
    cases = {"work\nFinal answer: 42.": "42", "the answer is 5.": "5", "(5)": "5", "x = 5": "5", "5 apples remain": None, r"so \boxed{9}.": "9", "answer: 3 or 4": None, "": None}
    assert values(spark, list(cases), A.extract_numeric_tail) == list(cases.values())


def test_extract_choice(spark):
    cases = {"Final answer: B": "B", "(C)": "C", "b.": "B", "A or B": None, "answer because": "B", "Option K": None, "only D fits": "D", "": None, "answer: a, then option d": "D"}
    assert values(spark, list(cases), A.extract_choice) == list(cases.values())


def test_match(spark):
    rows = [("x", "X ", "numeric", True), ("Final answer: 7", "7", "numeric", True), ("42.0", "42", "numeric", True), ("B", "(b)", "choice_letter", True), ("", "", "numeric", True), ("41", "42", "numeric", False), ("A", "B", "choice_letter", False), (None, "1", "numeric", False)]
    df = spark.createDataFrame(rows, "p string, g string, m string, want boolean")
    assert all(r.want == r.got for r in df.select("want", A.answers_match(F.col("p"), F.col("g"), F.col("m")).alias("got")).collect())


def test_hygiene(spark):
    assert values(spark, ["Just OUTPUT the answer.", "fine", ""], H.instruction_leak) == [True, False, False]
    assert values(spark, ["Let's think step by step. 4", "okay, let's see", "4", ""], H.scaffold_residue) == [True, True, False, False]
    bad = ["", "Correct", "final answer: 1 final answer: 2", "x =", "(open", "hm well", "and the"]
    assert values(spark, bad, lambda c: H.malformed(c, F.lit("numeric"))) == [True] * len(bad)
    assert values(spark, ["Final answer: 4", "four plus nothing here"], lambda c: H.malformed(c, F.lit("numeric"))) == [False, False]
    assert values(spark, ["let me think. Wait, that's not correct. 5", "5"], H.strip_scaffold) == ["5", "5"]
    assert values(spark, ["use at most one line\nwork\nFinal answer: 5\nhuman: next"], H.sanitize) == ["work\nFinal answer: 5"]
    assert values(spark, ["", "use at most", "step 1", "17", "final answer: it is", "x" * 200, "hm"], H.wrong_form) == ["empty", "instruction_leak", "scaffold_or_fragment", "short_numeric_like", "answer_like_short", "long_reasoning", "other_wrong_form"]


def test_quality(spark):
    cases = {
        "": "fragment", "so the": "fragment", "banana": "fragment", "Step 1 then we have 4 bags": "partial_solution",
        "Therefore we have twenty words in this line because it goes on and on until there are more than twenty of them.": "complete_attempt",
    }
    assert values(spark, list(cases), lambda c: Q.quality(c)["label"]) == list(cases.values())


def test_motif(spark):
    label = lambda c: Q.motif(F.lit(""), c)["label"]
    assert values(spark, ["let x = 4, solve for x", "half of twice", "", "3 miles in 2 hours", "add 3 + 4"], label) == ["equation_setup", "ratio_or_proportion", "other_or_unclear", "unit_conversion", "arithmetic_finish"]


def test_traces(spark):
    trace = "<think>\nOkay, let's see.\n1. Add 2 and 3. It is 5!\n2) Done.\nFinal answer: 5"
    assert values(spark, [trace], T.filtered_cot) == ["Okay, let's see.\n1. Add 2 and 3. It is 5!\n2) Done."]
    assert values(spark, [trace], T.brief_reasoning) == ["Add 2 and 3.\nIt is 5!"]
    assert values(spark, [trace], T.subgoals) == [["Okay, let's see.", "Add 2 and 3. It is 5!", "Done."]]


@pytest.mark.parametrize("a,b", [(0, 0), (4, 4), (3, 9), (0, 7), (200, 260)])
def test_mcnemar(spark, a, b):
    n, k = a + b, min(a, b)
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    got = spark.range(1).select(X.mcnemar_exact(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("p")).first().p
    assert abs(got - want) < 1e-9


def test_openings_repeated_many_times(spark):
    """Groups repeat in a loop, not by recursion: 100,000 openings come off as one does."""
    n = 100_000
    texts = ["let's think. " * n + "5", "Okay, let's tackle this problem. Let me think! " * n + "so 7", "wait, that's not correct. \n" * n, "x\nfinal answer: " + "final answer : " * n + "8", "1" + ",234" * n, "(" * n + "3" + ")" * n]
    assert values(spark, texts[:3], H.strip_scaffold) == ["5", "so 7", ""]
    assert values(spark, texts[:4], H.sanitize) == ["5", "so 7", "", "x\nFinal answer: 8"]
    assert values(spark, texts[:1], H.strip_meta_lines) == ["5"] and values(spark, texts[:1], H.meta_instruction) == [False]
    for f in (A.extract_numeric, A.extract_numeric_tail, A.extract_choice, A.extract_prediction, T.brief_reasoning, T.collapse, H.wrong_form, lambda c: H.malformed(c, F.lit("numeric")), lambda c: H.normalize_candidate(c, F.lit("numeric"))["text"]):
        assert len(values(spark, texts, f)) == len(texts)


def test_binomial_inverts_the_distribution(spark):
    cases = [(n, h, of, (i + 0.5) / 40) for n, h, of in ((20, 3, 10), (1, 1, 2), (300, 1, 300), (300, 299, 300), (50, 0, 7), (50, 7, 7), (0, 1, 2)) for i in range(40)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, h long, of long, u double")
    got = [r.k for r in rows.select("i", X.binomial(F.col("n"), F.col("h"), F.col("of"), F.col("u")).alias("k")).orderBy("i").collect()]
    for (n, h, of, u), k in zip(cases, got, strict=True):
        p, total, want = h / of, 0.0, 0
        for want in range(n + 1):
            total += math.comb(n, want) * p**want * (1 - p) ** (n - want)
            if total >= u:
                break
        assert k == want, (n, h, of, u)


def test_binomial_of_many_draws(spark):
    n, p = 10**7, 0.3
    row = spark.range(200).select(X.binomial(F.lit(n), F.lit(3), F.lit(10), X.uniform(5, F.col("id"))).alias("k")).agg(F.avg("k").alias("m"), F.stddev("k").alias("s")).first()
    sd = math.sqrt(n * p * (1 - p))
    assert abs(row.m - n * p) < 5 * sd / math.sqrt(200) and 0.8 < row.s / sd < 1.2
