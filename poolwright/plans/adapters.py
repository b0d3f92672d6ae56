"""Answer pools derived from the provided tables. An example is an order, its candidates are lines of the order; texts, gold
answers and margins follow from the columns by rule, so SQL can derive the same pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whole rows of lineitem are unique, (l_orderkey, l_linenumber) is not: slots are ordered by all of them.
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
_Q = "cast(cast(l_quantity as bigint) as string)"
_L = "chr(cast(65 + l_suppkey % 10 as int))"
#: What a candidate says: its own line's answer, or a wrong one where the line says so.
_SAID = "cast(cast(l_quantity as bigint) + case when (l_partkey + l_suppkey) % 3 = 0 then 50 else 0 end as string)"
_LETTER = "chr(cast(65 + (l_suppkey + case when (l_partkey + l_suppkey) % 3 = 0 then 5 else 0 end) % 10 as int))"
#: Texts of candidates: how each is written depends on the part, what it says on quantity or supplier.
NUMBER_TEXT = f"""case l_partkey % 9
 when 0 then concat('Final answer: ', {_SAID}) when 1 then concat('The answer is ', {_SAID}, '.') when 2 then {_SAID}
 when 3 then concat('Step 1: add the parts of each bag. Step 2: then the total is ', {_SAID}, ' so the answer is ', {_SAID}, '.')
 when 4 then concat('Let me think about this. x = ', {_SAID}) when 5 then concat('Use at most one line. ', {_SAID}, '.0')
 when 6 then 'so the total is the' when 7 then concat('Final answer: final answer: ', {_SAID})
 else concat('Therefore ', {_SAID}, ' of 1,000 dollars remain in all after the first week, which is more than half of what was left before the price was cut again. Final answer: ', {_SAID}) end"""
CHOICE_TEXT = f"""case l_partkey % 6
 when 0 then concat('Final answer: ', {_LETTER}) when 1 then concat('(', {_LETTER}, ')') when 2 then concat('Option ', {_LETTER}, ' fits best.')
 when 3 then 'none of these fit' when 4 then {_LETTER} else concat('The answer: ', {_LETTER}) end"""
#: The alternative pool has the same lines, half of them cut short.
ALT_TEXT = f"case when l_partkey % 2 = 1 then 'so the total is the' else {NUMBER_TEXT} end"
TEXTS = {"num": NUMBER_TEXT, "alt": ALT_TEXT, "choice": CHOICE_TEXT}
GOLD = {"num": _Q, "alt": _Q, "choice": _L}
MODES = {"num": "numeric", "alt": "numeric", "choice": "choice_letter"}
PROBLEM = "concat('Each order has ', cast(l_orderkey % 7 as string), ' bags. How many are left in total?')"


def slots(spark: SparkSession, sf_dir: str, kind: str = "num") -> DataFrame:
    """One row for each candidate: example_id, slot, candidate, gold_answer, problem, answer_mode, margin (verifier),
    base_margin. One shuffle, by example_id, which serves whatever is grouped by it later."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("example_id", F.col("l_orderkey").cast("string"))
    columns = [c.strip() for c in ORDER.split(",")]
    priciest = F.struct(F.col("l_extendedprice").alias("p"), *[F.col(c) for c in columns], F.expr(GOLD[kind]).alias("gold"))
    ordered = Window.partitionBy("example_id").orderBy(*columns)  # one window for both, so each example's rows are held once
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumns({"slot": F.row_number().over(ordered) - 1, "gold_answer": F.max(priciest).over(whole)["gold"]})
    return rows.select(
        "example_id",
        "slot",
        F.expr(TEXTS[kind]).alias("candidate"),
        "gold_answer",
        F.expr(PROBLEM).alias("problem"),
        F.lit(MODES[kind]).alias("answer_mode"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("margin"),
        F.col("l_discount").alias("base_margin"),
    )


def problems(spark: SparkSession, sf_dir: str, kind: str = "num") -> DataFrame:
    """One row for each example: example_id, problem, gold_answer, answer_mode. Lines are aggregated before they are shuffled."""
    columns = [c.strip() for c in ORDER.split(",")]
    priciest = F.struct(F.col("l_extendedprice").alias("p"), *[F.col(c) for c in columns], F.expr(GOLD[kind]).alias("gold"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.max(priciest)["gold"].alias("gold_answer"))
    return rows.select(F.col("l_orderkey").cast("string").alias("example_id"), F.expr(PROBLEM).alias("problem"), "gold_answer", F.lit(MODES[kind]).alias("answer_mode"))


def pool(rows: DataFrame, *more: str) -> DataFrame:
    """Slots as one row for each example with the ordered arrays candidates and scores; each of the columns `more` becomes an
    array in the same order."""
    item = F.struct("slot", "candidate", "margin", "base_margin", *more)
    made = rows.groupBy("example_id", "problem", "gold_answer", "answer_mode").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return made.select("example_id", "problem", "gold_answer", "answer_mode", F.col("s.candidate").alias("candidates"), F.col("s.margin").alias("margins"), F.col("s.base_margin").alias("base_margins"), *[F.col(f"s.{m}").alias(m) for m in more])


def slots_sql(kind: str = "num") -> str:
    """The same rows as slots(), in SQL for DuckDB."""
    columns = ORDER.replace("l_extendedprice, ", "")
    up = ", ".join(f"{c.strip()} desc" for c in ("l_extendedprice, " + columns).split(","))
    return f"""select cast(l_orderkey as string) example_id, row_number() over (partition by l_orderkey order by {ORDER}) - 1 slot, {TEXTS[kind]} candidate, gold_answer,
 {PROBLEM} problem, '{MODES[kind]}' answer_mode, l_extendedprice * (1 - l_discount) margin, l_discount base_margin
from (select *, first_value({GOLD[kind]}) over (partition by l_orderkey order by {up}) gold_answer from lineitem)"""
