"""Aggregates over pools and selections. Per-example facts come first (`flags`), reports are aggregates of them, so each
report is one pass with partial aggregation and, where it has groups, one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwright.functions.answers import answer_mode, answers_match, extract_choice, extract_numeric, normalize_answer, parse_answer
from poolwright.functions.hygiene import instruction_leak, malformed_wrapper, scaffold_residue, wrong_form
from poolwright.functions.motif import quality
from poolwright.functions.stats import pair_columns, rate
from poolwright.functions.text import token_count
from poolwright.operators.texts import with_match


#: The structs of sections().
PARTS = ("summary", "right", "failures", "rescues", "sizes", "paired", "hygiene")


def share(flag: Column) -> Column:
    """Mean of a boolean, 0 for no rows."""
    return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))


def flags(slots: DataFrame, margins: bool = False) -> DataFrame:
    """One row for each example from slot rows: size, and whether first, base, verifier and any candidate are right. Argmax
    ties go to the earlier slot. With `margins` also top_margin and right_margin, the highest of all and of right candidates."""
    judged = with_match(slots)
    best = lambda m: F.max_by(F.struct("ok", "candidate", "slot"), F.struct(F.coalesce(F.col(m), F.lit(float("-inf"))), -F.col("slot")))
    more = [F.max("margin").alias("top_margin"), F.max(F.when(F.col("ok"), F.col("margin"))).alias("right_margin")] if margins else []
    out = judged.groupBy("example_id").agg(
        *more,
        F.count("*").alias("n_candidates"),
        F.min_by(F.struct("ok", "candidate"), "slot").alias("f"),
        best("base_margin").alias("b"),
        best("margin").alias("v"),
        F.bool_or("ok").alias("oracle"),
        F.min(F.when(F.col("ok"), F.col("slot") + 1)).alias("first_correct_position"),
        F.first("gold_answer").alias("gold_answer"),
        F.first("answer_mode").alias("answer_mode"),
        F.first("problem").alias("problem"),
    )
    return out.select(
        "example_id", "problem", "gold_answer", "answer_mode", "n_candidates", "oracle", "first_correct_position",
        F.col("f.ok").alias("first_ok"), F.col("b.ok").alias("base_ok"), F.col("v.ok").alias("verifier_ok"),
        F.col("f.candidate").alias("first_text"), F.col("b.candidate").alias("base_text"), F.col("v.candidate").alias("verifier_text"), F.col("v.slot").alias("verifier_slot"), F.col("b.slot").alias("base_slot"),
        *(["top_margin", "right_margin"] if margins else []),
    )


def exact_match(predictions: DataFrame) -> DataFrame:
    """total, correct, accuracy of (prediction, gold_answer, answer_mode); `correct` is trusted where it is given."""
    ok = answers_match(F.col("prediction"), F.col("gold_answer"), answer_mode(F.col("answer_mode")))
    if "correct" in predictions.columns:
        ok = F.coalesce(F.col("correct"), ok)
    return predictions.agg(F.count("*").alias("total"), F.count_if(ok).alias("correct")).withColumn("accuracy", rate(F.col("correct"), F.col("total")))


def ovf_columns() -> list[Column]:
    n, o = F.count("*"), F.count_if("oracle")
    return [
        n.alias("total_examples"), o.alias("oracle_correct"), rate(o, n).alias("oracle_coverage"), rate(F.count_if("first_ok"), n).alias("first_accuracy"),
        rate(F.count_if("base_ok"), n).alias("base_accuracy"), rate(F.count_if("verifier_ok"), n).alias("verifier_accuracy"),
        rate(F.count_if("first_ok"), o).alias("first_given_oracle"), rate(F.count_if("base_ok"), o).alias("base_given_oracle"), rate(F.count_if("verifier_ok"), o).alias("verifier_given_oracle"),
    ]


def ovf(f: DataFrame) -> DataFrame:
    """Oracle coverage, selection efficiency given oracle, and accuracies."""
    return f.agg(*ovf_columns())


def failure_columns() -> list[Column]:
    o, hit = F.count_if(~F.col("oracle")), F.col("oracle")
    fails = F.count_if(~F.col("verifier_ok"))
    return [
        o.alias("oracle_miss"), F.count_if(hit & ~F.col("first_ok")).alias("first_selection_failure"), F.count_if(hit & ~F.col("base_ok")).alias("base_selection_failure"),
        F.count_if(hit & ~F.col("verifier_ok")).alias("verifier_selection_failure"), F.count_if(hit & ~F.col("first_ok") & ~F.col("base_ok") & ~F.col("verifier_ok")).alias("all_fail_on_hit"), rate(o, fails).alias("miss_share_of_failures"),
    ]


def failure_decomposition(f: DataFrame) -> DataFrame:
    return f.agg(*failure_columns())


def selection_efficiency(f: DataFrame) -> DataFrame:
    """(selector, correct, oracle_correct, efficiency), one row for each selector."""
    rows = f.select("oracle", F.explode(F.create_map(F.lit("first"), "first_ok", F.lit("base"), "base_ok", F.lit("verifier"), "verifier_ok")).alias("selector", "ok"))
    return rows.groupBy("selector").agg(F.count_if("ok").alias("correct"), F.count_if("oracle").alias("oracle_correct")).withColumn("efficiency", rate(F.col("correct"), F.col("oracle_correct")))


def rescue_columns() -> list[Column]:
    pairs = [("first", "base"), ("first", "verifier"), ("base", "verifier")]
    return [*[F.count_if(~F.col(f"{a}_ok") & F.col(f"{b}_ok")).alias(f"{b}_rescues_{a}") for a, b in pairs], *[F.count_if(F.col(f"{a}_ok") & ~F.col(f"{b}_ok")).alias(f"{b}_overrules_{a}") for a, b in pairs]]


def rescue_counts(f: DataFrame) -> DataFrame:
    """Gains and losses of a selector over another: rescues are right where the other is wrong."""
    return f.agg(*rescue_columns())


def right_pattern() -> Column:
    bit = lambda k: F.col(k).cast("int").cast("string")
    return F.concat(F.lit("F"), bit("first_ok"), F.lit("B"), bit("base_ok"), F.lit("V"), bit("verifier_ok"))


def oracle_patterns(f: DataFrame) -> DataFrame:
    return f.where("oracle").groupBy(right_pattern().alias("pattern")).agg(F.count("*").alias("n"))


def size_columns() -> list[Column]:
    return [F.count("*").alias("n"), share(F.col("oracle")).alias("oracle_rate"), share(F.col("first_ok")).alias("first_rate"), share(F.col("base_ok")).alias("base_rate"), share(F.col("verifier_ok")).alias("verifier_rate")]


def count_breakdown(f: DataFrame) -> DataFrame:
    """By pool size: examples, their share, accuracies."""
    rows = f.groupBy("n_candidates").agg(*size_columns())
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def prediction_hygiene(rows: DataFrame, text: str = "prediction", mode: str = "answer_mode") -> DataFrame:
    """Rates of parseable, leaking, scaffolded and doubled answers over predictions."""
    t, m = F.col(text), F.col(mode)
    return rows.agg(F.count("*").alias("n"), share(parse_answer(t, m).isNotNull()).alias("parseable_rate"), share(instruction_leak(t)).alias("leak_rate"), share(scaffold_residue(t)).alias("scaffold_rate"), share(malformed_wrapper(t)).alias("wrapper_rate"))


def sections(f: DataFrame, text: str = "verifier_text") -> DataFrame:
    """All counted sections of the report on a run in one scan of its per-example facts `f`: (section, n_candidates, pattern)
    and the structs summary, right, failures, rescues, sizes, paired and hygiene.

    GROUPING SETS give a row of section `all`, one `pool_size` row for each number of candidates and one `pattern` row for
    each pattern of right selectors among hits; examples without a hit share the `pattern` row of null. Texts are judged
    before the sets fan out, so only flags are copied, and counts are added up before they are shuffled. Without examples
    there are no rows, as grouping sets have it; totals() has one.
    """
    judged, parts = _judged(f, text)
    name = F.when(F.grouping("n_candidates") == 0, "pool_size").when(F.grouping("pattern") == 0, "pattern").otherwise("all")
    sets = judged.groupingSets([[], ["n_candidates"], ["pattern"]], "n_candidates", "pattern")
    return sets.agg(name.alias("section"), *parts).select("section", "n_candidates", "pattern", *PARTS)


def totals(f: DataFrame, text: str = "verifier_text") -> DataFrame:
    """The structs of sections() over all examples: one row, with counts and rates of 0 where there are none."""
    judged, parts = _judged(f, text)
    return judged.agg(*parts)


def _judged(f: DataFrame, text: str) -> tuple[DataFrame, list[Column]]:
    t, m = F.col(text), F.col("answer_mode")
    judged = f.select(
        "n_candidates", F.when(F.col("oracle"), right_pattern()).alias("pattern"), "oracle", "first_ok", "base_ok", "verifier_ok",
        parse_answer(t, m).isNotNull().alias("parseable"), instruction_leak(t).alias("leak"), scaffold_residue(t).alias("scaffold"), malformed_wrapper(t).alias("wrapper"),
    )
    hygiene = [F.count("*").alias("n"), *[share(F.col(c)).alias(f"{c}_rate") for c in ("parseable", "leak", "scaffold", "wrapper")]]
    right = [F.count_if(f"{k}_ok").alias(k) for k in ("base", "first", "verifier")]
    parts = [ovf_columns(), right, failure_columns(), rescue_columns(), size_columns(), pair_columns("base_ok", "verifier_ok"), hygiene]
    return judged, [F.struct(*columns).alias(k) for k, columns in zip(PARTS, parts, strict=True)]


def merge_hygiene(rows: DataFrame, fallback: DataFrame, columns: list[str], on: str) -> DataFrame:
    """`rows` with nulls of `columns` filled from `fallback`, and `provenance`: summary, fallback or mixed."""
    filled = rows.join(fallback.select(on, *[F.col(c).alias(f"_{c}") for c in columns]), on, "left")
    used = F.size(F.filter(F.array(*[F.col(c).isNull() & F.col(f"_{c}").isNotNull() for c in columns]), lambda x: x))
    label = F.when(used == 0, "summary").when(used == len(columns), "fallback").otherwise("mixed")
    return filled.select(on, *[F.coalesce(c, f"_{c}").alias(c) for c in columns], label.alias("provenance"))


def pool_hygiene(slots: DataFrame) -> DataFrame:
    """Rates over all slots, and duplicates by answer key. Numbers and letters are read once for each slot; parse states and
    keys follow from them."""
    t, choice = F.col("candidate"), F.col("answer_mode") == "choice_letter"
    read = slots.select("example_id", "answer_mode", "candidate", extract_numeric(t).alias("_number"), F.when(choice, extract_choice(t)).alias("_letter"), normalize_answer(t).alias("_text"))
    parsed = F.when(choice, F.col("_letter").isNotNull()).when(F.col("answer_mode") == "numeric", F.col("_number").isNotNull()).otherwise(F.col("_text") != "")
    k = F.coalesce(F.concat(F.lit("choice:"), "_letter"), F.concat(F.lit("num:"), "_number"), F.concat(F.lit("text:"), "_text"))
    by_key = read.groupBy("example_id", k.alias("k")).agg(
        F.count("*").alias("n"), F.count_if(parsed).alias("parseable"), F.count_if(instruction_leak(t)).alias("leaks"), F.count_if(scaffold_residue(t)).alias("scaffolds"), F.count_if(malformed_wrapper(t)).alias("wrappers"), F.sum(token_count(t)).alias("tokens")
    )
    per = by_key.groupBy("example_id").agg(F.sum("n").alias("n"), F.count("*").alias("unique"), *[F.sum(c).alias(c) for c in ("parseable", "leaks", "scaffolds", "wrappers", "tokens")])
    n = F.sum("n")
    return per.agg(
        F.count("*").alias("examples"), n.alias("slots"), F.sum("unique").alias("unique_keys"), (n - F.sum("unique")).alias("duplicate_slots"), F.count_if(F.col("n") > F.col("unique")).alias("examples_with_duplicates"),
        rate(F.sum("parseable"), n).alias("parseable_rate"), rate(F.sum("leaks"), n).alias("leak_rate"), rate(F.sum("scaffolds"), n).alias("scaffold_rate"), rate(F.sum("wrappers"), n).alias("wrapper_rate"), rate(F.sum("tokens"), n).alias("avg_tokens"),
    )


def numeric_duplication(slots: DataFrame) -> DataFrame:
    """Distribution of the number of distinct numeric answers in a pool: (unique_answers, examples, duplicate_slots)."""
    per = slots.groupBy("example_id").agg(F.count(extract_numeric(F.col("candidate"))).alias("n"), F.count_distinct(extract_numeric(F.col("candidate"))).alias("unique_answers"))
    return per.groupBy("unique_answers").agg(F.count("*").alias("examples"), F.sum(F.col("n") - F.col("unique_answers")).alias("duplicate_slots"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value, nulls in a bucket of their own (-1)."""
    return rows.groupBy(F.coalesce(F.col(column).cast("long"), F.lit(-1)).alias("bucket")).agg(F.count("*").alias("n"))


def motif_coverage(tags: DataFrame) -> DataFrame:
    """From motif tag rows: examples whose problem motif no non-fragment candidate has, all-fragment pools, pools without a
    complete attempt; by whether any candidate is right."""
    fragment = F.col("quality_label") == "fragment"
    per = tags.groupBy("example_id").agg(
        F.bool_or("candidate_is_correct").alias("oracle"),
        (~F.bool_or(~fragment & (F.col("motif_label") == F.col("problem_motif_label")))).alias("missing"),
        F.bool_and(fragment).alias("all_fragment"),
        (~F.bool_or(F.col("quality_label") == "complete_attempt")).alias("no_complete"),
        F.count_distinct("motif_label").alias("motifs"),
    )
    return per.groupBy("oracle").agg(F.count("*").alias("examples"), F.count_if("missing").alias("missing_motif"), F.count_if("all_fragment").alias("all_fragment"), F.count_if("no_complete").alias("no_complete"), F.avg("motifs").alias("avg_motifs"))


def label_histogram(tags: DataFrame) -> DataFrame:
    """(kind, label, n) for motifs, qualities and problem motifs; problems count once for each example."""
    kinds = F.array(F.struct(F.lit("motif").alias("kind"), F.col("motif_label").alias("label")), F.struct(F.lit("quality").alias("kind"), F.col("quality_label").alias("label")))
    slots = tags.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.label").agg(F.count("*").alias("n"))
    return slots.unionByName(tags.groupBy(F.lit("problem").alias("kind"), F.col("problem_motif_label").alias("label")).agg(F.count_distinct("example_id").alias("n")))


def conversion_by_bucket(events: DataFrame) -> DataFrame:
    """Rates before and after repair by source bucket, repaired slots only."""
    return events.where("repair_applied").groupBy("source_bucket").agg(F.count("*").alias("n"), share(F.col("before_correct")).alias("before_rate"), share(F.col("after_correct")).alias("after_rate"), share(F.col("selected_by_verifier")).alias("selected_rate"), F.count_if("selected_correct").alias("selected_correct"))


def final_source(events: DataFrame) -> DataFrame:
    """Where the selected candidate of each example came from, and how often it is right."""
    chosen = events.where("selected_by_verifier").groupBy("example_id").agg(F.min_by(F.struct("repair_applied", "after_correct"), "source_slot_id").alias("s"))
    every = events.select("example_id").distinct().join(chosen, "example_id", "left")
    source = F.when(F.col("s").isNull(), "unknown").when(F.col("s.repair_applied"), "repaired").otherwise("original")
    return every.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("s.after_correct", F.lit(False))).alias("correct"))


def transition(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs over the same examples: new, common and lost oracle hits, and the verifier's gains and losses on them."""
    j = a.select("example_id", F.col("oracle").alias("o1"), F.col("verifier_ok").alias("v1")).join(b.select("example_id", F.col("oracle").alias("o2"), F.col("verifier_ok").alias("v2")), "example_id")
    kind = F.when(~F.col("o1") & F.col("o2"), "new_hit").when(F.col("o1") & ~F.col("o2"), "lost_hit").when(F.col("o1"), "common_hit").otherwise("common_miss")
    return j.groupBy(kind.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("v1").alias("first_run_correct"), F.count_if("v2").alias("second_run_correct"), F.count_if(F.col("v1") & ~F.col("v2")).alias("verifier_losses"))


def external_buckets(f: DataFrame) -> DataFrame:
    """Paired outcome of base and verifier by the form of the loser's answer."""
    outcome = F.when(F.col("base_ok") & F.col("verifier_ok"), "both").when(F.col("verifier_ok"), "verifier_only").when(F.col("base_ok"), "base_only").otherwise("neither")
    loser = F.when(F.col("verifier_ok"), F.col("base_text")).otherwise(F.col("verifier_text"))
    return f.groupBy(outcome.alias("outcome"), wrong_form(loser).alias("form")).agg(F.count("*").alias("n"))


def persistent_miss(f: DataFrame) -> DataFrame:
    """Hits that the verifier misses: by the form of its choice and by how far the best right candidate's margin lies below.
    `f`: flags() with margins, so that pools are gone through once."""
    miss = f.where("oracle and not verifier_ok")
    gap = F.col("top_margin") - F.col("right_margin")
    bucket = F.when(gap.isNull(), "unscored").when(gap <= 100, "close").when(gap <= 5000, "middle").otherwise("far")
    return miss.groupBy(wrong_form(F.col("verifier_text")).alias("form"), bucket.alias("gap")).agg(F.count("*").alias("n"))


def dominant_bucket(rows: DataFrame, names: list[str], by: str, *more: Column) -> DataFrame:
    """The name of the largest of several counts, the earliest on ties, and further columns of the row."""
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("n"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    return rows.select(by, best["name"].alias("dominant"), best["n"].alias("n"), *more)


def seed_stability(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """mean, sample deviation (0 for one run), min, max and spread of a metric over runs."""
    m = F.col(metric)
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.avg(m).alias("mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std"), F.min(m).alias("low"), F.max(m).alias("high"), (F.max(m) - F.min(m)).alias("spread"))


def weighted_avg(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_avg"))


def best_row(rows: DataFrame, metric: str, tie: str, by: str | None = None) -> DataFrame:
    """The row of largest metric (null last, smallest tie column first) as columns."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(metric).isNotNull(), F.col(metric), -F.col(tie)))
    return rows.groupBy(*([by] if by else [])).agg(best.alias("b")).select("b.*")


def tension_rows(rows: DataFrame, by: str, baseline: str, oracle: str = "oracle_rate", verifier: str = "verifier_rate") -> DataFrame:
    """Rows whose oracle rose and verifier fell against the baseline of their group."""
    return with_baseline(rows, by, baseline, [oracle, verifier]).where((F.col(f"{oracle}_delta") > 0) & (F.col(f"{verifier}_delta") < 0))


def with_baseline(rows: DataFrame, by: str, baseline: str, metrics: list[str], method: str = "method") -> DataFrame:
    """`rows` with <metric>_delta against the row of method `baseline` in the same group: an aggregate joined back, which
    needs no sort and no window over a large group."""
    base = rows.where(F.col(method) == baseline).groupBy(by).agg(*[F.max(m).alias(f"_{m}") for m in metrics])
    return rows.join(base, by, "left").withColumns({f"{m}_delta": F.col(m) - F.col(f"_{m}") for m in metrics}).drop(*[f"_{m}" for m in metrics])


def baseline_board(rows: DataFrame, by: str, baseline: str, oracle: str = "oracle_rate", verifier: str = "verifier_rate", method: str = "method") -> DataFrame:
    """`rows` with <metric>_delta against the row of method `baseline` in the same group, `best` (has the group's highest
    verifier, then oracle rate, then name) and `tension` (oracle rose and verifier fell): one scan and one shuffle. For rows
    of a report, of which a group holds one for each method; with_baseline() is for larger groups."""
    group = Window.partitionBy(by)
    first = F.max(F.struct(verifier, oracle, method)).over(group)
    board = rows.withColumn("best", F.col(method) == first[method])
    board = board.withColumns({f"{m}_delta": F.col(m) - F.max(F.when(F.col(method) == baseline, F.col(m))).over(group) for m in (oracle, verifier)})
    return board.withColumn("tension", F.coalesce((F.col(f"{oracle}_delta") > 0) & (F.col(f"{verifier}_delta") < 0), F.lit(False)))


def scored_rows(rows: DataFrame, by: str, conditions: dict[str, str]) -> DataFrame:
    """(all_rows, row, n, c0, c1, ...): each row by its key `by`, and one line with all_rows true that counts the rows and those
    that meet each SQL condition. GROUPING SETS give both in one scan; without rows there is no line."""
    counts = [F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    return rows.groupingSets([[by], []], by).agg((F.grouping(by) == 1).alias("all_rows"), F.first(F.struct(*rows.columns)).alias("row"), F.count("*").alias("n"), *counts).drop(by)


def method_summary(slots: DataFrame, f: DataFrame) -> DataFrame:
    """One row on a pool: examples, cap, coverage, accuracies, parse and duplicate rates, tokens."""
    return ovf(f).join(F.broadcast(pool_hygiene(slots))).join(F.broadcast(f.agg(F.max("n_candidates").alias("max_candidates"))))


def candidate_budget(rows: DataFrame, position: str) -> DataFrame:
    """Pool width of the first row alone, which is what a run reports as its budget."""
    return rows.agg(F.min_by(F.size("candidates"), position).alias("budget"))


def generation_metrics(rows: DataFrame) -> DataFrame:
    """Token totals and throughput of rows (tokens, seconds)."""
    return rows.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("avg_tokens"), F.max("seconds").alias("wall_seconds"), F.try_divide(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"))


def required_nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) for each required column; one that is missing counts as null in every row."""
    counts = [F.count_if(F.col(c).isNull()) if c in rows.columns else F.count("*") for c in columns]
    one = rows.agg(F.array(*[F.struct(F.lit(c).alias("column"), n.alias("nulls")) for c, n in zip(columns, counts, strict=True)]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def scorecard(rows: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(section, status): ready if the SQL condition holds for all rows, partial for some, waiting for none."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(sections.values())])
    status = lambda i: F.when(F.col(f"c{i}") == 0, "waiting").when(F.col(f"c{i}") == F.col("n"), "ready").otherwise("partial")
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), status(i).alias("status")) for i, s in enumerate(sections)])).alias("x")).select("x.*")


def readiness(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Counts by severity and whether a release is practical (no blocker) and strict (all ok)."""
    s = F.col(severity)
    return rows.agg(*[F.count_if(s == k).alias(k) for k in ("ok", "caveat", "pending", "blocker")], F.coalesce(F.bool_and(s != "blocker"), F.lit(True)).alias("practical"), F.coalesce(F.bool_and(s == "ok"), F.lit(True)).alias("strict"))


def all_fragment_examples(slots: DataFrame) -> DataFrame:
    return slots.groupBy("example_id").agg(F.bool_and(quality(F.col("candidate"))["label"] == "fragment").alias("all_fragment")).where("all_fragment").select("example_id")
