"""Record builders: problems, traces, training pairs, prediction rows and interchange formats, as projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolwright.functions.answers import canonical_numeric, extract_numeric, final_answer_teacher, match_teacher
from poolwright.functions.labels import prompt
from poolwright.functions.text import brief_reasoning, clip, filtered_cot, normalize_reasoning, strip, subgoals, synthesize_trace
from poolwright.operators.ordered import negatives, shuffle_seeded
from poolwright.sources.files import work_path

#: Answer modes of known datasets (fixed values).
DATASET_MODES = {"gsm8k": "numeric", "gsm8k_full_clean": "numeric", "competition_math_numeric": "numeric", "competition_math": "numeric", "mmlu_pro": "choice_letter", "gpqa_diamond": "choice_letter"}


def first_predictions(pools: DataFrame) -> DataFrame:
    """The first candidate of each pool, empty for an empty pool."""
    return pools.select("example_id", F.coalesce(F.get("candidates", F.lit(0)), F.lit("")).alias("prediction"), "gold_answer", "answer_mode")


def candidate_set(rows: DataFrame) -> DataFrame:
    """The canonical pool row; absent columns get their defaults."""
    defaults = {"dataset": F.lit("unknown"), "problem": F.lit(""), "gold_answer": F.lit(""), "candidates": F.array().cast("array<string>"), "answer_mode": F.lit("numeric"), "choices": F.array().cast("array<string>")}
    return rows.select(F.col("example_id").cast("string").alias("example_id"), *[(F.coalesce(c, d) if c in rows.columns else d).alias(c) for c, d in defaults.items()])


def infer_mode(mode: Column, dataset: Column) -> Column:
    by_dataset = [F.when(F.lower(strip(dataset)) == k, F.lit(v)) for k, v in DATASET_MODES.items()]
    return F.coalesce(F.nullif(F.lower(strip(mode)), F.lit("")), *by_dataset, F.lit("numeric"))


def processed_traces(traces: DataFrame) -> DataFrame:
    t = F.col("teacher_trace")
    return traces.withColumns(
        {"filtered_cot": filtered_cot(t), "brief_reasoning": brief_reasoning(t), "subgoals": subgoals(t), "teacher_trace": normalize_reasoning(t), "trace_valid": F.coalesce("trace_valid", F.lit(True)), "answer_mode": F.coalesce("answer_mode", F.lit("numeric"))}
    )


def _answer() -> Column:
    return F.concat(F.lit("Final answer: "), "gold_answer")


#: Responses of the four kinds of training pairs.
SFT_KINDS: dict[str, Callable[[], Column]] = {
    "answer_only": _answer,
    "filtered_cot": lambda: strip(F.concat_ws("\n", "filtered_cot", _answer())),
    "subgoals_then_answer": lambda: strip(F.concat_ws("\n", F.array_join(F.transform("subgoals", lambda g, i: F.concat(F.lit("Sub-goal "), (i + 1).cast("string"), F.lit(": "), g)), "\n"), _answer())),
    "brief_reasoning_then_answer": lambda: strip(F.concat_ws("\n", "brief_reasoning", _answer())),
}


def sft(processed: DataFrame, kind: str) -> DataFrame:
    ask = F.concat(F.lit("Problem: "), "problem", F.lit("\nAnswer with the requested format."))
    return processed.select("example_id", ask.alias("prompt"), SFT_KINDS[kind]().alias("response"), F.lit(kind).alias("supervision_type"), "gold_answer", "answer_mode")


def fanout_sft(processed: DataFrame, valid_only: bool = False) -> DataFrame:
    """All kinds of pairs in one pass over the traces: an explode, not four scans."""
    rows = processed.where(F.coalesce("trace_valid", F.lit(True))) if valid_only else processed
    ask = F.concat(F.lit("Problem: "), "problem", F.lit("\nAnswer with the requested format."))
    pairs = F.array(*[F.struct(F.lit(k).alias("supervision_type"), r().alias("response")) for k, r in SFT_KINDS.items()])
    return rows.select("example_id", ask.alias("prompt"), "gold_answer", "answer_mode", F.explode(pairs).alias("p")).select("example_id", "prompt", "p.response", "p.supervision_type", "gold_answer", "answer_mode")


def teacher_traces(problems: DataFrame) -> DataFrame:
    """Template traces, with the answer read back from them and whether it matches."""
    trace = synthesize_trace(F.col("gold_answer"))
    rows = problems.withColumns({"teacher_trace": trace, "teacher_model": F.lit("template"), "generation_prompt": prompt("teacher", F.col("problem"), F.col("answer_mode"))})
    rows = rows.withColumn("teacher_final_answer", final_answer_teacher(F.col("teacher_trace")))
    return rows.withColumn("trace_valid", match_teacher(F.col("teacher_final_answer"), F.col("gold_answer")))


def verifier_sets(rows: DataFrame, count: int = 3, seed: int = 7) -> DataFrame:
    """Gold answer and distinct negatives of each problem, in hash order."""
    answers = rows.select(F.col("gold_answer").alias("answer"))
    made = negatives(rows, answers, count, seed)
    return made.withColumn("candidates", shuffle_seeded(F.concat(F.array("gold_answer"), "negatives"), seed + 1, F.col("example_id"))).drop("negatives")


def verifier_yesno(sets: DataFrame) -> DataFrame:
    """A yes/no pair for each candidate of verifier_sets()."""
    rows = sets.select("example_id", "problem", "answer_mode", "gold_answer", F.explode("candidates").alias("candidate"))
    return rows.select("example_id", prompt("verify", F.col("problem"), F.col("answer_mode"), attempt=F.col("candidate")).alias("prompt"), F.when(F.col("candidate") == F.col("gold_answer"), "yes").otherwise("no").alias("response"))


def gold_after_marks(answer: Column) -> Column:
    """What follows the last #### of a worked answer."""
    return strip(F.element_at(F.split(answer, "####"), -1))


def benchmark_math(rows: DataFrame) -> DataFrame:
    """(problem, solution) with a canonical numeric gold answer; the query fails where there is none."""
    gold = extract_numeric(F.col("solution"))
    return rows.withColumn("gold_answer", F.coalesce(gold, F.raise_error(F.concat(F.lit("no numeric answer: "), clip(F.col("problem"), 80))).cast("string"))).withColumn("answer_mode", F.lit("numeric"))


def _letter(i: Column) -> Column:
    return F.char(i + 65)


def options_block(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(_letter(i), F.lit(". "), o)), "\n")


def benchmark_options(rows: DataFrame) -> DataFrame:
    """(question, options, answer, answer_index): problem with lettered options; the letter is given or comes from its index."""
    return rows.withColumns({"problem": F.concat_ws("\n", "question", options_block(F.col("options"))), "gold_answer": F.coalesce(F.nullif(strip(F.col("answer")), F.lit("")), _letter(F.col("answer_index"))), "answer_mode": F.lit("choice_letter")})


def benchmark_shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """(question, correct, incorrect): options in an order fixed by seed and id; gold is the first option equal to the correct
    one."""
    options = shuffle_seeded(F.concat(F.array("correct"), "incorrect"), seed, F.col("example_id"))
    shuffled = rows.withColumn("options", options)
    return shuffled.withColumns({"problem": F.concat_ws("\n", "question", options_block(F.col("options"))), "gold_answer": _letter(F.array_position("options", F.col("correct")).cast("int") - 1), "answer_mode": F.lit("choice_letter")})


#: Builders by benchmark.
BUILDERS: dict[str, Callable[..., DataFrame]] = {"competition_math": benchmark_math, "mmlu_pro": benchmark_options, "gpqa": benchmark_shuffled}


def to_prompt_answer(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("problem").alias("prompt"), F.col("gold_answer").alias("answer"), "example_id", "answer_mode")


def to_prompt_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("problem").alias("prompt"), "example_id", "gold_answer", "answer_mode")


def from_responses(problems: DataFrame, responses: DataFrame, position: str = "pos") -> DataFrame:
    """Response rows (global_index, responses) as prediction rows of the problems at those positions."""
    joined = problems.join(responses, problems[position] == responses["global_index"])
    return joined.select("example_id", F.coalesce(F.get("responses", F.lit(0)), F.lit("")).alias("prediction"), "gold_answer", "answer_mode", "responses")


def required_for(artifacts: DataFrame, rows: list[str]) -> DataFrame:
    """Artifacts that any of the chosen rows needs."""
    return artifacts.where(F.array_contains("required_for", "all") | F.arrays_overlap("required_for", F.array(*map(F.lit, rows)).cast("array<string>")))


def missing_motif(tags: DataFrame) -> DataFrame:
    """Examples without any right candidate whose problem motif no candidate beyond a fragment has, worst first."""
    found = F.collect_set(F.when(F.col("quality_label") != "fragment", F.col("motif_label")))
    per = tags.groupBy("example_id").agg(F.first("problem_motif_label").alias("problem_motif"), found.alias("observed"), F.count_if(F.col("quality_label") == "fragment").alias("fragments"), F.bool_or("candidate_is_correct").alias("oracle"))
    return per.where(~F.col("oracle") & ~F.array_contains("observed", F.col("problem_motif"))).select("example_id", "problem_motif", F.array_sort("observed").alias("observed"), "fragments").orderBy(F.desc("fragments"), "problem_motif", "example_id")


def prompt_preview(pools: DataFrame, tags: DataFrame, variant: str = "complete") -> DataFrame:
    """What a generator would be asked for each example, with the motifs seen so far."""
    seen = tags.where("quality_label <> 'fragment'").groupBy("example_id").agg(F.array_sort(F.collect_set("motif_label")).alias("observed_motifs"), F.first("problem_motif_label").alias("problem_motif"))
    rows = pools.join(seen, "example_id", "left")
    return rows.select("example_id", F.coalesce("observed_motifs", F.array().cast("array<string>")).alias("observed_motifs"), F.lit(variant).alias("variant"), prompt(variant, F.col("problem"), F.col("answer_mode"), motif=F.col("problem_motif")).alias("prompt"))


def manifest(runs: DataFrame, reparsed: DataFrame, metrics: list[str], by: str = "run_id") -> DataFrame:
    """Run rows whose metrics are the reparsed ones where there are any, and whether each run was reparsed."""
    r = reparsed.select(by, *[F.col(m).alias(f"_{m}") for m in metrics])
    j = runs.join(r, by, "left")
    return j.withColumns({"reparsed": F.coalesce(*[F.col(f"_{m}") for m in metrics]).isNotNull(), **{m: F.coalesce(f"_{m}", m) for m in metrics}}).drop(*[f"_{m}" for m in metrics])


def serialize_example(rows: DataFrame, limit: int = 160) -> DataFrame:
    return rows.select("example_id", clip(F.col("problem"), limit).alias("problem"), "gold_answer", *[clip(F.col(c), limit).alias(c) for c in ("first_text", "base_text", "verifier_text")], "first_ok", "base_ok", "verifier_ok")


def empty_predictions(problems: DataFrame) -> DataFrame:
    """Placeholder prediction rows of a run that hasn't been made."""
    return problems.select("example_id", F.lit("").alias("prediction"), "gold_answer")


def numeric_gold(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gold_answer", canonical_numeric(F.col("gold_answer")))


def latest_position(rows: DataFrame, *order: Column | str) -> DataFrame:
    """`rows` with a gapless `pos` from 0 in the given order: sorted in ranges and stored with each row's range and place, then
    counted by range, no single task. Bounds of ranges come from a sample, another one each time that the plan runs, so places
    are only good beside the counts of the same run: both are read from what is stored."""
    path, at = work_path(rows.sparkSession, "positions"), 1 << 33  # ids: the range above, the place in it below
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.withColumn("_part", part).join(F.broadcast(counts.select("_part", "_base")), "_part")
    return joined.withColumn("pos", F.col("_base") + F.pmod("_at", F.lit(at))).drop("_part", "_at", "_base")
