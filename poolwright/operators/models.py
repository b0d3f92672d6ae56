"""Model-backed operators as batch interfaces. A model is an object that workers make once for each task and call on lists;
the ones here are deterministic stand-ins by hash. Inputs and outputs are DataFrames, calls go through mapInPandas."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolwright.functions.answers import answer_facts, answers_match, key
from poolwright.functions.hygiene import format_candidate, repair_rejection_reasons
from poolwright.functions.labels import prompt
from poolwright.functions.motif import quality
from poolwright.functions.text import parse_index, parse_score, token_count
from poolwright.operators.joins import candidate_pairs
from poolwright.operators.ordered import pair_rank
from poolwright.operators.pool import keep_first, refused
from poolwright.operators.texts import joined_once, made_once, with_made


class Scorer(Protocol):
    def score(self, prompts: list[str]) -> list[tuple[float, float]]:
        """Log-probabilities of yes and no for each prompt."""


class Generator(Protocol):
    def generate(self, prompts: list[str], n: int) -> list[list[str]]:
        """n texts for each prompt, the same ones whenever it is asked again: Spark repeats lost tasks, and a prompt that many
        examples share is asked once."""


def _unit(*parts: object) -> float:
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:7], "big") / float(1 << 56)


class HashScorer:
    def __init__(self, seed: int = 0):
        self.seed = seed

    def score(self, prompts: list[str]) -> list[tuple[float, float]]:
        return [(-_unit(self.seed, "yes", p), -_unit(self.seed, "no", p)) for p in prompts]


class HashGenerator:
    def __init__(self, seed: int = 0):
        self.seed = seed

    def generate(self, prompts: list[str], n: int) -> list[list[str]]:
        return [[f"Step 1: consider it.\nFinal answer: {int(50 * _unit(self.seed, i, p))}" for i in range(n)] for p in prompts]


def score_yes_no(rows: DataFrame, make: Callable[[], Scorer], text: str = "prompt") -> DataFrame:
    """`rows` with yes_score, no_score and margin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            pairs = model.score(b[text].tolist())
            yield b.assign(yes_score=[y for y, _ in pairs], no_score=[n for _, n in pairs], margin=[y - n for y, n in pairs])

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1] + ",yes_score:double,no_score:double,margin:double")


def generate(rows: DataFrame, make: Callable[[], Generator], n: int = 1, text: str = "prompt") -> DataFrame:
    """`rows` with the array `generated`, null where there is no prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            asked = b[text].tolist()
            made = iter(model.generate([p for p in asked if p is not None], n))
            yield b.assign(generated=[None if p is None else next(made) for p in asked])

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1] + ",generated:array<string>")


def score_candidates(slots: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    asked = slots.select("example_id", "slot", "candidate", prompt("verify", F.col("problem"), F.col("answer_mode"), attempt=F.col("candidate")).alias("prompt"))
    return score_yes_no(asked, make).drop("prompt")


def with_margins(slots: DataFrame, scorers: dict[str, Callable[[], Scorer]], texts: DataFrame | None = None) -> DataFrame:
    """`slots` with the margin of each scorer under its name, and `_read`, the answer_facts() of the candidate. Each distinct
    prompt is scored once where these are few; all scorers go through the rows together. `texts`: rows (problem, answer_mode,
    candidate), as for with_made()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {name: make() for name, make in scorers.items()}
        for b in batches:
            asked = b["_prompt"].tolist()
            yield b.drop(columns="_prompt").assign(**{name: [y - n for y, n in model.score(asked)] for name, model in models.items()})

    def made(rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("_prompt", prompt("verify", F.col("problem"), F.col("answer_mode"), attempt=F.col("candidate")))
        scored = asked.mapInPandas(run, rows.schema.simpleString()[7:-1] + "".join(f",{name}:double" for name in scorers))
        return scored.withColumn("_read", answer_facts(F.col("candidate")))

    return with_made(slots.drop(*scorers), ["problem", "answer_mode", "candidate"], made, [*scorers, "_read"], texts)


def scored_rows(slots: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """Scored prediction rows: candidates by falling margin, the first one the prediction."""
    s = score_candidates(slots, make).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("margin")).alias("o"), F.col("slot").alias("candidate_index"), F.col("candidate").alias("candidate_answer"), "yes_score", "no_score", "margin"))).alias("c"))
    facts = slots.groupBy("example_id").agg(F.first("gold_answer").alias("gold_answer"), F.first("answer_mode").alias("answer_mode"))
    rows = s.join(facts, "example_id").select("example_id", F.col("c")[0]["candidate_answer"].alias("prediction"), "gold_answer", "answer_mode", F.transform("c", lambda x: x.dropFields("o")).alias("candidates"))
    return rows.withColumn("correct", answers_match(F.col("prediction"), F.col("gold_answer"), F.col("answer_mode")))


def generate_pools(problems: DataFrame, make: Callable[[], Generator], n: int = 16, most: int = 8, texts: DataFrame | None = None) -> DataFrame:
    """n samples for each problem, formatted, one of each key, at most `most`. Problems that read the same are asked once where
    distinct ones are few. `texts`: rows (problem, answer_mode) with all of them, if some are cheaper to make."""
    once = candidates_of(problems if texts is None else texts, make, n, most)
    return with_candidates(problems, once, make, n, most)


def candidates_of(problems: DataFrame, make: Callable[[], Generator], n: int, most: int) -> DataFrame | None:
    """(problem, answer_mode, candidates) for each problem that differs, None where they aren't few."""
    return made_once(problems, ["problem", "answer_mode"], _sampled(make, n, most), ["candidates"])


def with_candidates(problems: DataFrame, once: DataFrame | None, make: Callable[[], Generator], n: int, most: int) -> DataFrame:
    """Pools of problems; `once`: candidates_of() them, whose absence means that each row is asked."""
    rows = problems.select("example_id", "problem", "gold_answer", "answer_mode")
    if once is None:
        return _sampled(make, n, most)(rows).select(*rows.columns, "candidates")
    return joined_once(rows, once, ["problem", "answer_mode"], ["candidates"])


def _sampled(make: Callable[[], Generator], n: int, most: int) -> Callable[[DataFrame], DataFrame]:
    def made(rows: DataFrame) -> DataFrame:
        asked = generate(rows.withColumn("prompt", prompt("answer", F.col("problem"), F.col("answer_mode"))), make, n)
        said = asked.withColumn("_f", F.filter(F.transform("generated", lambda t: format_candidate(t, F.col("answer_mode"))), lambda t: t != ""))
        return said.withColumn("candidates", F.slice(keep_first(F.col("_f"), lambda t: key(t, F.col("answer_mode"))), 1, most))

    return made


def generate_completions(pools: DataFrame, previews: DataFrame, make: Callable[[], Generator], n: int = 4) -> DataFrame:
    """(example_id, completions) from prompt previews; texts whose key the pool has are left out."""
    made = generate(previews.select("example_id", "prompt"), make, n).join(pools.select("example_id", "candidates", "answer_mode"), "example_id")
    texts = F.filter(F.transform("generated", lambda t: format_candidate(t, F.col("answer_mode"))), lambda t: t != "")
    k = lambda t: key(t, F.col("answer_mode"))
    made = made.withColumns({"_t": texts, "_k": F.transform("candidates", k)})
    return made.select("example_id", keep_first(F.filter("_t", lambda t: ~F.array_contains("_k", k(t))), k).alias("completions"))


def generate_repairs(targets: DataFrame, make: Callable[[], Generator], n: int = 2) -> DataFrame:
    """(example_id, slot, text): the first acceptable of n repairs of each target slot."""
    asked = targets.select("example_id", "slot", "answer_mode", "quality_label", prompt("repair", F.col("problem"), F.col("answer_mode"), attempt=F.col("candidate")).alias("prompt"))
    made = generate(asked, make, n)
    fine = F.filter(F.transform("generated", lambda t: format_candidate(t, F.col("answer_mode"))), lambda t: F.size(repair_rejection_reasons(t, F.col("answer_mode"), F.col("quality_label"), quality(t)["label"])) == 0)
    return made.select("example_id", "slot", F.get(fine, 0).alias("text")).where("text is not null")


def with_repairs(slots: DataFrame, make: Callable[[], Generator], target: Column | None = None, n: int = 2) -> DataFrame:
    """Slots (problem, answer_mode, candidate, quality_label) with `fixed`: the first acceptable of n repairs, or the candidate
    where there is none or it is refused. Slots that are no `target` aren't asked for."""
    ask = prompt("repair", F.col("problem"), F.col("answer_mode"), attempt=F.col("candidate"))
    made = generate(slots.withColumn("prompt", ask if target is None else F.when(target, ask)), make, n)
    fine = F.filter(F.transform("generated", lambda t: format_candidate(t, F.col("answer_mode"))), lambda t: F.size(repair_rejection_reasons(t, F.col("answer_mode"), F.col("quality_label"), quality(t)["label"])) == 0)
    made, text, old = made.withColumn("_text", F.get(fine, 0)), F.col("_text"), F.col("candidate")
    return made.withColumn("fixed", F.when(text.isNull() | (~text.eqNullSafe(old) & refused(text, F.col("answer_mode"))), old).otherwise(text)).drop("prompt", "generated", "_text")


def generate_predictions(problems: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """One prediction for each problem, with its token count."""
    asked = problems.select("example_id", "gold_answer", "answer_mode", prompt("answer", F.col("problem"), F.col("answer_mode")).alias("prompt"))
    made = generate(asked, make).select("example_id", "gold_answer", "answer_mode", F.get("generated", F.lit(0)).alias("prediction"))
    return made.withColumn("tokens", token_count(F.col("prediction")))


def rank_pairwise(pools: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """(example_id, text, wins, score, rank) of capped pools, from scores of candidate pairs."""
    pairs = candidate_pairs(pools).withColumn("prompt", F.concat_ws("\n", "left", "right"))
    return pair_rank(score_yes_no(pairs, make).select("example_id", "left", "right", F.col("margin").alias("score")))


def select_by_question(pools: DataFrame, make: Callable[[], Generator]) -> DataFrame:
    """The model names the candidate (1 to n) whose question comes nearest; anything else means the first."""
    asked = pools.select("example_id", "gold_answer", "answer_mode", "candidates", F.concat_ws("\n", "problem", F.array_join("candidates", "\n---\n")).alias("prompt"))
    made = generate(asked, make)
    return made.select("example_id", "gold_answer", "answer_mode", F.get("candidates", parse_index(F.get("generated", F.lit(0)), F.size("candidates"))).alias("prediction"))


def self_refine(problems: DataFrame, make: Callable[[], Generator], rounds: int = 1) -> DataFrame:
    """First answer, then feedback and a better answer, `rounds` times."""
    rows = generate(problems.select("*", prompt("answer", F.col("problem"), F.col("answer_mode")).alias("prompt")), make).withColumn("prediction", F.get("generated", F.lit(0))).drop("prompt", "generated")
    for _ in range(rounds):
        rows = generate(rows.withColumn("prompt", prompt("feedback", F.col("problem"), F.col("answer_mode"), attempt=F.col("prediction"))), make).withColumn("feedback", F.get("generated", F.lit(0))).drop("prompt", "generated")
        asked = rows.withColumn("prompt", prompt("refine", F.col("problem"), F.col("answer_mode"), attempt=F.col("prediction"), feedback=F.col("feedback")))
        rows = generate(asked, make).withColumn("prediction", F.coalesce(F.nullif(F.get("generated", F.lit(0)), F.lit("")), "prediction")).drop("prompt", "generated", "feedback")
    return rows


def tree_search(problems: DataFrame, make: Callable[[], Generator], scorer: Callable[[], Scorer], width: int = 2, branch: int = 3, depth: int = 2) -> DataFrame:
    """Beam search over partial solutions: `branch` continuations of each, the `width` best distinct ones kept."""
    rows = problems.select("example_id", "problem", "gold_answer", "answer_mode", F.lit("").alias("text"), F.lit(0.0).alias("score"))
    for _ in range(depth):
        grown = generate(rows.withColumn("prompt", F.concat_ws("\n", prompt("answer", F.col("problem"), F.col("answer_mode")), "text")), make, branch)
        parts = grown.select("example_id", "problem", "gold_answer", "answer_mode", F.explode(F.transform("generated", lambda g: F.concat_ws("\n", F.nullif("text", F.lit("")), g))).alias("text"))
        scored = score_yes_no(parts.withColumn("prompt", F.concat_ws("\n", "problem", "text")), scorer).withColumn("score", parse_score(F.lit("")) + F.col("margin"))
        once = scored.groupBy("example_id", "problem", "gold_answer", "answer_mode", "text").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("example_id").orderBy(F.desc("score"), "text"))
        rows = once.withColumn("_r", rank).where(F.col("_r") <= width).drop("_r")
    best = F.max_by(F.struct("text", "gold_answer", "answer_mode"), F.col("score"))
    return rows.groupBy("example_id").agg(best.alias("b")).select("example_id", F.col("b.text").alias("prediction"), "b.gold_answer", "b.answer_mode")
