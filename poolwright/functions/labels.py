"""Labels and prompts: ladders that name a delta, a bucket or a variant, and the deterministic prompt strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of a final accuracy, and the margins of competitive_tag (fixed values).
CLOSE, WATCH = 0.02, 0.05
CLEAR, PARITY = 0.03, 0.015
#: Severity by risk bucket; others are ok (fixed values).
SEVERITY = {
    "large_gap": "blocker",
    "unknown": "blocker",
    "pending": "pending",
    "partial": "caveat",
    "watch": "caveat",
    "higher_final": "caveat",
    "fallback_watch": "caveat",
    "fallback_close": "caveat",
}


def classify_delta(delta: Column, close: float = CLOSE, watch: float = WATCH) -> Column:
    """close, higher_final, watch or large_gap; null stays null."""
    size = F.abs(delta)
    return F.when(size <= close, "close").when(delta > 0, "higher_final").when(size <= watch, "watch").when(delta.isNotNull(), "large_gap")


def risk_bucket(status: Column, release: Column, fallback: Column) -> Column:
    """What stands between a row and its published final value: its status where that says so, a fallback that makes good
    for a release far below, else the class of the release delta (the fallback's where there is no release)."""
    saved = (release < -WATCH) & (F.abs(fallback) <= WATCH)
    return (
        F.when(status.isin("artifact_reproduced", "artifact_reproduced_display_ratio"), "artifact")
        .when(F.startswith(status, F.lit("partial")), "partial")
        .when(F.contains(status, F.lit("pending")), "pending")
        .when(release.isNull() & fallback.isNull(), "unknown")
        .when(saved, F.when(F.abs(fallback) <= CLOSE, "fallback_close").otherwise("fallback_watch"))
        .otherwise(classify_delta(F.coalesce(release, fallback)))
    )


def severity(bucket: Column) -> Column:
    return F.coalesce(*[F.when(bucket == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit("ok"))


def competitive_tag(delta: Column) -> Column:
    """Where we stand against an external baseline; null stays null."""
    steps = ((CLEAR, "clear_win"), (0.0, "edge_or_win"), (-PARITY, "near_parity"), (-CLEAR, "competitive_but_trailing"))
    return F.coalesce(*[F.when(delta >= limit, F.lit(tag)) for limit, tag in steps], F.when(delta.isNotNull(), "clear_trail"))


def ladder(text: Column, rules: dict[str, str], default: str) -> Column:
    """The label of the first part that the lower-cased text contains; the order of `rules` decides."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)) for k, v in rules.items()], F.lit(default))


MOTIF_PHRASES = {
    "equation_setup": "set up an equation",
    "ratio_or_proportion": "use a ratio or proportion",
    "count_aggregation": "combine counts into a total",
    "unit_conversion": "convert units",
    "temporal_or_age_shift": "reason over time or ages",
    "reverse_reasoning": "work backwards",
    "arithmetic_finish": "finish the arithmetic",
}


def describe_motif(label: Column) -> Column:
    return F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in MOTIF_PHRASES.items()], F.lit("try another approach"))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def prompt(kind: str, problem: Column, mode: Column, *, attempt: Column | None = None, motif: Column | None = None, feedback: Column | None = None) -> Column:
    """A prompt of one of the kinds teacher, answer, verify, complete, repair, feedback, refine, rank; every one ends in what
    the answer line must look like."""
    ask = F.when(mode == "choice_letter", "End with one line: Final answer: <letter>").otherwise("End with one line: Final answer: <number>")
    head = F.concat(F.lit("Problem: "), problem)
    said = F.concat(F.lit("Attempt: "), F.coalesce(attempt if attempt is not None else F.lit(""), F.lit("")))
    hint = F.concat(F.lit("Hint: "), describe_motif(motif if motif is not None else F.lit("")), F.lit("."))
    note = F.concat(F.lit("Feedback: "), F.coalesce(feedback if feedback is not None else F.lit(""), F.lit("")))
    kinds = {
        "teacher": (head, "Solve it step by step.", ask),
        "answer": (head, "Answer with the requested format.", ask),
        "verify": (head, said, "Is the final answer correct? Answer yes or no."),
        "complete": (head, hint, "Give one full solution.", ask),
        "repair": (head, said, hint, "Correct the attempt.", ask),
        "feedback": (head, said, "Say what is wrong, in two sentences at most."),
        "refine": (head, said, note, "Write a better solution.", ask),
        "rank": (head, said, "Score from 1 to 5."),
    }
    return _lines(*kinds[kind])
