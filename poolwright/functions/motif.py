"""What a candidate is doing (motif) and how far it got (quality), by cue tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolwright.functions.answers import parse_status
from poolwright.functions.hygiene import instruction_leak, malformed_wrapper, scaffold_parts
from poolwright.functions.text import ends_with_any, freeform, let, occurrences, strip, token_count

#: Cue words by motif, in the order of priority from low to high (fixed values). A pattern is a whole word or words unless
#: it is written out; `candidate` cues are looked for in the candidate alone.
PRIORITY = ("arithmetic_finish", "count_aggregation", "unit_conversion", "reverse_reasoning", "temporal_or_age_shift", "ratio_or_proportion", "equation_setup")
CANDIDATE_CUES = {
    "equation_setup": {
        "candidate:let": r"\blet\b",
        "candidate:equation": r"\bequation\b",
        "candidate:solve_for": r"\bsolve for\b",
        "candidate:variable_equals": r"\b[xy]\s*=",
        "candidate:equals": r"=",
    }
}
CUES = {
    "ratio_or_proportion": ("half", "twice", "double", "triple", "ratio", "proportion", "percent", "times as much", "per", "each"),
    "count_aggregation": ("total", "altogether", "in all", "combined", "sum", "more", "plus", "together"),
    "temporal_or_age_shift": ("age", "older", "younger", "before", "after", "remaining", "first", "then"),
    "reverse_reasoning": ("originally", "started with", "at first", "left", "remain", "difference", "how many were"),
}
#: What every match of a cue of the candidate holds.
_PLAIN = {"candidate:let": "let", "candidate:equation": "equation", "candidate:solve_for": "solve for", "candidate:variable_equals": "=", "candidate:equals": "="}
_FORMS = {"percent": r"\bpercent(?:age)?\b", "remain": r"\bremain(?:ing)?\b"}
#: Unit words by kind (fixed values).
UNITS = {
    "money": ("dollar", "dollars", "cent", "cents"),
    "length": ("inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters"),
    "weight": ("ounce", "ounces", "pound", "pounds", "gram", "grams", "kilogram", "kilograms"),
    "volume": ("cup", "cups", "liter", "liters", "gallon", "gallons"),
    "time": ("minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years"),
    "container": ("bag", "bags", "box", "boxes", "pack", "packs", "bottle", "bottles"),
}
#: Words that a text does not end in unless it is cut off (fixed values).
DANGLING = ("then", "so", "because", "which", "that", "the", "a", "an", "of", "to", "for", "from", "is", "are", "was", "were", "be", "by", "with")


def _cues(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs])) if pairs else F.array().cast("array<string>")


def unit_conversion(combined: Column) -> Column:
    """Units of two kinds, or two units and a word that links them."""
    # units are whole words, so one search finds those of all kinds
    units = F.array_distinct(F.regexp_extract_all(combined, F.lit(rf"\b({'|'.join(u for g in UNITS.values() for u in g)})\b"), 1))

    def of(found: Column) -> Column:
        kinds = F.lit(0)
        for g in UNITS.values():
            kinds = kinds + F.arrays_overlap(found, F.array(*map(F.lit, g))).cast("int")
        return (F.size(found) >= 2) & ((kinds >= 2) | combined.rlike(r"\bconvert\b|\bcontains\b|\bper\b|\beach\b"))

    return let(units, of)


def arithmetic(candidate: Column) -> Column:
    return (F.size(F.regexp_extract_all(candidate, F.lit(r"-?\d+(?:\.\d+)?"), 0)) >= 2) & candidate.rlike(r"[+\-*/=]") | candidate.rlike(r"\bsubtract\b|\badd\b|\bmultiply\b|\bdivide\b")


def motif(problem: Column, candidate: Column) -> Column:
    """struct(label, confidence, cues): the motif with most cues, ties by priority; other_or_unclear without any. Texts are put
    together once, cues are looked up once, and a word is looked for as a plain string before its bounds are."""

    def of(s: Column) -> Column:
        c, both = s["c"], s["both"]
        said = {m: [(F.contains(both, F.lit(w)) & both.rlike(_FORMS.get(w, rf"\b{w}\b")), w.replace(" ", "_")) for w in ws] for m, ws in CUES.items()}
        said |= {m: [(F.contains(c, F.lit(_PLAIN[n])) & c.rlike(p), n) for n, p in cues.items()] for m, cues in CANDIDATE_CUES.items()}
        said["count_aggregation"].append((occurrences(c, "step") >= 2, "candidate:multi_step"))
        said["unit_conversion"] = [(unit_conversion(F.concat(s["p"], F.lit(" "), c)), "unit_groups>=2")]
        said["arithmetic_finish"] = [(arithmetic(c), "candidate:arithmetic_ops"), (F.contains(c, F.lit("final answer:")), "candidate:final_answer")]
        rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("label"), _cues(said[m]).alias("cues")) for k, m in enumerate(PRIORITY)])
        best = F.array_max(F.transform(rows, lambda r: F.struct(F.size(r["cues"]).alias("n"), r["k"].alias("k"), r["label"].alias("label"), F.array_sort(r["cues"]).alias("cues"))))
        return let(
            best,
            lambda b: F.struct(
                F.when(b["n"] == 0, "other_or_unclear").otherwise(b["label"]).alias("label"),
                F.when(b["n"] == 0, 0.2).otherwise(F.round(F.least(F.lit(0.95), F.lit(0.35) + F.lit(0.12) * b["n"]), 4)).alias("confidence"),
                F.when(b["n"] == 0, F.array().cast("array<string>")).otherwise(b["cues"]).alias("cues"),
            ),
        )

    empty = F.lit("")
    texts = F.struct(freeform(F.coalesce(problem, empty)).alias("p"), freeform(F.coalesce(candidate, empty)).alias("c"))
    return let(let(texts, lambda t: F.struct(t["p"].alias("p"), t["c"].alias("c"), strip(F.concat(t["p"], F.lit("\n"), t["c"])).alias("both"))), of)


def quality(candidate: Column) -> Column:
    """struct(label, confidence, cues): fragment, partial_solution or complete_attempt."""

    def of(s: Column) -> Column:
        t, low, n = s["t"], s["low"], s["n"]
        fragment = _cues([(F.char_length(t) < 18, "short_chars"), (n <= 4, "short_words"), (ends_with_any(low, DANGLING), "dangling_suffix")])
        partial = _cues([(low.rlike(r"\b(step\s*\d+|then|so)\b"), "reasoning_marker"), (low.rlike(r"-?\d+(?:\.\d+)?"), "contains_number"), (n >= 12, "long_enough")])
        complete = _cues(
            [(low.rlike(r"\bfinal answer:\b"), "final_answer"), (F.substring(t, -1, 1).isin(".", "!", "?"), "terminal_punctuation"), (low.rlike(r"\btherefore\b|\bso the answer\b"), "final_conclusion"), (n >= 20, "substantial_length")]
        )
        return let(F.struct(fragment.alias("f"), partial.alias("p"), complete.alias("c"), t.alias("t")), judged)

    def judged(s: Column) -> Column:
        t, fragment, partial, complete = s["t"], s["f"], s["p"], s["c"]
        f, p, c = F.size(fragment), F.size(partial), F.size(complete)
        made = lambda label, top, base, step, k, cues: F.struct(F.lit(label).alias("label"), F.round(F.least(F.lit(top), F.lit(base) + F.lit(step) * k), 4).alias("confidence"), F.array_sort(cues).alias("cues"))
        rest = made("partial_solution", 0.9, 0.4, 0.1, F.greatest(p, F.lit(1)), F.when(p == 0, F.array(F.lit("default_partial"))).otherwise(partial))
        empty = F.struct(F.lit("fragment").alias("label"), F.lit(0.99).alias("confidence"), F.array(F.lit("empty")).alias("cues"))
        return F.when(t == "", empty).when((c >= 2) & (c >= p), made("complete_attempt", 0.95, 0.45, 0.12, c, complete)).when((f >= 2) & (f >= p), made("fragment", 0.95, 0.45, 0.12, f, fragment)).otherwise(rest)

    text = F.coalesce(candidate, F.lit(""))
    return let(F.struct(strip(text).alias("t"), freeform(text).alias("low"), token_count(text).alias("n")), of)


def source_bucket(text: Column, mode: Column) -> Column:
    """quality:status:flags of a slot."""
    flags = _cues([(instruction_leak(text, "provenance"), "instruction_leak"), (scaffold_parts(text), "scaffold_residue"), (malformed_wrapper(text), "malformed_wrapper")])
    return F.concat_ws(":", quality(text)["label"], parse_status(text, mode), F.when(F.size(flags) == 0, "cleanish").otherwise(F.array_join(flags, "+")))


def repair_error(candidate: Column, quality_label: Column) -> Column:
    """What a repair should look at first."""
    low = freeform(candidate)
    return (
        F.when(low == "", "empty_candidate")
        .when(quality_label == "fragment", "truncated_reasoning")
        .when(~F.contains(low, F.lit("final answer:")), "missing_final_answer")
        .when(arithmetic(low), "possible_arithmetic_slip")
        .otherwise("unclear_error")
    )
