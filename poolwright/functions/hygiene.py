"""Defects of a candidate: leaked instructions, scaffolding, malformed endings; and the cleaning of candidate texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolwright.functions.answers import canonical_numeric, extract_choice, extract_numeric, extract_prediction, parse_answer
from poolwright.functions.text import contains_any, ends_with_any, let, lines, occurrences, starts_with_any, strip, token_count

#: Phrases that only an instruction has, by profile (fixed values). `selector` is the longest list.
LEAKS = {
    "selector": (
        "use at most",
        "just output the final answer",
        "just output the answer",
        "do not include any explanation",
        "do not include any reasoning",
        "do not produce any other text",
        "the last line must contain",
        "the last line should be",
        "this is a multiple-choice task",
        "you may reason about the options briefly",
        "the correct answer is one of the options listed",
        "the final answer must be",
        "your answer must be",
        "the answer must be",
        "single option letter",
        "single option-letter",
        "do not write anything else",
    ),
    "analysis": (
        "you are improving an incomplete candidate pool",
        "this is a multiple-choice task",
        "the final answer must be",
        "the answer must be",
        "do not include any explanation",
        "do not write anything else",
        "single option letter",
        "final answer in the required format",
    ),
    "repair": (
        "use at most",
        "exactly one last line",
        "do not mention",
        "do not use markdown",
        "do not output",
        "the solution should",
        "you should not include any other text",
        "the final answer is the only thing you output",
        "the answer is the final line",
        "answer should be in the box",
        "answer should be in a box",
        "the final answer is the time",
        "the final answer is the amount",
        "the final answer is the total cost",
        "final answer: final answer:",
    ),
    "provenance": (
        "use at most",
        "exactly one last line",
        "do not mention",
        "do not output",
        "the solution should",
        "the solution must",
        "you are improving",
        "you are finishing",
        "do not include",
    ),
    "normalize": (
        "use at most",
        "exactly one last line",
        "do not mention",
        "do not critique",
        "do not stop mid-sentence",
        "do not output",
        "do not use markdown",
        "reply with yes or no",
        "single option letter only",
        "the last line must contain",
        "the final answer must be",
        "your answer must be",
        "the answer must be",
    ),
    "completion": (
        "you are improving an incomplete candidate pool",
        "you are finishing the strongest incomplete attempt",
        "you are writing one concise complete solution",
        "use any useful partial steps",
        "pick one useful path from the incomplete attempts",
        "use the likely reasoning motif as a planning cue",
        "produce one complete alternative solution",
        "choose the most promising path",
        "the final solution must be self-contained and decisive",
        "do not mention the attempts",
        "do not critique them",
        "do not stop mid-sentence",
        "do not output general advice",
        "this is a multiple-choice task",
        "you may reason about the options briefly",
        "the last line must contain the single option letter only",
        "on the last line, write",
        "you may use any of the given options",
        "you may use any of the options",
        "you may use any mathematical or logical steps",
        "you may use any of the following mathematical operations",
        "just output the final answer",
        "do not include any explanation",
        "do not include any explanation or reasoning",
        "do not produce any other text besides the final answer",
        "the correct answer is one of the options listed",
    ),
    "forms": ("use at most", "do not use", "do not mention", "prompt-writing", "role tags"),
}
#: Openings that a model writes before it answers, by profile (fixed values).
SCAFFOLD_STARTS = ("let me think", "let's think", "okay, let's", "here's the thought process", "i will now provide", "the sentence structure", "use at most")
SCAFFOLD_PREFIXES = (
    r"here'?s the thought process:\s*",
    r"let'?s think(?: about this)?(?: step by step)?[.!]?\s*",
    r"let me think(?: about this)?(?: step by step)?[.!]?\s*",
    r"(?:okay,\s*)?let'?s tackle this problem(?: step by step)?[.:]?\s*",
    r"(?:okay,\s*)?let'?s break down the question again[.:]?\s*",
    r"wait,\s*but that'?s not correct[.!]?\s*",
    r"wait,\s*that'?s not correct[.!]?\s*",
)
#: More of the same, looked for at the start alone (fixed values).
_SCAFFOLD_MORE = (
    r"the solution (?:should|must)(?: not)? be [^.!?\n]*(?:[.!?]\s*|$)",
    r"the last line should be [^.!?\n]*(?:[.!?]\s*|$)",
    r"use the options given(?: above)?[.!?]?\s*",
    r"do not output the letter of the option until the last line[.!?]?\s*",
)
#: Characters of a text that is a number, a box around one or a sum (fixed value).
_NUMERIC_LIKE = r"\A[\s$\\boxed{}\[\]\-+*/().,0-9]+\z"
#: Openings of a line that gives an answer (fixed values).
_ANSWER_LINES = ("final answer:", "answer:", "option:", "choice:")


def instruction_leak(text: Column, profile: str = "selector") -> Column:
    return contains_any(F.lower(strip(text)), LEAKS[profile])


def scaffold_residue(text: Column) -> Column:
    start = rf"(?i)\A(?:{'|'.join(SCAFFOLD_PREFIXES + _SCAFFOLD_MORE)})"
    return let(strip(text), lambda s: s.rlike(start) | starts_with_any(F.lower(s), SCAFFOLD_STARTS))


#: What a slot event counts as scaffolding, anywhere in the text (fixed values).
SCAFFOLD_PARTS = ("here's a complete solution", "here is the correct solution", "here's the candidate solution", "let's think", "let us think", "okay, let's")


def scaffold_parts(text: Column) -> Column:
    return contains_any(F.lower(text), SCAFFOLD_PARTS)


def malformed_wrapper(text: Column) -> Column:
    return occurrences(F.lower(text), "final answer:") > 1


def malformed(text: Column, mode: Column, validity: str = "loose") -> Column:
    """Empty, a bare verdict, a doubled marker, a leak, a dangling end, an open bracket, or two words without an answer."""

    def of(s: Column) -> Column:
        low = F.lower(s)
        return (  # verdicts and endings: fixed values
            (s == "")
            | low.isin("correct", "incorrect", "true", "false", "none", "n/a")
            | malformed_wrapper(s)
            | instruction_leak(s)
            | ends_with_any(s, (":", "-", "=", "(", "[", "{", ",", " or", " and", " the"))
            | s.rlike(r"\[[^\[\]]*\z|\([^()]*\z|\{[^{}]*\z")
            | (parse_answer(s, mode, validity).isNull() & (token_count(s) <= 2))
        )

    return let(strip(text), of)


def wrong_form(text: Column) -> Column:
    """What kind of wrong answer a text is."""

    def of(p: Column) -> Column:
        low = F.lower(p)
        bare = strip(F.replace(F.replace(p, F.lit("Final answer:"), F.lit("")), F.lit("final answer:"), F.lit("")))
        steps = ("step 1", "step 2", "step 3", "let me think", "here's the solution", "here is the solution", "wait,", "okay,")
        return (
            F.when(p == "", "empty")
            .when(contains_any(low, LEAKS["forms"]), "instruction_leak")
            .when(contains_any(low, steps) | ends_with_any(p, (":", "=")), "scaffold_or_fragment")
            .when((F.char_length(bare) <= 32) & ~F.contains(bare, F.lit("\n")) & bare.rlike(_NUMERIC_LIKE), "short_numeric_like")
            .when(F.contains(low, F.lit("final answer:")) & (F.char_length(p) <= 80), "answer_like_short")
            .when(F.char_length(p) > 180, "long_reasoning")
            .otherwise("other_wrong_form")
        )

    return let(strip(text), of)


def short_numeric_like(text: Column, mode: Column) -> Column:
    return (mode == "numeric") & extract_numeric(text).isNotNull() & (token_count(text) <= 6)


def strip_scaffold(text: Column) -> Column:
    """All scaffold openings off the front, in any order and number."""
    return strip(F.regexp_replace(strip(text), rf"(?i)\A(?:\s*(?:{'|'.join(SCAFFOLD_PREFIXES)}))++", ""))


def meta_instruction(line: Column, profile: str = "selector") -> Column:
    return contains_any(F.lower(strip_scaffold(line)), LEAKS[profile])


def strip_meta_lines(text: Column, profile: str = "selector") -> Column:
    """Lines without scaffold openings; lines that instruct are left out unless they give the answer."""
    fine = lambda x: (x != "") & let(F.lower(x), lambda low: starts_with_any(low, _ANSWER_LINES) | ~contains_any(low, LEAKS[profile]))
    return F.array_join(F.filter(F.transform(lines(text), strip_scaffold), fine), "\n")


def sanitize(text: Column) -> Column:
    """Cut at the first role turn, meta lines out, and at most one final answer line, the last thing said."""

    def of(s: Column) -> Column:
        return let(F.instr(F.lower(s), "final answer:"), lambda at: F.when(at == 0, s).otherwise(let(parts(s, at), joined)))

    def parts(s: Column, at: Column) -> Column:
        before = strip_meta_lines(F.substr(s, F.lit(1), F.greatest(at - 1, F.lit(0))))
        said = F.coalesce(F.get(lines(F.substr(s, at + F.lit(len("final answer:")), F.char_length(s))), 0), F.lit(""))
        return F.struct(s.alias("s"), before.alias("before"), F.regexp_replace(said, r"(?i)\A(?:final answer\s*:\s*)++", "").alias("said"))

    def joined(p: Column) -> Column:
        line = F.concat(F.lit("Final answer: "), p["said"])
        return F.when((p["said"] != "") & (p["before"] != ""), F.concat(p["before"], F.lit("\n"), line)).when(p["said"] != "", line).otherwise(p["s"])

    turns = r"(?is)\n(?:human|user|assistant|problem)\b[,:]?.*\z"
    return let(strip_meta_lines(strip(F.regexp_replace(strip(text), turns, ""))), of)


def prefix_without_answer(text: Column) -> Column:
    """Lines before the first answer line, without instructions."""

    def head(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda x: starts_with_any(F.lower(x), _ANSWER_LINES)), True)
        return let(first, lambda n: F.when(n > 0, F.slice(rows, F.lit(1), n.cast("int") - 1)).otherwise(rows))

    return F.array_join(F.filter(let(lines(text), head), lambda x: ~meta_instruction(x)), "\n")


def answer_token(text: Column, mode: Column) -> Column:

    def of(said: Column) -> Column:
        return F.when(mode == "choice_letter", F.coalesce(extract_choice(said), extract_choice(text))).when(mode == "numeric", F.coalesce(extract_numeric(said), extract_numeric(text))).otherwise(F.nullif(said, F.lit("")))

    return let(extract_prediction(text), of)


def normalize_candidate(text: Column, mode: Column, style: str = "canonical_answerline") -> Column:
    """struct(text, action): the candidate as one answer line, or with its reasoning kept before it."""

    def of(s: Column) -> Column:
        before = F.lit("") if style == "canonical_answerline" else prefix_without_answer(s["work"])
        return let(F.struct(s["old"].alias("old"), s["work"].alias("work"), answer_token(s["work"], mode).alias("token"), before.alias("before")), written)

    def written(s: Column) -> Column:
        token, line = s["token"], F.concat(F.lit("Final answer: "), s["token"])
        new = F.coalesce(F.when(s["before"] != "", F.concat(s["before"], F.lit("\n"), line)).otherwise(line), s["work"])
        action = F.when(token.isNull() & (s["work"] == s["old"]), "unchanged").when(token.isNull(), "sanitized_only").when(new == s["old"], "unchanged").otherwise("rewritten")
        return F.struct(new.alias("text"), action.alias("action"))

    old = strip(text)
    return let(F.struct(old.alias("old"), let(sanitize(old), lambda x: F.when(x != "", x).otherwise(old)).alias("work")), of)


def rewrite_choice(text: Column, mode: str = "canonical_answerline") -> Column:
    """struct(text, token) of a multiple-choice candidate; both null where it names no option."""
    if mode == "preserve_surface":
        work = F.coalesce(F.nullif(sanitize(text), F.lit("")), strip(text))
        return let(work, lambda w: F.struct(F.when(extract_choice(w).isNotNull(), w).alias("text"), extract_choice(w).alias("token")))
    new = normalize_candidate(text, F.lit("choice_letter"))["text"]
    return let(let(new, extract_choice), lambda t: F.struct(F.concat(F.lit("Final answer: "), t).alias("text"), t.alias("token")))


def format_candidate(text: Column, mode: Column) -> Column:
    """A generated text as a candidate: reasoning lines, then its answer line; empty where it has no answer."""
    before = let(sanitize(text), prefix_without_answer)
    line = F.concat(F.lit("Final answer: "), answer_token(text, mode))
    return let(F.struct(before.alias("before"), line.alias("line")), lambda x: F.coalesce(F.when(x["before"] != "", F.concat(x["before"], F.lit("\n"), x["line"])).otherwise(x["line"]), F.lit("")))


def dirty_count(text: Column, mode: Column, validity: str = "loose") -> Column:
    """How many of invalid, leak, scaffold and malformed a candidate is."""
    return (
        parse_answer(text, mode, validity).isNull().cast("int") + instruction_leak(text).cast("int") + scaffold_residue(text).cast("int") + malformed(text, mode, validity).cast("int")
    )


def repair_rejection_reasons(text: Column, mode: Column, source_quality: Column, quality: Column, allow_complete: bool = False, allow_non_numeric: bool = False) -> Column:
    """Why a repaired text is refused: sorted, none for an acceptable one."""
    rules = [
        (strip(text) == "", "empty"),
        (instruction_leak(text), "instruction_leak"),
        (scaffold_residue(text), "scaffold_residue"),
        (malformed_wrapper(text), "malformed_wrapper"),
        (parse_answer(text, mode).isNull(), "invalid_final_answer"),
        (quality == "fragment", "fragment_repair"),
    ]
    if not allow_complete:
        rules.append((source_quality == "complete_attempt", "source_already_complete"))
    if not allow_non_numeric:
        rules.append(((mode == "numeric") & canonical_numeric(extract_numeric(text)).isNull(), "non_numeric"))
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules])))
