"""Answers: normal form, numbers, choice letters, and when two answers match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolwright.functions.text import DIGIT, SPACE, WORD, ascii_digits, collapse, let, lines, strip

NUMBER = rf"[-+]?{DIGIT}+(?:,{DIGIT}{{3}})*(?:\.{DIGIT}+)?(?:[eE][-+]?{DIGIT}+)?"
_CHOICE = rf"(?i)(?:final answer|answer|option|choice){SPACE}*[:\-]?{SPACE}*\(?([A-J])\)?"


def normalize_answer(text: Column) -> Column:
    """Lower case, stripped, without one leading `final answer:`."""
    mark = "final answer:"
    low = F.lower(strip(text))
    return F.when(F.startswith(low, F.lit(mark)), strip(F.substr(low, F.lit(len(mark) + 1), F.char_length(low)))).otherwise(low)


#: Significant digits and the largest exponent of the decimal context in which numbers are spelled (fixed values).
PRECISION, FURTHEST = 28, 30


def _half_even(digits: Column) -> Column:
    """struct(sig, more): PRECISION digits of a longer digit string without zeros at its end, rounded half to even, zeros at the
    end left out; `more` is 1 where a digit was carried over the front."""
    kept, after = F.substring(digits, 1, PRECISION), F.substr(digits, F.lit(PRECISION + 1), F.char_length(digits))
    odd = F.substring(kept, -1, 1).isin("1", "3", "5", "7", "9")
    up = (after > "5") | ((after == "5") & odd)
    raised = (kept.try_cast("decimal(38,0)") + up.cast("int")).cast("string")
    return let(raised, lambda r: F.struct(F.regexp_replace(r, "0+$", "").alias("sig"), (F.char_length(r) - PRECISION).alias("more")))


def canonical_numeric(token: Column) -> Column:
    """One spelling for each number, as text: no commas, plus sign, or zeros at the ends of the fraction; `-0` stays; an
    exponent is written out, except beyond 30 places. Null where the token is no finite number.

    Whole numbers within 30 places keep all digits. Others are rounded to 28 digits, half to even, as are all beyond 30
    places; what has become whole by it loses the zeros at its end. Digits may be those of any script.
    """

    def plain(c: Column) -> Column:
        sign = F.when(F.startswith(c, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        whole, part = F.regexp_extract(c, r"^[-+]?(\d*)", 1), F.regexp_extract(c, r"\.(\d*)", 1)
        power = F.coalesce(F.nullif(F.regexp_extract(c, r"[eE]([-+]?\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))

        def spelled(s: Column) -> Column:
            digits, lead, first = s["sig"], s["sign"], s["first"]
            size = F.char_length(digits)
            tail = F.substr(digits, F.lit(2), F.greatest(size - 1, F.lit(0)))
            science = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(size > 1, F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), F.when(first >= 0, "+").otherwise(""), first.cast("string"))
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-first - 1, F.lit(0))), digits)
            zeros = F.when(s["rounded"], 0).otherwise(F.greatest(first + 1 - size, F.lit(0)))
            integer = F.concat(F.substr(digits, F.lit(1), F.greatest(first + 1, F.lit(0))), F.repeat(F.lit("0"), zeros))
            large = F.concat(integer, F.when(size > first + 1, F.concat(F.lit("."), F.substr(digits, first + 2, size))).otherwise(""))
            return F.concat(lead, F.when(size == 0, F.lit("0")).when(s["far"], science).when(first < 0, small).otherwise(large))

        def rounded(s: Column) -> Column:
            size, far = F.char_length(s["sig"]), F.abs(s["first"]) > FURTHEST
            inexact = (size > PRECISION) & (far | (size > s["first"] + 1))
            short = let(_half_even(s["sig"]), lambda r: F.struct(r["sig"].alias("sig"), (s["first"] + r["more"]).alias("first"), F.lit(True).alias("rounded")))
            as_is = F.struct(s["sig"].alias("sig"), s["first"].alias("first"), F.lit(False).alias("rounded"))
            return let(F.when(inexact, short).otherwise(as_is), lambda r: F.struct(r["sig"].alias("sig"), s["sign"].alias("sign"), r["first"].alias("first"), r["rounded"].alias("rounded"), far.alias("far")))

        all_digits = F.concat(whole, part)
        zeros = F.char_length(F.regexp_extract(all_digits, "^0*", 0))
        sig = F.regexp_replace(F.regexp_replace(all_digits, "^0+", ""), "0+$", "")
        facts = F.struct(sig.alias("sig"), sign.alias("sign"), (F.char_length(whole) + power - zeros - 1).alias("first"))
        return let(let(facts, rounded), spelled)

    cleaned = ascii_digits(F.translate(strip(token), ",_", ""))
    valid = r"\A[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]{1,9})?\z"
    # most numbers are short and need no decimal context: whole ones are their own spelling, others lose zeros at the end
    return F.when(token.rlike(_WHOLE), token).when(token.rlike(_SHORT), F.regexp_replace(token, r"\.?0+\z", "")).otherwise(let(cleaned, lambda c: F.when(c.rlike(valid), plain(c))))


#: Short numbers in ASCII digits, without signs of plus, commas, exponents or zeros in front.
_WHOLE, _SHORT = r"\A-?(?:0|[1-9][0-9]{0,17})\z", r"\A-?(?:0|[1-9][0-9]{0,13})\.[0-9]{1,10}\z"


def _last_number(tokens: Column) -> Column:
    """The last token that is a number, in canonical form: as a rule the last one, so the others are spelled only if it isn't."""
    every = lambda t: F.try_element_at(F.filter(F.transform(t, canonical_numeric), lambda x: x.isNotNull()), F.lit(-1))
    return let(tokens, lambda t: F.coalesce(canonical_numeric(F.try_element_at(t, F.lit(-1))), every(t)))


def extract_numeric(text: Column) -> Column:
    """The last boxed number, else the last number, in canonical form."""

    def of(n: Column) -> Column:
        boxed = F.when(F.contains(n, F.lit("\\boxed{")), _last_number(F.regexp_extract_all(n, F.lit(r"\\boxed\{([^}]+)\}"), 1)))
        return F.when(n.rlike(_WHOLE), n).otherwise(F.coalesce(boxed, _last_number(F.regexp_extract_all(n, F.lit(NUMBER), 0))))

    return let(normalize_answer(text), of)


def extract_numeric_tail(text: Column) -> Column:
    """A number that ends the text: boxed at the end, or the last line is an answer line, `answer is`, bare, or `= n`."""

    def of(n: Column) -> Column:
        tail = F.coalesce(F.try_element_at(lines(n), F.lit(-1)), n)
        forms = (
            rf"\A(?:final answer|answer){SPACE}*[:\-]?{SPACE}*({NUMBER}){SPACE}*[.!?]*\z",
            rf"\A(?:the{SPACE}+)?answer{SPACE}+is{SPACE}+({NUMBER}){SPACE}*[.!?]*\z",
            rf"\A\(?({NUMBER})\)?[.!?]*\z",
            rf"\A[^\n]*={SPACE}*({NUMBER}){SPACE}*[.!?]*\z",
        )
        found = [F.nullif(F.regexp_extract(n, rf"\\boxed\{{([^}}]+)\}}{SPACE}*[.!?]*{SPACE}*\z", 1), F.lit(""))]
        found += [F.nullif(F.regexp_extract(tail, p, 1), F.lit("")) for p in forms]
        return F.coalesce(*[canonical_numeric(x) for x in found])

    return let(normalize_answer(text), of)


def extract_choice(text: Column) -> Column:
    """The last labelled letter A to J, else a text that is one letter, else the only letter that stands alone."""

    def of(s: Column) -> Column:
        labelled = F.upper(F.try_element_at(F.regexp_extract_all(s, F.lit(_CHOICE), 1), F.lit(-1)))
        single = F.upper(F.nullif(F.regexp_extract(normalize_answer(s), r"\A\(?([a-j])\)?[.)]?\z", 1), F.lit("")))
        alone = F.regexp_extract_all(F.upper(s), F.lit(rf"(?<!{WORD})([A-J])(?!{WORD})"), 1)
        return F.coalesce(labelled, single, F.when(F.size(alone) == 1, F.get(alone, 0)))

    return let(strip(text), of)


def answer_mode(mode: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(mode)), F.lit("")), F.lit("numeric"))


def parse_answer(text: Column, mode: Column, validity: str = "loose") -> Column:
    """The answer a text gives under its mode, null if none; validity `tail_anchored` wants numbers at the end."""
    number = extract_numeric_tail(text) if validity == "tail_anchored" else extract_numeric(text)
    return F.when(mode == "choice_letter", extract_choice(text)).when(mode == "numeric", number).otherwise(F.nullif(normalize_answer(text), F.lit("")))


def answer_facts(text: Column) -> Column:
    """struct(same, number, letter): all that answers_match() reads of a prediction."""
    return F.struct(normalize_answer(text).alias("same"), extract_numeric(text).alias("number"), extract_choice(text).alias("letter"))


def facts_match(facts: Column, gold: Column, mode: Column) -> Column:
    """answers_match() of a prediction whose answer_facts() are known. Short whole numbers and single letters, which most gold
    answers are, are their own normal forms."""
    same, number, letter, choice = facts["same"], facts["number"], facts["letter"], mode == "choice_letter"
    read = (same == normalize_answer(gold)) | F.when(choice, letter == F.coalesce(extract_choice(gold), F.upper(normalize_answer(gold)))).otherwise(number == extract_numeric(gold))
    whole = (same == gold) | F.when(choice, letter == gold).otherwise(number == gold)
    option = (same == F.lower(gold)) | (choice & (letter == gold))
    return F.coalesce(F.when(gold.rlike(_WHOLE), whole).when(gold.rlike(r"\A[A-J]\z"), option).otherwise(read), F.lit(False))


def answers_match(prediction: Column, gold: Column, mode: Column) -> Column:
    """Equal normal forms, else equal letters or equal numbers as the mode has it."""
    same = normalize_answer(prediction) == normalize_answer(gold)
    letter = extract_choice(prediction) == F.coalesce(extract_choice(gold), F.upper(normalize_answer(gold)))
    return F.coalesce(same | F.when(mode == "choice_letter", letter).otherwise(extract_numeric(prediction) == extract_numeric(gold)), F.lit(False))


def match_numeric_only(prediction: Column, gold: Column) -> Column:
    """As answers_match for numbers, whatever the mode says."""
    return F.coalesce((normalize_answer(prediction) == normalize_answer(gold)) | (extract_numeric(prediction) == extract_numeric(gold)), F.lit(False))


def match_teacher(prediction: Column, gold: Column) -> Column:
    """The weaker rule of teacher traces: equal texts or equal last number tokens as written."""
    last = lambda t: F.try_element_at(F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), 0), F.lit(-1))
    return F.coalesce((F.lower(strip(prediction)) == F.lower(strip(gold))) | (last(prediction) == last(gold)), F.lit(False))


def final_answer_teacher(reasoning: Column) -> Column:
    """What the last clean `final answer:` line says, else the last line."""
    said = F.transform(F.regexp_extract_all(reasoning, F.lit(r"(?i)final answer:\s*(.+)"), 1), strip)
    clean = F.filter(said, lambda x: (x != "") & ~F.contains(x, F.lit("<")) & ~F.contains(F.lower(x), F.lit("your answer")))
    return F.coalesce(F.try_element_at(clean, F.lit(-1)), F.try_element_at(lines(reasoning), F.lit(-1)), F.lit(""))


def extract_prediction(text: Column) -> Column:
    """The line that answers: a labelled line (or the one after an empty label), a box, `the answer is`, else the last line."""
    label = r"(?i)^(?:final answer|answer)\s*[:\-]\s*"

    def of(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0))), lambda i: F.coalesce(F.get(rows, i).rlike(label), F.lit(False)))
        last = F.try_element_at(at, F.lit(-1))
        said = strip(F.regexp_replace(F.get(rows, last), label, ""))
        return F.coalesce(
            F.nullif(said, F.lit("")),
            F.nullif(strip(F.get(rows, last + 1)), F.lit("")),
            F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]+)\}"), 1), F.lit(-1)),
            F.nullif(strip(F.regexp_extract(text, r"(?i)the answer is\s*:?\s*([^\n.]+)", 1)), F.lit("")),
            F.try_element_at(rows, F.lit(-1)),
            F.lit(""),
        )

    return let(lines(text), of)


def parse_status(text: Column, mode: Column) -> Column:
    choice = F.when(extract_choice(text).isNotNull(), "parseable_choice").otherwise("unparseable_choice")
    number = F.when(extract_numeric(text).isNotNull(), "parseable_numeric").otherwise("unparseable_numeric")
    return F.when(mode == "choice_letter", choice).otherwise(number)


def has_valid_final(text: Column, mode: Column) -> Column:
    return parse_answer(text, mode).isNotNull()


def canonical_text(text: Column) -> Column:
    return collapse(normalize_answer(text))


def key(text: Column, mode: Column, profile: str = "mode_aware") -> Column:
    """What makes two candidates the same.

    mode_aware: the letter in choice mode, else the number, else the text. letter_then_number: a choice text without a
    letter may still be a number. number_or_text: no letters at all. parsed: under prefixes of its own. text: the text.
    """
    words = F.concat(F.lit("text:"), normalize_answer(text))
    number, letter = F.concat(F.lit("num:"), extract_numeric(text)), F.concat(F.lit("choice:"), extract_choice(text))
    if profile == "text":
        return words
    if profile == "number_or_text":
        return F.coalesce(number, words)
    if profile == "letter_then_number":
        return F.coalesce(F.when(mode == "choice_letter", letter), number, words)
    if profile == "parsed":
        return F.coalesce(F.concat(F.lit("parsed::"), parse_answer(text, mode)), F.concat(F.lit("text::"), canonical_text(text)))
    return F.coalesce(F.when(mode == "choice_letter", letter).otherwise(number), words)


def key_family(candidate: Column, token: Column, mode: str = "answer_token") -> Column:
    return F.concat(F.lit("token::"), F.coalesce(F.nullif(token, F.lit("")), candidate)) if mode == "answer_token" else F.concat(F.lit("surface::"), candidate)
