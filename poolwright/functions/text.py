"""Text as Column -> Column functions. White space is Unicode white space unless said otherwise; null stays null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Classes of characters as Python has them, in every pattern of answers and texts: white space with the separators 1C to 1F,
#: decimal digits of all scripts, and what a word is made of.
SPACE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
DIGIT, WORD = r"\p{Nd}", r"[\p{L}\p{N}_]"
#: What ends a line.
BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_NUMERALS = "".join(chr(c) for c in range(128, 0x20000) if unicodedata.decimal(chr(c), None) is not None)
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _NUMERALS)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, _NUMERALS, _VALUES)).otherwise(t))


#: The characters of SPACE one by one.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Trimmed from both ends, without a search through the text as a pattern would make."""
    return F.btrim(text, F.lit(_BLANKS))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends. Single spaces are left as they are, so most texts aren't written anew;
    those of printable ASCII without two spaces in a row, as most are, aren't searched for runs either."""

    def of(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("  ")) | t.rlike("[^ -~]"), F.regexp_replace(t, rf"(?! (?!{SPACE})){SPACE}+", " ")).otherwise(t)

    return strip(let(text, of))


def freeform(text: Column) -> Column:
    return F.lower(collapse(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text))


def lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, BREAK), strip), lambda x: x != "")


def clip(text: Column, limit: int = 160) -> Column:
    """Collapsed text of at most `limit` characters; a longer one ends in dots within the limit."""
    return let(collapse(text), lambda flat: F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat))


def _any(text: Column, parts: tuple[str, ...], test: Callable[[Column, Column], Column]) -> Column:
    """Is the test met by one of the parts? The text is computed once, not for each part."""
    return let(text, lambda s: F.exists(F.array(*map(F.lit, parts)), lambda p: test(s, p)))


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return _any(text, prefixes, F.startswith)


def ends_with_any(text: Column, suffixes: tuple[str, ...]) -> Column:
    return _any(text, suffixes, F.endswith)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return _any(text, parts, F.contains)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


# --- reasoning traces -------------------------------------------------------------------------------------------------

_FILLERS = ("okay, let's see", "ok, let's see", "let's see", "let me think")


def normalize_reasoning(text: Column) -> Column:
    return F.array_join(lines(text), "\n")


def reasoning_lines(text: Column) -> Column:
    """Lines that neither give the final answer nor are thinking tags."""
    return F.filter(lines(text), lambda x: ~F.startswith(F.lower(x), F.lit("final answer:")) & ~F.lower(x).isin("<think>", "</think>"))


def filtered_cot(text: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(reasoning_lines(text), 1, most), "\n")


def _unnumbered(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^\d+[).\s-]*", ""))


def subgoals(text: Column, most: int = 3) -> Column:
    return F.slice(F.filter(F.transform(reasoning_lines(text), _unnumbered), lambda x: x != ""), 1, most)


def brief_reasoning(text: Column, most: int = 2) -> Column:
    """The first sentences, numbering, answer tails and filler sentences left out."""
    cleaned = F.transform(reasoning_lines(text), lambda x: strip(F.regexp_replace(_unnumbered(x), r"(?i)Final answer:\s*.*$", "")))
    flat = F.array_join(F.filter(cleaned, lambda x: x != ""), " ")
    sentences = F.transform(F.split(flat, r"(?<=[.!?])\s+"), strip)
    return F.array_join(F.slice(F.filter(sentences, lambda s: (s != "") & ~starts_with_any(F.lower(s), _FILLERS)), 1, most), "\n")


def synthesize_trace(gold: Column) -> Column:
    """A template trace that ends in the gold answer."""
    steps = "1. Identify the quantities and the target value.\n2. Perform the intermediate computation needed to solve the problem.\n3. Verify the result is consistent with the question.\n"
    return F.concat(F.lit(steps + "Final answer: "), gold)


# --- numbers as text ---------------------------------------------------------------------------------------------------


def fmt_number(value: Column, digits: int = 4, signed: bool = False) -> Column:
    """Fixed digits, `NA` for null."""
    return F.when(value.isNull(), "NA").otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f", value.cast("double")))


def round6(value: Column) -> Column:
    return F.bround(value, 6)


def parse_score(text: Column) -> Column:
    """The last digit 1 to 5 that stands alone, else 1."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b([1-5])\b"), 1), F.lit(-1)).cast("int"), F.lit(1))


def parse_index(text: Column, n: Column) -> Column:
    """Zero-based index from the last whole number within 1 to n, else 0."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), 0), lambda x: x.try_cast("int")), lambda x: x.between(F.lit(1), n))
    return F.coalesce(F.try_element_at(found, F.lit(-1)) - 1, F.lit(0))


def markdown_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, line): each row's other columns as a line of a Markdown table, numbers with a fraction in four digits, `NA` for
    null, bars escaped and line breaks as spaces."""

    def cell(name: str, kind: str) -> Column:
        said = F.format_string("%.4f", name) if kind in ("double", "float") else F.replace(F.replace(F.col(name).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        return F.when(F.col(name).isNull(), F.lit("NA")).otherwise(said)

    cells = [cell(n, k) for n, k in rows.dtypes if n not in keys]
    return rows.select(*keys, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
