"""Personal data by offset-preserving deobfuscation.

The plain patterns are matched in the text itself. A transducer then rewrites disguises - homoglyphs, spelled digits, `at`
and `dot` in words or brackets - and keeps for every character written the source span it came from; the same patterns
run over the rewritten text, and what they find is mapped back to source characters. Texts without any sign of an
identifier or a disguise are told apart first, for a whole batch, by two linear-time patterns. Everything runs in time
linear in the text: numbers are entered at the first digit of a run only, addresses are read outwards from their signs.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from poolwright.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that begins within a run of digits would end where one from its first digit ends.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones (fixed values).
HOMOGLYPHS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντρ" "․。‐‑‒–−﹢﹒",
        "ABESIJKMHOPCTYXaesijopcyxhdqw" "ABEZHIKMNOPTYXovtp" "..-----+.",
        strict=True,
    )
)
#: Spelled digits in English, German, French and Spanish (fixed values).
_DIGIT_WORDS = {
    w: str(i)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for i, w in enumerate(words.split())
} | {"oh": "0", "nought": "0"}
_WORDS = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<![A-Za-z])(?:plus[\s-]+)?{_WORDS}(?:[\s,.-]+{_WORDS})*(?![A-Za-z])")
_DIGIT_WORD, _PLUS_WORD, _PLUS_NUMBER = re.compile(f"(?i){_WORDS}"), re.compile(r"(?i)plus"), re.compile(r"(?i)(?<![A-Za-z])plus[\s-]*(?=[0-9])")
_AT_WORDS, _DOT_WORDS = "at|arobase|arroba|@", r"dot|punkt|punto|point"
#: The sign of a token, bracketed or between spaces, or as it is.
_TOKEN = re.compile(rf"(?i)(?P<open>[(\[{{<]\s*)?(?:(?P<at>{_AT_WORDS})|(?P<dot>{_DOT_WORDS}|\.))")
_CLOSE = re.compile(r"\s*[)\]}>]")
_DOT = rf"(?:\s*+(?:[(\[{{<]\s*+(?:{_DOT_WORDS}|\.)\s*+[)\]}}>]|(?<=\s)(?:{_DOT_WORDS})(?=\s))\s*+)"
_DOT_TOKEN = re.compile(_DOT, re.I)
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+-")
_HOST = _NAME - frozenset("_%+")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\s,.-]*$"), re.compile(r"[\s,.-]*[0-9]")
_PLUS_GAP = re.compile(r"\+[\s-]+$")
_MARK_BEFORE = re.compile(rf"(?:\+\s*|{_DOT})$", re.I)
_NUMBER_DOTS = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3}}", re.I)

#: Endings that make `name at host dot ending` an address (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io ai app dev co me tv us uk de fr es it nl be ch at eu pl pt se no fi dk ie ru cn jp in br au ca mx".split())

#: What before a name says that an address follows, and words before `at` that are no names (fixed values).
_CUE = re.compile(r"(?i)\b(?:e-?mails?|mail|contact|write|reach|address|correo|adresse)\b")
NOT_NAMES = frozenset("me us him her it them you out look see be is are was were available found hosted here there online visit page site team people and or not".split())

#: Without a match of these a text has no span: RE2 patterns, run over a batch.
PLAIN_SIGN = r"[@0-9]"
_S = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]"
_SEP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0},.-]"
DISGUISE_SIGN = (
    rf"(?i)[(\[{{<]{_S}*({_AT_WORDS}|{_DOT_WORDS}|\.){_S}*[)\]}}>]|{_S}({_DOT_WORDS}){_S}|{_S}({_AT_WORDS}){_S}+[a-z0-9-]+\.[a-z0-9-]"
    rf"|(^|[^A-Za-z]){_WORDS}{_SEP}+{_WORDS}([^A-Za-z]|$)|(\+|plus[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}-]){_SEP}*{_WORDS}|plus[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}-]*[0-9]|[0-9]{_SEP}*{_WORDS}{_SEP}*[0-9]"
    r"|[\x{0300}-\x{10ffff}\x{00ad}]"
)
#: All that homoglyphs() may rewrite: the sign above holds the same characters.
_REWRITABLE = re.compile("[\u0300-\U0010ffff\u00ad]")
_INVISIBLE = frozenset("​‌‍⁠­﻿")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and non-overlapping, read from each @ outwards."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def plain(text: str) -> list[Span]:
    """The spans of the base patterns; a match that fails its test is dropped and not tried again."""
    out = emails(text)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


class Rewritten:
    """Text under rewriting, with the source span of every character."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Ordered edits (start, end, new): each new character stands for the whole replaced span."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text, self.start, self.end = "".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:]


def homoglyphs(r: Rewritten) -> None:
    """Look-alikes, full-width and styled characters to ASCII, invisible ones away."""
    if r.text.isascii():
        return
    edits = []
    for m in _REWRITABLE.finditer(r.text):
        i, c = m.start(), m[0]
        if c in _INVISIBLE:
            edits.append((i, i + 1, ""))
        elif c in HOMOGLYPHS:
            edits.append((i, i + 1, HOMOGLYPHS[c]))
        else:
            new = unicodedata.normalize("NFKC", c) if not c.isdecimal() else str(unicodedata.decimal(c))
            if len(new) == 1 and new.isascii() and not new.isspace():
                edits.append((i, i + 1, new))
    if edits:
        r.replace(edits)


def spelled_digits(r: Rewritten) -> None:
    """Spelled digits to digits and `plus` before a number to +: runs of two or more, single ones beside a spelled dot or
    after a plus or between digits. A single word elsewhere is prose and stays; of all others, length, range and Luhn tests
    tell what is a number."""
    edits = []
    for m in _SPELLED.finditer(r.text):
        words = list(_DIGIT_WORD.finditer(r.text, m.start(), m.end()))
        at = m.start()
        p = _PLUS_WORD.match(r.text, at)
        if len(words) < 2 and not p:
            before, after = r.text[max(0, at - 12) : at], r.text[m.end() : m.end() + 12]
            if not (_MARK_BEFORE.search(before) or _DOT_TOKEN.match(after) or _DIGIT_BEFORE.search(before) and _DIGIT_AFTER.match(after)):
                continue
        if p:
            edits.append((at, p.end(), "+"))
            at = p.end()
        elif gap := _PLUS_GAP.search(r.text, max(0, at - 12), at):
            edits.append((gap.start() + 1, at, ""))
        for w in words:
            if at < w.start():
                edits.append((at, w.start(), ""))
            edits.append((w.start(), w.end(), _DIGIT_WORDS[w[0].lower()]))
            at = w.end()
    if edits:
        r.replace(edits)
    if edits := [(m.start(), m.end(), "+") for m in _PLUS_NUMBER.finditer(r.text)]:
        r.replace(edits)


def sign_tokens(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, sign, form) of what stands for @ or a dot, spaces around disguises included. form: `plain` (the sign
    itself), `bare` (a word between spaces) or `bracketed`."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b, sign, form = m.start(), m.end(), "@" if m["at"] else ".", "plain"
        if m["open"] and (close := _CLOSE.match(text, b)):
            b, form = close.end(), "bracketed"
        else:
            a = m.start("at" if m["at"] else "dot")
            spaced = a and b < len(text) and text[a - 1].isspace() and text[b].isspace()
            if spaced and text[a] != ".":
                form = "bare"
            elif text[a] not in "@.":
                continue
        if form != "plain":
            while a and text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
        out.append((a, b, sign, form))
    return out


def words_for_signs(r: Rewritten) -> None:
    """`at` and `dot` disguises to @ and . inside what reads as an address or as four numbers.

    An address is read outwards from each @. Bare words count only where a sign in the address is bracketed or it ends in a
    common top-level domain; a bare `at` before a plain host also needs a name that is no common word, with a digit or sign
    in it or an e-mail cue before it. All else is prose."""
    text = r.text
    tokens = sign_tokens(text)
    edits: set[tuple[int, int, str]] = set()
    dots_to = {t[1]: t for t in tokens if t[2] == "."}
    dots_from = {t[0]: t for t in tokens if t[2] == "."}
    floor = 0
    for at in tokens:
        if at[2] != "@":
            continue
        used, begin = [at], at[0]
        while True:
            a = begin
            while a > floor and text[a - 1] in _NAME:
                a -= 1
            if a == begin:
                break
            begin = a
            if not ((dot := dots_to.get(a)) and dot[0] > floor and text[dot[0] - 1] in _NAME):
                break
            used.append(dot)
            begin = dot[0]
        if begin == at[0]:
            continue
        end, atoms, last = at[1], 0, ""
        while True:
            b = end
            while b < len(text) and text[b] in _HOST:
                b += 1
            if b == end:
                break
            last, end, atoms = text[end:b], b, atoms + 1
            if not ((dot := dots_from.get(b)) and dot[1] < len(text) and text[dot[1]] in _HOST):
                break
            used.append(dot)
            end = dot[1]
        if atoms < 2:
            continue
        floor = end
        forms, name = {t[3] for t in used}, text[begin : at[0]]
        spelled = any(t[3] == "bare" and t[2] == "." for t in used)
        named = name.lower() not in NOT_NAMES and (not name.isalpha() or bool(_CUE.search(text[max(0, begin - 40) : begin])))
        if "bracketed" in forms or last.lower() in TOP_DOMAINS and (spelled or named):
            edits.update((a, b, sign) for a, b, sign, form in used if form != "plain")
    for m in _NUMBER_DOTS.finditer(text):
        edits.update((t.start(), t.end(), ".") for t in _DOT_TOKEN.finditer(text, m.start(), m.end()))
    if edits:
        r.replace(sorted(edits))


def disguised(text: str) -> list[Span]:
    """Spans of the rewritten text, in source characters."""
    r = Rewritten(text)
    for rewrite in (homoglyphs, spelled_digits, words_for_signs):
        rewrite(r)
    return [] if r.text == text else [(r.start[a], r.end[b - 1], k) for a, b, k in plain(r.text)]


def find(text: str, sign: bool = True, disguise: bool = True) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those of the rewritten text are added unless a base span of their kind holds them."""
    base = plain(text) if sign else []
    more = disguised(text) if disguise else []
    if more:
        own = [[s for s in base if s[2] == k] for k in range(len(KINDS))]
        starts = [[s[0] for s in spans] for spans in own]
        held = lambda s: (i := bisect.bisect_right(starts[s[2]], s[0])) and own[s[2]][i - 1][1] >= s[1]  # noqa: E731  spans of a kind don't overlap
        more = [s for s in more if not held(s)]
    return base, sorted({*base, *more}, key=lambda s: (s[0], s[2], s[1])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def signs(column: pa.Array) -> tuple[list[bool], list[bool]]:
    """For each text: may it have a plain span, may it have a disguised one."""
    return tuple(pc.fill_null(pc.match_substring_regex(column, p), False).to_pylist() for p in (PLAIN_SIGN, DISGUISE_SIGN))


_ROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """For each row of `docs`: doc_id, base spans by kind (n_email, n_ip, n_card, n_phone), base_sha256, spans (all), n_spans.

    Offsets are code points, ends exclusive. Null text counts as empty: no spans. Rows are independent, so null and
    repeated doc_ids are carried, other columns are not read, and a table without rows gives none.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch):
                column, rows = batch.column("text")[a:b], []
                for doc, text, plain_, hidden in zip(batch.column("doc_id")[a:b].to_pylist(), column, *signs(column), strict=True):
                    if not plain_ and not hidden:
                        rows.append((doc, 0, 0, 0, 0, nothing, "", 0))
                        continue
                    base, every = find(text.as_py(), plain_, hidden)
                    counts = [sum(s[2] == k for s in base) for k in range(4)]
                    rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
