"""The gate of the transducers gives what no gate gives; numbers spelled in part."""

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from poolwright.llm import pii


def both(text):
    sign, hidden = pii.signs(pa.array([text]))
    return pii.find(text, sign[0], hidden[0])


def styled(text, base):
    return "".join(chr(base + ord(c) - 97) if "a" <= c <= "z" else c for c in text)


@pytest.mark.parametrize(
    "text, kind",
    [
        (styled("alice", 0x1D41A) + "@" + styled("example", 0x1D41A) + ".com", "email"), (styled("bob", 0x24D0) + "@site.org", "email"), ("bob﹫site.org", "email"),
        ("".join(chr(0x6F0 + int(c)) for c in "4111111111111111"), "card"), ("+" + "".join(chr(0x966 + int(c)) for c in "447700900123"), "phone"), ("".join(chr(0x1D7CE + int(c)) for c in "4111111111111111"), "card"),
    ],
)
def test_characters_outside_the_list(text, kind):
    every = both("see " + text + " now")[1]
    assert kind in {pii.KINDS[k] for _, _, k in every} and both("see " + text + " now") == pii.find("see " + text + " now")


def test_gate_changes_nothing():
    r = random.Random(1)
    parts = ["one", "Two", "zero", "plus", "+", "4", "192", ".", " dot ", "(at)", "at", " ", " ", ", ", "-", "@", "site", "com", "۴", "①", "­", "﹫", chr(0x1D41A), "é", "[dot]", "seven "]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 16)))
        assert both(text) == pii.find(text), text


def test_spelled_in_part():
    cases = {
        "host one nine two dot one six eight dot zero dot one is": "one nine two dot one six eight dot zero dot one",
        "ring +44 seven seven zero zero 900123 now": "+44 seven seven zero zero 900123",
        "ring plus four four 7700 900123 now": "plus four four 7700 900123",
        "at 192 dot one six eight (dot) 0 dot 1 ok": "192 dot one six eight (dot) 0 dot 1",
    }
    for text, want in cases.items():
        assert [text[a:b] for a, b, _ in both(text)[1]] == [want], text
    for text in ("one dot on the map, two dots", "+1 202 555 0100", "in 2019 one of two went", "meet me at example.com", "three dot four"):
        base, every = both(text)
        assert base == every, text
    text = "call +1 202 555 0100 one more time"
    assert [text[a:b] for a, b, _ in both(text)[1]] == ["+1 202 555 0100"]


@pytest.mark.parametrize("text", ["a" * 10**6 + " [dot] ", "1" * 10**6 + " dot ", "x" + " " * 10**6 + " [dot] ", "a." * 500_000 + "@", "–" + "0123456789abcdef" * 62_500 + " anecdote", "( " * 500_000 + "[at] ", "one " * 250_000, "1 dot " * 160_000])
def test_linear_time(text):
    began = time.process_time()
    both(text)
    assert time.process_time() - began < 6


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def contract(text):
    """The base patterns as they are written down, one finditer each."""
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    found += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_are_the_contract_s(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "@", "@x.org", ".", "1", "22", "255", "256", "4111111111111111", " ", "-", "+", "+44 20 7946 0018", "(0)", "192.168.0.1", "é", "\n", "٣", "_", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4000)] + [None, ""]
    got = {x.doc_id: x for x in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = contract(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(got[i].spans.split(",")), t
        assert got[i].n_spans == len([x for x in got[i].spans.split(",") if x])
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [want.count(k + ":") for k in pii.KINDS], t


def test_recall_of_planted_disguises():
    r = random.Random(9)
    words = "the of and house river le la maison der die und casa perro con one for two of us".split()
    digits = [["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"][k].split() for k in range(4)]
    said = lambda n, own: " ".join(own[int(c)] for c in n)
    pick = lambda *a: r.choice(a)
    found = total = 0
    for i in range(2000):
        own, user, host = digits[i % 4], "".join(r.choices("abcdefghij", k=6)) + str(i), "".join(r.choices("klmnop", k=5))
        kind, text = [
            (0, f"{user}{pick(' at ', ' (at) ', '[at]', ' AT ')}{host}{pick(' dot ', ' (dot) ', '[.]')}{pick('com', 'org', 'de')}"),
            (0, f"{user} at {host}.com"),
            (0, "".join({"a": "а", "e": "е", "o": "ο", "c": "с"}.get(c, c) for c in f"{user}@{host}.com")),
            (3, pick("plus ", "+") + said("".join(r.choices("0123456789", k=11)), own)),
            (3, "+" + "".join(pick(c, f" {own[int(c)]} ") for c in "".join(r.choices("123456789", k=11)))),
            (1, " dot ".join(said(str(r.randint(0, 255)), own) for _ in range(4))),
            (2, said("4111111111111111", own)),
        ][i % 7]
        before, after = (" ".join(r.choices(words[:15], k=5)) for _ in range(2))
        whole = f"{before}, {text}. {after}"
        a = len(before) + 2
        total += 1
        found += any(k == kind and s <= a + 1 and e >= a + len(text) - 1 for s, e, k in both(whole)[1])
    assert found >= 0.9 * total, found / total
    for text in ("available at example.com", "look at site.org for more", "one two three and four", "at one dot in ten", "un deux trois soleil", "she is at home. com two"):
        assert not both(text)[1], text
