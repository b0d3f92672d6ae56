"""Selector rules: one candidate of each pool. A rule's name carries its parameters, as in clean_dup_firstclose_0.5_0.25_0.1.

A pool row has `candidates` (texts by slot) and `margins`; `scored` turns it into an array of structs and every rule is an
expression over that array, so rules add no shuffle to whatever made the pools.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.functions.answers import extract_numeric_tail, key, parse_answer
from poolwright.functions.hygiene import instruction_leak, malformed, scaffold_residue
from poolwright.functions.text import let
from poolwright.operators.texts import with_array_facts

_LOW = float("-inf")


@dataclass(frozen=True)
class Rule:
    family: str
    clean_penalty: float = 0.0
    duplicate_penalty: float = 0.0
    close_gap: float = 0.0


def parse_rule(name: str) -> Rule:
    """The parameters in a rule's name."""
    parts = name.split("_")
    if name in ("baseline_top_margin", "parseable_then_margin"):
        return Rule(name)
    if name.startswith("first_if_close_"):
        return Rule("first_if_close", close_gap=float(parts[-1]))
    if name.startswith("clean_dup_firstclose_"):
        return Rule("clean_dup_firstclose", *map(float, parts[3:6]))
    if name.startswith("clean_dup_"):
        return Rule("clean_dup", *map(float, parts[2:4]))
    raise ValueError(f"no such rule: {name}")


def scored(pools: DataFrame, candidates: str = "candidates", margins: str = "margins", mode: str = "answer_mode", validity: str = "loose", facts: str = "all", texts: DataFrame | None = None) -> DataFrame:
    """`pools` with `scored`: the candidates by falling margin (null last, then slot) with what the rules read: `all`, no
    more than what `parsed` answers tell, or nothing but `margins`. Texts are read once for each distinct one; `texts`: rows (mode, c)
    with all candidates, if some are cheaper to make than pools."""
    raw = F.array_sort(F.transform(candidates, lambda c, i: F.struct((-F.coalesce(F.get(margins, i), F.lit(_LOW))).alias("o"), i.alias("index"), c.alias("answer"), F.get(margins, i).alias("margin"))))

    def place(s: Column, rank: Column) -> list[Column]:
        return [s["index"].alias("index"), rank.alias("rank"), s["answer"].alias("answer"), s["margin"].alias("margin"), F.coalesce(s["margin"], F.lit(_LOW)).alias("sort_margin")]

    if facts == "margins":
        return pools.withColumn("_raw", raw).withColumn("scored", F.transform("_raw", lambda s, rank: F.struct(*place(s, rank)))).drop("_raw")

    def judged(text: Column) -> dict[str, Column]:
        m = F.col(mode)
        parsed = {"parsed": parse_answer(text, m, validity)}
        if facts != "all":
            return parsed
        return parsed | {"leak": instruction_leak(text), "scaffold": scaffold_residue(text), "malformed": malformed(text, m, validity), "tail_valid": (m == "numeric") & extract_numeric_tail(text).isNotNull(), "key": key(text, m, "parsed")}

    pools = with_array_facts(pools.withColumn("_raw", raw).withColumn("_texts", F.transform("_raw", lambda s: s["answer"])), "_texts", [mode], judged, texts)
    fact = lambda rank: F.get("_facts", rank)

    if facts != "all":
        parsed_only = lambda s, rank: let(fact(rank)["parsed"], lambda p: F.struct(*place(s, rank), p.alias("parsed"), p.isNull().alias("invalid")))
        return pools.withColumn("scored", F.transform("_raw", parsed_only)).drop("_raw", "_texts", "_facts")

    def enrich(s: Column, rank: Column) -> Column:
        return let(
            fact(rank),
            lambda f: F.struct(
                *place(s, rank),
                f["parsed"].alias("parsed"),
                f["parsed"].isNull().alias("invalid"),
                f["leak"].alias("leak"),
                f["scaffold"].alias("scaffold"),
                f["malformed"].alias("malformed"),
                (f["parsed"].isNull().cast("int") + f["leak"].cast("int") + f["scaffold"].cast("int") + f["malformed"].cast("int")).alias("dirty"),
                f["tail_valid"].alias("tail_valid"),
                f["key"].alias("key"),
            ),
        )

    out = pools.withColumn("_s", F.transform("_raw", enrich))
    earlier = lambda s: F.size(F.filter("_s", lambda x: (x["key"] == s["key"]) & ((x["index"] < s["index"]) | ((x["index"] == s["index"]) & (x["rank"] < s["rank"])))))
    with_dups = F.transform("_s", lambda s: s.withField("dup_rank", earlier(s)).withField("group_size", F.size(F.filter("_s", lambda x: x["key"] == s["key"]))))
    return out.withColumn("scored", with_dups).drop("_raw", "_texts", "_facts", "_s")


def _best(array: Column, order) -> Column:
    """The element of largest order struct; array_max compares structs field by field."""
    return F.array_max(F.transform(array, lambda s: F.struct(order(s).alias("o"), s.alias("s"))))["s"]


def _margin_order(s: Column) -> Column:
    return F.struct(s["sort_margin"].alias("m"), (-s["rank"]).alias("r"))


def top_margin(array: Column) -> Column:
    return _best(array, _margin_order)


def first_generated(array: Column) -> Column:
    return _best(array, lambda s: F.struct((-s["index"]).alias("i"), (-s["rank"]).alias("r")))


def parseable_then_margin(array: Column) -> Column:
    return F.coalesce(top_margin(F.filter(array, lambda s: ~s["invalid"])), top_margin(array))


def first_if_close(array: Column, gap: float) -> Column:
    """The first candidate if it parses and no more than `gap` below the top; two missing margins are never close."""
    both = F.struct(top_margin(array).alias("t"), first_generated(array).alias("f"))
    near = lambda b: b["f"]["margin"].isNotNull() & ((b["t"]["sort_margin"] - b["f"]["sort_margin"]) <= gap)
    return let(both, lambda b: F.when(~b["f"]["invalid"] & near(b), b["f"]).otherwise(b["t"]))


def adjusted(array: Column, clean_penalty: float, duplicate_penalty: float, units: str = "original_rank") -> Column:
    """The scored array with `adjusted`: margin less penalties for dirt and duplicates (by rank or by group)."""
    dups = lambda s: s["dup_rank"] if units == "original_rank" else F.greatest(F.lit(0), s["group_size"] - 1)
    return F.transform(array, lambda s: s.withField("adjusted", s["sort_margin"] - clean_penalty * s["dirty"] - duplicate_penalty * dups(s)))


def clean_dup(array: Column, legacy: bool = False) -> Column:
    """The best of an adjusted array; the legacy rule breaks ties towards small groups before margins."""
    if legacy:
        return _best(array, lambda s: F.struct(s["adjusted"].alias("a"), (-s["group_size"]).alias("g"), s["sort_margin"].alias("m"), (-s["rank"]).alias("r")))
    return _best(array, lambda s: F.struct(s["adjusted"].alias("a"), s["sort_margin"].alias("m"), (-s["rank"]).alias("r")))


def clean_dup_firstclose(array: Column, gap: float, legacy: bool = False) -> Column:
    def of(b: Column) -> Column:
        clean = b["f"]["dirty"] == 0
        if legacy:
            answerlike = b["f"]["tail_valid"] & ~b["f"]["leak"] & ~b["f"]["scaffold"] & ~b["f"]["malformed"]
            clean = F.when(b["t"]["tail_valid"], answerlike).otherwise(clean)
        near = (b["f"]["adjusted"] > F.lit(_LOW)) & ((b["t"]["adjusted"] - b["f"]["adjusted"]) <= gap)
        return F.when(clean & near, b["f"]).otherwise(b["t"])

    return let(F.struct(clean_dup(array, legacy).alias("t"), first_generated(array).alias("f")), of)


def rule_column(name: str, array: Column | None = None, legacy: bool = False, units: str = "original_rank", gap: float | None = None) -> Column:
    """The candidate that a rule selects of `scored`."""
    rule, array = parse_rule(name), F.col("scored") if array is None else array
    if legacy:
        units, gap = "answer_group", 0.5 if gap is None else gap
    close = rule.close_gap if gap is None else gap
    if rule.family == "baseline_top_margin":
        return top_margin(array)
    if rule.family == "parseable_then_margin":
        return parseable_then_margin(array)
    if rule.family == "first_if_close":
        return first_if_close(array, close)
    weighed = adjusted(array, rule.clean_penalty, rule.duplicate_penalty, units)
    return let(weighed, lambda a: clean_dup(a, legacy) if rule.family == "clean_dup" else clean_dup_firstclose(a, close, legacy))


def baseline_selected(array: Column, prediction: Column) -> Column:
    """The logged winner: the best margin among candidates with that text, else the top margin."""
    return F.coalesce(top_margin(F.filter(array, lambda s: s["answer"] == prediction)), top_margin(array))


def select(pools: DataFrame, rule: str, validity: str = "loose", legacy: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """`pools` with `selected` (struct) under a rule; pools without candidates drop out. `texts`: as for scored()."""
    facts = {"baseline_top_margin": "margins", "parseable_then_margin": "parsed", "first_if_close": "parsed"}.get(parse_rule(rule).family, "all")
    return scored(pools.where(F.size("candidates") > 0), validity=validity, facts=facts, texts=texts).withColumn("selected", rule_column(rule, legacy=legacy))
