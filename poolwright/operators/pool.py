"""Operators from pool to pool. A pool row has example_id, problem, gold_answer, answer_mode and the ordered array
`candidates`; all of these work inside the row unless they join another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.functions.answers import answers_match, extract_choice, extract_numeric, key, parse_answer, parse_status
from poolwright.functions.hygiene import instruction_leak, malformed_wrapper, normalize_candidate, rewrite_choice, scaffold_residue
from poolwright.functions.motif import motif, quality, source_bucket
from poolwright.functions.text import let, strip, token_count
from poolwright.operators.texts import with_array_facts, with_facts, with_made, with_match

_NONE = F.array


def tag_pool(pools: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One motif tag row for each candidate. `texts`: rows (problem, c) with all problems and candidates, if some are cheaper to
    make than pools."""
    # what a problem asks, what a text says and its answer are judged once for each distinct one
    texts = (pools.select("problem", F.explode("candidates").alias("c")) if texts is None else texts).withColumnRenamed("c", "candidate_text")
    asked = with_facts(pools.select("example_id", "problem", "gold_answer", "answer_mode", "candidates"), ["problem"], {"pm": motif(F.col("problem"), F.lit(""))}, texts)
    slots = asked.select("example_id", "problem", "gold_answer", "answer_mode", "pm", F.posexplode("candidates").alias("candidate_index", "candidate_text"))
    tagged = with_facts(slots, ["problem", "candidate_text"], {"m": motif(F.col("problem"), F.col("candidate_text")), "q": quality(F.col("candidate_text"))}, texts)
    return with_match(tagged, "candidate_is_correct", "candidate_text", texts).select(
        "example_id", "answer_mode", "candidate_index", "candidate_text", "candidate_is_correct",
        *[F.col(f"{s}.{f}").alias(f"{n}_{f}") for s, n in (("pm", "problem_motif"), ("m", "motif"), ("q", "quality")) for f in ("label", "confidence", "cues")],
    )


def normalize_pool(pools: DataFrame, style: str = "canonical_answerline") -> DataFrame:
    """`pools` with normalised candidates, and `actions`, what was done to each."""
    done = pools.withColumn("_n", F.transform("candidates", lambda c: normalize_candidate(c, F.col("answer_mode"), style)))
    return done.withColumns({"candidates": F.transform("_n", lambda x: x["text"]), "actions": F.transform("_n", lambda x: x["action"])}).drop("_n")


def normalize_slots(slots: DataFrame, style: str = "canonical_answerline", texts: DataFrame | None = None) -> DataFrame:
    """As normalize_pool() for rows (answer_mode, candidate): `candidate` anew, and `action`. Each distinct text is normalised once
    where these are few. `texts`: rows (answer_mode, candidate) with all of them, if some are cheaper to make."""
    done = with_made(slots, ["answer_mode", "candidate"], lambda d: d.withColumn("_n", normalize_candidate(F.col("candidate"), F.col("answer_mode"), style)), ["_n"], texts)
    return done.withColumns({"candidate": F.col("_n.text"), "action": F.col("_n.action")}).drop("_n")


def keep_first(rows: Column, k) -> Column:
    """Elements whose key no earlier element has."""
    return let(rows, lambda a: let(F.transform(a, k), lambda ks: F.filter(a, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1)))


def family_hygiene(pools: DataFrame, rewrite: str = "canonical_answerline", dedupe: str = "answer_token", texts: DataFrame | None = None) -> DataFrame:
    """Multiple-choice pools: candidates rewritten, those without an option dropped, one of each option kept; a pool left
    empty gets its first candidate back. Others stay. Adds dropped_invalid and dropped_duplicates. `texts`: rows (c) with all
    candidates, if some are cheaper to make."""
    pools = with_array_facts(pools, "candidates", [], lambda c: {"new": rewrite_choice(c, rewrite)}, texts, "_made")
    valid = F.filter(F.transform("_made", lambda x: x["new"]), lambda x: x["text"].isNotNull())
    k = (lambda x: x["token"]) if dedupe == "answer_token" else (lambda x: x["text"])
    done = pools.withColumn("_valid", valid).withColumn("_kept", F.transform(keep_first(F.col("_valid"), k), lambda x: x["text"]))
    first = F.filter(F.array(strip(F.get("candidates", F.lit(0)))), lambda x: F.coalesce(x != "", F.lit(False)))
    choice = F.col("answer_mode") == "choice_letter"
    return done.withColumns(
        {
            "dropped_invalid": F.when(choice, F.size("candidates") - F.size("_valid")).otherwise(0),
            "dropped_duplicates": F.when(choice, F.size("_valid") - F.size("_kept")).otherwise(0),
            "candidates": F.when(choice, F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(first)).otherwise(F.col("candidates")),
        }
    ).drop("_made", "_valid", "_kept")


def merge_anchor(base: DataFrame | int, anchor: DataFrame, aux: DataFrame, most: int = 8, protect: int = 1, insertions: int = 3, profile: str = "mode_aware", texts: DataFrame | None = None, keys: str | None = None) -> DataFrame:
    """Anchor pools enriched from aux pools.

    Aux candidates with keys of their own fill the anchor up to `most`; what is left of `insertions` then overwrites, from
    the last slot to the first unprotected one, slots whose key the base pool has, slots just filled among them. Pools are
    joined by example_id; the anchor's mode holds. Adds appended and replaced. `base` may be a number: the base pools are then the
    anchor's own first candidates, as many as that, and take no join. `texts`: rows (answer_mode, c) with all modes and
    candidates, if some are cheaper to make. `keys`: the column in which all pools hold the keys of their candidates under
    `profile` and the anchor's mode, if they have them already; nothing is taken apart by candidate then."""
    zipped = F.transform("candidates", lambda c, i: F.struct(c.alias("c"), F.get(keys, i).alias("k"))) if keys else None
    own = F.coalesce(zipped, F.array().cast("array<struct<c:string,k:string>>")) if keys else F.coalesce("candidates", F.array().cast("array<string>"))
    side = lambda d, n: d.select("example_id", own.alias(n))
    j = anchor.withColumn("_base", F.slice(own, 1, base)) if isinstance(base, int) else anchor.join(side(base, "_base"), "example_id")
    if keys:
        j = j.join(side(aux, "_x"), "example_id").withColumns({"_a": F.slice(zipped, 1, most), "_bk": F.transform("_base", lambda x: x["k"]), "candidates": F.slice("candidates", 1, most)})
    else:
        j = j.withColumn("candidates", F.slice("candidates", 1, most)).join(side(aux, "_aux"), "example_id")
        # candidates of all three pools take their key along; where each pool ends is told by sizes
        j = j.withColumn("_all", F.concat("candidates", "_base", "_aux"))
        j = with_array_facts(j, "_all", ["answer_mode"], lambda c: {"k": key(c, F.col("answer_mode"), profile)}, texts, "_keyed")
        part = lambda start, n: F.slice("_keyed", start + 1, n)
        j = j.withColumns({"_a": part(F.lit(0), F.size("candidates")), "_bk": F.transform(part(F.size("candidates"), F.size("_base")), lambda x: x["k"]), "_x": part(F.size("candidates") + F.size("_base"), F.size("_aux"))})
    held = F.transform("_a", lambda x: x["k"])
    j = j.withColumn("_new", keep_first(let(held, lambda h: F.filter("_x", lambda x: ~F.array_contains(h, x["k"]))), lambda x: x["k"]))
    j = j.withColumn("appended", F.least(F.lit(insertions), F.lit(most) - F.size("candidates"), F.size("_new")))
    j = j.withColumn("_m", F.concat("_a", F.slice("_new", F.lit(1), F.col("appended"))))
    slots = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_m") - 1, F.lit(0))), lambda i: (i >= protect) & F.coalesce(F.array_contains("_bk", F.get("_m", i)["k"]), F.lit(False)))
    j = j.withColumn("_slots", F.reverse(slots)).withColumn("_left", F.slice("_new", F.col("appended") + 1, F.greatest(F.lit(insertions) - F.col("appended"), F.lit(0))))
    put = lambda x, i: F.coalesce(F.get("_left", F.nullif(F.array_position("_slots", i), F.lit(0)).cast("int") - 1)["c"], x["c"])
    j = j.withColumns({"replaced": F.least(F.size("_slots"), F.size("_left")), "candidates": F.transform("_m", put)})
    return j.drop("_base", "_aux", "_all", "_keyed", "_a", "_bk", "_x", "_new", "_m", "_slots", "_left", *([keys] if keys else []))


# --- completion merge: which slots make room ---------------------------------------------------------------------------

_STRATIFIED = ("replace_stratified_risk_preserve", "replace_margin_stratified_risk_preserve", "replace_margin_salvage_no_risk", "replace_margin_stratified_numeric_preserve")
#: Removal order of each policy: slots go by rising values of these features (fixed values); words and slot come last.
POLICIES = {
    "replace_fragments_first": ("quality", "invalid", "leak", "scaffold", "motif"),
    "replace_partials_first": ("quality", "invalid", "leak", "scaffold", "motif"),
    "replace_invalid_first": ("invalid", "leak", "scaffold", "quality", "motif"),
    "replace_compatibility_risk_first": ("invalid", "leak", "scaffold", "wrapper", "quality", "motif"),
    "replace_hybrid_salvageability": ("invalid", "motif", "quality", "leak", "scaffold"),
    "replace_closure_score_first": ("closure", "invalid", "wrapper", "leak", "scaffold", "quality", "motif"),
    "replace_verifier_uncertainty_first": ("missing", "margin", "invalid", "leak", "scaffold", "quality", "motif"),
    "replace_margin_risk_hybrid": ("missing", "margin", "invalid", "leak", "scaffold", "wrapper", "motif", "quality"),
    "replace_margin_risk_no_salvage": ("missing", "margin", "risk", "invalid", "leak", "scaffold", "wrapper", "quality", "motif"),
    "replace_margin_salvage_no_risk": ("missing", "margin", "salvage", "quality", "motif"),
    "replace_stratified_risk_preserve": ("risk", "salvage", "quality", "motif", "support"),
    "replace_margin_stratified_risk_preserve": ("risk", "support", "salvage", "quality", "motif"),
    "replace_margin_stratified_numeric_preserve": ("risk", "support", "short", "salvage", "quality", "motif"),
    "replace_random_nonprefix": ("random",),
    "replace_random_fragment_only": ("not_fragment", "random"),
    "replace_random_partial_only": ("not_partial", "random"),
}


def slot_features(text: Column, index: Column, problem: Column, mode: Column, margin: Column, seed: int = 0, salt: Column | None = None, asked: Column | None = None, names: set[str] | None = None, facts: Column | None = None) -> Column:
    """What the policies read of a slot, each so that smaller goes first; `asked`: the problem's motif, if it is known already;
    `names`: the features that are read, all unless given; `facts`: the text's text_facts(), if they are known."""
    wanted = lambda *ns: _wanted(names, *ns)

    def of(s: Column) -> Column:
        flag = lambda c: c.cast("double")
        q, same, wrapped = s["q"], s["m"] == s["pm"], s["wrapped"]
        support = F.coalesce(margin, F.lit(0.0))
        rank = lambda a, b: F.when(q == a, 0.0).when(q == b, 1.0).when(q == "complete_attempt", 2.0).otherwise(1.0)
        risk = 4.0 * flag(s["invalid"]) + 3.0 * flag(s["leak"]) + 2.0 * flag(s["scaffold"]) + 1.5 * flag(~wrapped)
        salvage = F.when(q == "complete_attempt", 3.0).when(q == "partial_solution", 2.5).otherwise(1.5) + 0.75 * flag(same) + 0.5 * flag(wrapped) + 0.5 * F.greatest(support, F.lit(0.0))
        tokens = F.least(s["n"], F.lit(40)).cast("double")
        closure = 4 * flag(~s["invalid"]) + 2 * flag(wrapped) + F.least(tokens, F.lit(12.0)) / 12.0 - 2 * flag(s["leak"]) - 1.5 * flag(s["scaffold"])
        short = (mode == "numeric") & (tokens <= 6) & ~s["leak"] & s["number"]
        values = {
            "quality": rank("fragment", "partial_solution"), "partials": rank("partial_solution", "fragment"), "invalid": flag(~s["invalid"]), "leak": flag(~s["leak"]), "scaffold": flag(~s["scaffold"]),
            "wrapper": flag(wrapped), "motif": flag(same), "closure": closure, "missing": flag(margin.isNull()), "margin": F.coalesce(margin, F.lit(1e9)), "risk": -risk, "salvage": salvage, "support": support,
            "short": flag(short), "tokens": tokens, "not_fragment": flag(q != "fragment"), "not_partial": flag(q != "partial_solution"),
            "random": F.pmod(F.xxhash64(F.lit(seed), salt if salt is not None else text, index), F.lit(1 << 40)).cast("double"),
        }
        return F.struct(index.alias("index"), text.alias("text"), q.alias("q"), *[v.cast("double").alias(n) for n, v in values.items() if wanted(n)])

    known = text_facts(text, problem, mode, names)
    pm = motif(problem, F.lit(""))["label"] if asked is None else asked
    return let(F.struct(*[(v if facts is None else facts[n]).alias(n) for n, v in known.items()], pm.alias("pm")), of)


def _wanted(names: set[str] | None, *some: str) -> bool:
    return names is None or not names.isdisjoint(some)


def text_facts(text: Column, problem: Column, mode: Column, names: set[str] | None = None) -> dict[str, Column]:
    """What slot_features() reads of a text alone, beside its problem and mode; facts that the features `names` don't need are left out."""
    judged, by_motif, short = _wanted(names, "invalid", "leak", "scaffold", "risk", "closure", "short"), _wanted(names, "motif", "salvage"), _wanted(names, "short")
    no = F.lit(False)
    return {
        "invalid": parse_answer(text, mode).isNull() if judged else no, "leak": instruction_leak(text) if judged else no, "scaffold": scaffold_residue(text) if judged else no, "q": quality(text)["label"],
        "m": motif(problem, text)["label"] if by_motif else F.lit(""), "n": token_count(text), "wrapped": F.contains(F.lower(text), F.lit("final answer:")), "number": extract_numeric(text).isNotNull() if short else no,
    }


def _read(policy: str) -> set[str]:
    """The features that a policy reads, its protected slots included."""
    found = {"partials" if n == "quality" and policy == "replace_partials_first" else n for n in POLICIES[policy]} | {"tokens"}
    if policy in _STRATIFIED:
        found |= {"salvage", "closure", "motif", "support", "wrapper", "short"}
    return found


def _protected(slots: Column, policy: str) -> Column:
    """Slots that a stratified policy keeps: the best of each quality, and with the numeric one the best short number."""
    order = lambda x, names: F.struct(*[(x[n] if not n.startswith("-") else -x[n[1:]]).alias(f"o{i}") for i, n in enumerate(names)])
    best = lambda rows, names: F.array_max(F.transform(rows, lambda x: F.struct(order(x, names).alias("o"), x["index"].alias("i"))))["i"]
    strata = ("partial_solution", "fragment") + (("complete_attempt",) if policy.endswith("numeric_preserve") else ())
    of = lambda q: F.filter(slots, lambda x: x["q"] == q)
    kept = [best(of(q), ("salvage", "closure", "motif", "support", "-index")) for q in strata]
    if policy.endswith("numeric_preserve"):
        kept.append(best(F.filter(slots, lambda x: x["short"] == 1), ("support", "closure", "wrapper", "salvage", "motif", "-tokens", "-index")))
    return F.array_compact(F.array(*kept))


def removal_order(slots: Column, policy: str, protected: Column | None = None) -> Column:
    """Slot features in the order in which a policy gives slots up; `protected`: indices a stratified policy keeps."""
    names = ["partials" if n == "quality" and policy == "replace_partials_first" else n for n in POLICIES[policy]]
    keyed = lambda rows: F.transform(F.array_sort(F.transform(rows, lambda x: F.struct(F.struct(*[x[n].alias(f"o{i}") for i, n in enumerate(names)], x["tokens"].alias("t"), (-x["index"]).alias("i")).alias("o"), x.alias("x")))), lambda y: y["x"])
    if protected is None:
        return keyed(slots)
    free = F.filter(slots, lambda x: ~F.array_contains(protected, x["index"]))
    return keyed(F.when(F.size(free) > 0, free).otherwise(slots))


def merge_completion(pools: DataFrame, policy: str, new: str = "completions", most: int = 8, protect: int = 1, seed: int = 0, texts: DataFrame | None = None) -> DataFrame:
    """Pools with their `completions` merged in: appended while there is room, else put in place of slots that the policy
    gives up, behind the ones that stay. Adds removed (slot indices) and added. Needs `margins` (may be null). `texts`: rows
    (problem, answer_mode, c) with all candidates, if some are cheaper to make than pools."""
    old = F.slice("candidates", 1, most)
    rows = pools.withColumn("_old", old).withColumn("_new", F.coalesce(new, F.array().cast("array<string>")))
    room = (F.size("_old") < most) if policy != "append_if_room" else F.lit(True)
    if policy == "append_if_room":
        gone = F.array().cast("array<int>")
    else:
        # the first `protect` slots are never given up, and where there is room none is: their features are not asked for
        names = _read(policy)
        full = F.when(~room & (F.size("_new") > 0), F.slice("_old", protect + 1, most))
        rows = rows.withColumn("_risk", F.coalesce(full, F.array().cast("array<string>")))
        keys = ["problem", "answer_mode"]
        if names & {"motif", "salvage"}:
            rows = with_facts(rows, ["problem"], {"_asked": motif(F.col("problem"), F.lit(""))["label"]}, texts)
        else:
            rows, keys = rows.withColumn("_asked", F.lit("")), ["answer_mode"]
        rows = with_array_facts(rows, "_risk", keys, lambda c: text_facts(c, F.col("problem"), F.col("answer_mode"), names), texts, "_known")
        rows = rows.withColumn("_feats", F.transform("_known", lambda x, i: slot_features(x["c"], i + protect, F.col("problem"), F.col("answer_mode"), F.get("margins", i + protect), seed, F.col("example_id"), F.col("_asked"), names, x)))
        if policy in _STRATIFIED:
            rows = rows.withColumn("_kept", _protected(F.col("_feats"), policy))
        order = removal_order(F.col("_feats"), policy, F.col("_kept") if policy in _STRATIFIED else None)
        gone = F.transform(F.slice(order, F.lit(1), F.size("_new")), lambda x: x["index"])
    rows = rows.withColumn("removed", F.when(room | (F.size("_new") == 0), F.array().cast("array<int>")).otherwise(gone))
    taken = F.when(room, F.least(F.size("_new"), F.greatest(F.lit(most) - F.size("_old"), F.lit(0)))).otherwise(F.size("removed"))
    rows = rows.withColumn("added", taken)
    merged = F.concat(F.filter("_old", lambda c, i: ~F.array_contains("removed", i)), F.slice("_new", F.lit(1), F.col("added")))
    return rows.withColumn("candidates", merged).drop("_old", "_new", "_risk", "_asked", "_known", "_feats", "_kept")


def replace_slots(pools: DataFrame, replacements: DataFrame) -> DataFrame:
    """Pools with the candidates of (example_id, slot, text) put in; slots beyond the pool are left out."""
    per = replacements.groupBy("example_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "text"))).alias("_r"))
    return pools.join(per, "example_id", "left").withColumn("candidates", F.transform("candidates", lambda c, i: F.coalesce(F.try_element_at("_r", i), c))).drop("_r")


def refused(text: Column, mode: Column, max_words: int = 120) -> Column:
    """Whether a repair is empty, leaks, is scaffolded or doubled, has no answer or too many words."""
    return (strip(text) == "") | instruction_leak(text) | scaffold_residue(text) | malformed_wrapper(text) | parse_answer(text, mode).isNull() | (token_count(text) > max_words)


def revert_repairs(source: DataFrame, repaired: DataFrame, max_words: int = 120) -> DataFrame:
    """Repaired pools in which every slot whose repair is empty, leaks, is scaffolded or doubled, has no answer or too many
    words is its source again. Adds reverted and accepted."""
    j = repaired.join(source.select("example_id", F.col("candidates").alias("_src")), "example_id")
    bad = lambda t: refused(t, F.col("answer_mode"), max_words)
    zipped = F.zip_with("_src", "candidates", lambda s, r: F.struct(s.alias("s"), r.alias("r"), (~s.eqNullSafe(r) & (r.isNull() | bad(F.coalesce(r, F.lit(""))))).alias("back")))
    j = j.withColumn("_z", zipped)
    changed = lambda x: ~x["s"].eqNullSafe(x["r"])
    return j.withColumns(
        {"candidates": F.transform("_z", lambda x: F.when(x["back"], x["s"]).otherwise(x["r"])), "reverted": F.size(F.filter("_z", lambda x: x["back"])), "accepted": F.size(F.filter("_z", lambda x: changed(x) & ~x["back"]))}
    ).drop("_z", "_src")


def matched_fresh(pools: DataFrame, fresh: DataFrame, slots: DataFrame, most: int = 8) -> DataFrame:
    """Pools whose repaired slots (example_id, slot) get fresh candidates instead, in order, each used once; one whose key
    the rest of the pool already has is passed over. A fold over the slots of one capped pool. Adds applied, missing."""
    per = slots.groupBy("example_id").agg(F.array_sort(F.collect_list("slot")).alias("_slots"))
    j = pools.join(per, "example_id", "left").join(fresh.select("example_id", F.col("candidates").alias("_f")), "example_id", "left")
    k = lambda c: key(c, F.col("answer_mode"), "letter_then_number")
    old = F.slice(F.concat("candidates", F.array_repeat(F.lit(""), most)), 1, most)
    none = F.array().cast("array<string>")
    j = j.withColumns({"_c": old, "_f": F.filter(F.transform(F.coalesce("_f", none), strip), lambda x: x != ""), "_slots": F.filter(F.coalesce("_slots", F.array().cast("array<int>")), lambda s: s < most)})
    # every text gets its key once, before the fold, and takes it along; a blank one holds no key
    keyed = lambda c: F.struct(c.alias("c"), F.when(strip(c) != "", k(c)).alias("k"))
    j = j.withColumns({"_c": F.transform("_c", keyed), "_f": F.transform("_f", keyed)})

    def step(a: Column, slot: Column) -> Column:
        held = F.transform(F.filter(a["c"], lambda c, i: (i != slot) & c["k"].isNotNull()), lambda c: c["k"])
        fresh = F.sequence(F.lit(0), F.greatest(F.size("_f") - 1, F.lit(0)))
        at = let(held, lambda h: F.get(F.filter(fresh, lambda i: (i >= a["at"]) & (i < F.size("_f")) & ~F.array_contains(h, F.coalesce(F.get("_f", i)["k"], F.lit("")))), 0))
        return let(
            at,
            lambda spot: F.struct(
                F.when(spot.isNull(), a["c"]).otherwise(F.transform(a["c"], lambda c, i: F.when(i == slot, F.get("_f", spot)).otherwise(c))).alias("c"),
                F.coalesce(spot + 1, F.size("_f")).alias("at"),
                (a["applied"] + F.when(spot.isNull(), 0).otherwise(1)).alias("applied"),
            ),
        )

    start = F.struct(F.col("_c").alias("c"), F.lit(0).alias("at"), F.lit(0).alias("applied"))
    j = j.withColumn("_o", F.aggregate("_slots", start, step))
    return j.withColumns({"candidates": F.transform("_o.c", lambda x: x["c"]), "applied": F.col("_o.applied"), "missing": F.size("_slots") - F.col("_o.applied")}).drop("_c", "_f", "_slots", "_o")


def provenance_events(before: DataFrame, after: DataFrame, selected: DataFrame) -> DataFrame:
    """One event for each slot of two versions of a pool: parse states, correctness, bucket, and whether the verifier chose
    it (selected: example_id, selected_slot)."""
    zipped = before.join(after.select("example_id", F.col("candidates").alias("_after")), "example_id").select("example_id", "gold_answer", "answer_mode", F.posexplode(F.arrays_zip("candidates", "_after")).alias("source_slot_id", "z"))
    rows = zipped.select("example_id", "gold_answer", "answer_mode", "source_slot_id", F.coalesce("z.candidates", F.lit("")).alias("b"), F.coalesce("z._after", F.lit("")).alias("a")).join(selected, "example_id", "left")
    m, gold = F.col("answer_mode"), F.col("gold_answer")
    parsed = lambda t: F.startswith(parse_status(t, m), F.lit("parseable"))
    chosen = F.coalesce(F.col("selected_slot") == F.col("source_slot_id"), F.lit(False))
    return rows.select(
        "example_id", F.concat_ws(":", "example_id", "source_slot_id").alias("candidate_id"), "source_slot_id", source_bucket(F.col("b"), m).alias("source_bucket"),
        parsed(F.col("b")).alias("before_parseable"), parsed(F.col("a")).alias("after_parseable"), answers_match(F.col("b"), gold, m).alias("before_correct"), answers_match(F.col("a"), gold, m).alias("after_correct"),
        chosen.alias("selected_by_verifier"), (chosen & answers_match(F.col("a"), gold, m)).alias("selected_correct"), (F.col("a") != F.col("b")).alias("repair_applied"),
        parse_status(F.col("b"), m).alias("parser_status_before"), parse_status(F.col("a"), m).alias("parser_status_after"), token_count(F.col("b")).alias("token_count_before"), token_count(F.col("a")).alias("token_count_after"),
    )


def variant_allocation(samples: Column, variants: list[str]) -> Column:
    """array<struct(variant, n)>: samples dealt to prompt variants as evenly as can be, earlier variants first; those that get
    none are left out."""
    k = len(variants)
    each, more = F.floor(samples / k), F.pmod(samples, F.lit(k))
    shares = F.array(*[F.struct(F.lit(v).alias("variant"), (each + (more > i).cast("int")).cast("long").alias("n")) for i, v in enumerate(variants)])
    return F.filter(shares, lambda x: x["n"] > 0)


#: Names under which an object may hold a candidate's text, in the order in which they are tried (fixed values).
TEXT_FIELDS = ("candidate", "candidate_text", "text", "prediction", "response", "answer")


def coerce_candidate(item: Column) -> Column:
    """Text of a candidate that is a VARIANT: a string, or an object with a text that isn't blank under one of the usual names,
    or its `content` whatever that is; else the item as JSON."""

    def said(name: str) -> Column:
        value = F.try_variant_get(item, f"$.{name}", "variant")
        text = F.try_variant_get(item, f"$.{name}", "string")
        return F.when((F.schema_of_variant(value) == "STRING") & (strip(text) != ""), text)

    whole = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
    return F.coalesce(whole, *map(said, TEXT_FIELDS), F.try_variant_get(item, "$.content", "string"), F.try_variant_get(item, "$", "string"), F.lit(""))


def choice_letters(pools: DataFrame) -> DataFrame:
    """(example_id, letters): the distinct options a pool names, sorted."""
    return pools.select("example_id", F.array_sort(F.array_distinct(F.array_compact(F.transform("candidates", extract_choice)))).alias("letters"))
