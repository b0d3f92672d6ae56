"""Reports: each gathers one-row aggregates into a dict, and renders Markdown on the driver. Rows of a report are bounded by
its groups, never by the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.functions.labels import classify_delta, competitive_tag, risk_bucket, severity
from poolwright.functions.stats import ovf_decomposition, paired_counts, paired_rates, resampled
from poolwright.operators import metrics as M
from poolwright.operators import ordered as O
from poolwright.operators import records as R
from poolwright.operators import select as S
from poolwright.operators.joins import pool_diff, slot_pairs
from poolwright.sources.files import one_row, write_atomic, write_json

#: Rows of a table that a report shows or keeps; a table beyond it is written as a DataFrame instead.
MOST_ROWS = 1000


def table(rows: DataFrame, *order: str) -> list[dict]:
    """A small ordered table; a larger one than MOST_ROWS is an error, not cut short."""
    found = (rows.orderBy(*order) if order else rows).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError("too many rows for a report; write the DataFrame")
    return [r.asDict(recursive=True) for r in found]


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)"
    cell = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    names = list(rows[0])
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])


def markdown(title: str, report: dict) -> str:
    out = [f"# {title}", ""]
    for name, part in report.items():
        rows = part if isinstance(part, list) else [part] if isinstance(part, dict) else [{"value": part}]
        out += [f"## {name.replace('_', ' ')}", "", markdown_table(rows), ""]
    return "\n".join(out)


def write(report: dict, title: str, json_path: str, markdown_path: str | None = None) -> None:
    write_json(json_path, report)
    if markdown_path:
        write_atomic(markdown_path, markdown(title, report))


def generate_then_rerank(slots: DataFrame, samples: int = 3) -> dict:
    """The flagship report: coverage, efficiency, failures, patterns, sizes, hygiene, paired test, examples. The counted sections
    come from one scan (M.sections), the paired test and the interval from its counts; `slots` is read once, for the
    per-example facts are kept for the examples."""
    f = M.flags(slots).cache()
    found = table(M.sections(f))
    all_ = next((r for r in found if r["section"] == "all"), None) or one_row(M.totals(f))
    s, n, right, pair = all_["summary"], all_["sizes"]["n"], all_["right"], all_["paired"]
    counts = slots.sparkSession.createDataFrame([pair | {"up": pair["b_only"], "down": pair["a_only"]}], "n long, a_only long, b_only long, both long, neither long, up long, down long")
    sizes = sorted((r for r in found if r["section"] == "pool_size"), key=lambda r: r["n_candidates"])
    patterns = sorted((r for r in found if r["section"] == "pattern" and r["pattern"] is not None), key=lambda r: r["pattern"])
    kind = F.when(~F.col("oracle"), "oracle_miss").when(~F.col("verifier_ok"), "selection_failure").otherwise("solved")
    examples = O.bucket_sample(f.withColumn("bucket", kind), "bucket", samples, F.length("problem"))
    out = {
        "summary": s, "failures": all_["failures"], "efficiency": [{"selector": k, "correct": c, "oracle_correct": s["oracle_correct"], "efficiency": s[f"{k}_given_oracle"]} for k, c in right.items()], "rescues": all_["rescues"], "patterns": [{"pattern": r["pattern"], "n": r["sizes"]["n"]} for r in patterns],
        "by_pool_size": [{"n_candidates": r["n_candidates"]} | r["sizes"] | {"share": r["sizes"]["n"] / n} for r in sizes], "selected_hygiene": all_["hygiene"], "paired": one_row(paired_rates(counts.drop("up", "down"))), "interval": one_row(resampled(counts)),
        "examples": table(R.serialize_example(examples).join(examples.select("example_id", "bucket"), "example_id"), "bucket", "example_id"),
    }
    f.unpersist()
    return out


def candidate_budget(slots: DataFrame, most: int = 16) -> dict:
    f = M.flags(slots)
    return {"curve": table(O.budget_curve(slots, most), "k"), "first_correct": table(M.histogram(f, "first_correct_position"), "bucket"), "duplication": table(M.numeric_duplication(slots), "unique_answers")}


def motif_audit(tags: DataFrame, shown: int = 20) -> dict:
    return {"coverage": table(M.motif_coverage(tags), "oracle"), "labels": table(M.label_histogram(tags), "kind", "label"), "missing": table(R.missing_motif(tags).limit(shown))}


def eval_report(predictions: DataFrame) -> dict:
    return {"exact_match": one_row(M.exact_match(predictions))}


def conversion_diagnosis(first: DataFrame, second: DataFrame) -> dict:
    return {"buckets": table(M.transition(M.flags(first), M.flags(second)), "bucket")}


def salvage_attribution(events: DataFrame) -> dict:
    return {"by_bucket": table(M.conversion_by_bucket(events), "source_bucket"), "final_source": table(M.final_source(events), "source")}


def retarget_diagnosis(pools: dict[str, DataFrame], slots: dict[str, DataFrame], base: str) -> dict:
    """Several versions of a pool against a base one."""
    f = {k: M.flags(s) for k, s in slots.items()}
    diffs = [{"pool": k} | one_row(pool_diff(slot_pairs(pools[base], p))) for k, p in pools.items() if k != base]
    pairs = [{"pool": k} | one_row(paired_counts(f[base].select("example_id", F.col("verifier_ok").alias("a")).join(x.select("example_id", F.col("verifier_ok").alias("b")), "example_id"), "a", "b")) for k, x in f.items() if k != base]
    return {"summary": [{"pool": k} | one_row(M.ovf(x)) for k, x in f.items()], "diffs": diffs, "paired": pairs}


def external_audit(f: DataFrame, shown: int = 3) -> dict:
    return {"buckets": table(M.external_buckets(f), "outcome", "form"), "examples": table(R.serialize_example(f.where("base_ok and not verifier_ok").orderBy("example_id").limit(shown)))}


def persistent_miss_audit(slots: DataFrame) -> dict:
    return {"buckets": table(M.persistent_miss(M.flags(slots, margins=True)), "form", "gap")}


def slice_calibration(pools: DataFrame, rules: list[str], in_slice: str) -> DataFrame:
    """(rule, in_slice, examples, correct, gains, losses) of rules against the top margin, inside and outside a slice (an SQL
    condition on the pool). All rules are columns of one pass."""
    from poolwright.functions.answers import answers_match

    s = S.scored(pools.where(F.size("candidates") > 0))
    ok = lambda c: answers_match(c["answer"], F.col("gold_answer"), F.col("answer_mode"))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), ok(S.rule_column(r)).alias("ok")) for r in rules])
    rows = s.select(F.expr(in_slice).alias("in_slice"), ok(S.top_margin(F.col("scored"))).alias("base"), F.explode(each).alias("x")).select("in_slice", "base", "x.*")
    return rows.groupBy("rule", "in_slice").agg(F.count("*").alias("examples"), F.count_if("ok").alias("correct"), F.count_if(F.col("ok") & ~F.col("base")).alias("gains"), F.count_if(~F.col("ok") & F.col("base")).alias("losses"))


def conversion_audit(runs: DataFrame) -> DataFrame:
    """(benchmark, coverage, conversion) from runs (benchmark, o1, v1, o2, v2)."""
    return runs.select("benchmark", ovf_decomposition(F.col("o1"), F.col("v1"), F.col("o2"), F.col("v2")).alias("d")).select("benchmark", "d.*")


def gate(rows: DataFrame, conditions: dict[str, str]) -> dict:
    """A gate over result rows: sections with their states, and whether all are ready."""
    states = table(M.scorecard(rows, conditions), "section")
    return {"sections": states, "passed": all(s["status"] == "ready" for s in states)}


def gate_compatibility(rows: DataFrame, baseline: str) -> dict:
    """Rows (slice, method, oracle_rate, verifier_rate): each slice's best method and those under tension with the baseline, all
    from one scan."""
    board = table(M.baseline_board(rows, "slice", baseline), "slice", "method")
    plain = lambda r: {k: v for k, v in r.items() if k not in ("best", "tension")}
    return {"deltas": [plain(r) for r in board], "best": [{"slice": r["slice"], "method": r["method"]} for r in board if r["best"]], "tension": [plain(r) for r in board if r["tension"]]}


def gate_external(rows: DataFrame) -> dict:
    """Rows (benchmark, ours, external): delta and tag."""
    tagged = rows.withColumn("delta", F.col("ours") - F.col("external")).withColumn("tag", competitive_tag(F.col("delta")))
    found = table(tagged, "benchmark")
    return {"rows": found, "passed": all(r["tag"] in ("clear_win", "edge_or_win", "near_parity") for r in found)}


def gate_stability(rows: DataFrame, limit: float = 0.02) -> dict:
    """Rows (slice, seed, accuracy): spread over seeds within `limit`. One scan gives the slices and the gate over them."""
    conditions = {"spread": f"spread <= {limit}", "several_runs": "runs > 1"}
    found = table(M.scored_rows(M.seed_stability(rows, "slice", "accuracy"), "slice", conditions))
    slices = sorted((r["row"] for r in found if not r["all_rows"]), key=lambda r: (r["slice"] is not None, r["slice"] or ""))
    n, hits = next(((r["n"], [r[f"c{i}"] for i in range(len(conditions))]) for r in found if r["all_rows"]), (0, [0] * len(conditions)))
    states = sorted(({"section": k, "status": "waiting" if not c else "ready" if c == n else "partial"} for k, c in zip(conditions, hits, strict=True)), key=lambda r: r["section"])
    return {"stability": slices, "sections": states, "passed": all(r["status"] == "ready" for r in states)}


def readiness_pack(runs: DataFrame, reparsed: DataFrame, metrics: list[str]) -> dict:
    return {"runs": table(R.manifest(runs, reparsed, metrics), "run_id")}


def tradeoff_pack(rows: DataFrame, counts: list[str]) -> dict:
    """Runs with named failure counts: which dominates, and effective efficiency."""
    found = table(M.dominant_bucket(rows, counts, "run_id", F.try_divide("verifier", "oracle").alias("v_given_o")), "run_id")
    return {"dominant": [{k: r[k] for k in ("run_id", "dominant", "n")} for r in found], "efficiency": [{k: r[k] for k in ("run_id", "v_given_o")} for r in found]}


def variant_ladder(rows: DataFrame, order: list[str]) -> DataFrame:
    """Variants (variant, accuracy) in a fixed order with the step from the one before: a self-join on the place in the list."""
    at = rows.withColumn("step", F.array_position(F.array(*map(F.lit, order)), F.col("variant")))
    before = at.select((F.col("step") + 1).alias("step"), F.col("accuracy").alias("_before"))
    return at.join(before, "step", "left").select("step", "variant", "accuracy", (F.col("accuracy") - F.col("_before")).alias("delta"))


def multiseed_summary(rows: DataFrame) -> dict:
    return {"seeds": table(M.seed_stability(rows, "slice", "accuracy"), "slice")}


def leaderboard(rows: DataFrame, baseline: str, policies: list[str]) -> DataFrame:
    """Policy rows (slice, method, accuracy) with deltas to the baseline, in configured order."""
    return O.policy_order(M.with_baseline(rows, "slice", baseline, ["accuracy"]), "method", policies)


def branch_matrix(breakdowns: DataFrame) -> DataFrame:
    """(branch, avg_candidates) from size breakdowns (branch, n_candidates, n)."""
    return breakdowns.groupBy("branch").agg(F.try_divide(F.sum(F.col("n_candidates") * F.col("n")), F.sum("n")).alias("avg_candidates"))


def benchmark_runs(train: DataFrame, generated: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Training, generation and evaluation rows of the same run side by side; runs without later rows stay."""
    return train.join(generated, "run_name", "left").join(evaluated, "run_name", "left")


def normalized_exports(runs: DataFrame) -> DataFrame:
    """One shape for runs (row_id, oracle, verifier, total): rates, efficiency and final accuracy."""
    return runs.select("row_id", F.try_divide("oracle", "total").alias("oracle_coverage"), F.try_divide("verifier", "oracle").alias("v_given_o"), F.try_divide("verifier", "total").alias("final_accuracy"))


def compare_targets(targets: DataFrame, observed: DataFrame) -> DataFrame:
    """Target rows against observed finals (row_id, final): delta and class. Targets are a hand-kept list."""
    return targets.join(observed, "row_id", "left").select("row_id", F.col("paper.final").alias("paper_final"), "final", (F.col("final") - F.col("paper.final")).alias("delta"), classify_delta(F.col("final") - F.col("paper.final")).alias("status"))


def export_targets(targets: DataFrame) -> DataFrame:
    delta = lambda c: F.col(f"{c}.final") - F.col("paper.final")
    bucket = risk_bucket(F.col("release_status"), delta("release_reference"), delta("fallback_reference"))
    return targets.select("row_id", "dataset", "variant", F.col("paper.final").alias("paper_final"), F.col("release_reference.final").alias("release_final"), bucket.alias("bucket"), severity(bucket).alias("severity"))


def release_readiness(targets: DataFrame) -> dict:
    out = one_row(M.readiness(export_targets(targets)))
    return out | {"exit_code": 0 if out["practical"] else 1}


def check_bundle(spark: SparkSession, artifacts: DataFrame, rows: list[str], exists: Callable[[str], bool], values: Callable[[str], DataFrame] | None = None) -> list[dict]:
    """State of each artifact that the chosen rows need: missing, wrong_lines or ok. The list is hand-kept and short; lines
    are counted by Spark."""
    out = []
    for a in table(R.required_for(artifacts, rows), "id"):
        state = "ok"
        if not exists(a["path"]):
            state = "missing"
        elif a["expected_lines"] is not None and spark.read.text(a["path"]).where(F.trim("value") != "").count() != a["expected_lines"]:
            state = "wrong_lines"
        out.append({"id": a["id"], "state": state})
    return out
