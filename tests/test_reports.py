"""Reports and pipelines run end to end on small pools and agree with each other."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from poolwright.functions.stats import paired_counts, paired_rates
from poolwright.operators import metrics as M
from poolwright.plans import reports as R
from poolwright.plans.adapters import pool, slots
from poolwright.sources import schemas
from poolwright.sources.files import one_row


@pytest.fixture(scope="module")
def few(spark, sf):
    return slots(spark, sf).where("cast(example_id as bigint) < 200").cache()


def test_flagship(few, tmp_path):
    report = R.generate_then_rerank(few)
    s = report["summary"]
    assert abs(s["oracle_coverage"] * s["verifier_given_oracle"] - s["verifier_accuracy"]) < 1e-9
    assert report["failures"]["oracle_miss"] + s["oracle_correct"] == s["total_examples"] == report["paired"]["n"]
    assert report["interval"]["low"] <= report["interval"]["delta"] <= report["interval"]["high"]
    empty = R.generate_then_rerank(few.where("false"))
    assert empty["summary"]["total_examples"] == empty["interval"]["delta"] == 0 and empty["by_pool_size"] == empty["examples"] == []
    R.write(report, "Run", str(tmp_path / "r.json"), str(tmp_path / "r.md"))
    assert "## by pool size" in (tmp_path / "r.md").read_text()


def scans(rows):
    """Scans in a plan that has not run; one that has shows its first form as well."""
    return rows.select("*")._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")


def test_sections_are_those_of_single_reports(spark):
    """One scan gives what each section's own aggregate gives; ties, null flags' texts and pools without hits included."""
    rows = [(f"e{i}", "p", "4", "numeric", 1 + i % 3, i % 4 > 0, i % 4 == 1, i % 2 == 1 and i % 4 > 0, i % 4 > 1, [None, "4", "Final answer: 4", "", "none"][i % 5]) for i in range(60)]
    f = spark.createDataFrame(rows, "example_id string, problem string, gold_answer string, answer_mode string, n_candidates long, oracle boolean, first_ok boolean, base_ok boolean, verifier_ok boolean, verifier_text string")
    found = [r.asDict(recursive=True) for r in M.sections(f).collect()]
    (whole,) = [r for r in found if r["section"] == "all"]
    assert whole["summary"] == one_row(M.ovf(f)) and whole["failures"] == one_row(M.failure_decomposition(f)) and whole["rescues"] == one_row(M.rescue_counts(f))
    assert whole["hygiene"] == one_row(M.prediction_hygiene(f, "verifier_text"))
    assert one_row(paired_rates(spark.createDataFrame([whole["paired"]], "n long, a_only long, b_only long, both long, neither long"))) == one_row(paired_counts(f, "base_ok", "verifier_ok"))
    assert {r["n_candidates"]: r["sizes"] for r in found if r["section"] == "pool_size"} == {r.pop("n_candidates"): {k: v for k, v in r.items() if k not in ("share", "n_candidates")} for r in R.table(M.count_breakdown(f))}
    assert {r["pattern"]: r["sizes"]["n"] for r in found if r["section"] == "pattern" and r["pattern"]} == {r["pattern"]: r["n"] for r in R.table(M.oracle_patterns(f))}
    assert {k: v for k, v in whole["right"].items()} == {r["selector"]: r["correct"] for r in R.table(M.selection_efficiency(f))}
    assert scans(M.sections(f)) == 1
    (none,) = M.totals(f.where("false")).collect()
    assert none.summary.total_examples == 0 and none.sizes.oracle_rate == 0 and none.hygiene.n == 0 and not M.sections(f.where("false")).count()
    assert {k: whole[k] for k in M.PARTS} == one_row(M.totals(f))


def test_board_is_one_scan(spark):
    rows = spark.createDataFrame([("a", "base", 0.5, 0.4), ("a", "new", 0.6, 0.3), ("a", "old", 0.5, 0.4), ("b", "new", 0.6, None), (None, "base", 0.1, 0.1)], "slice string, method string, oracle_rate double, verifier_rate double")
    board = M.baseline_board(rows, "slice", "base")
    got = {(r.slice, r.method): r for r in board.collect()}
    want = {(r.slice, r.method): r for r in M.with_baseline(rows.fillna("-", ["slice"]), "slice", "base", ["oracle_rate", "verifier_rate"]).collect()}
    assert all(got[k].oracle_rate_delta == want[k[0] or "-", k[1]].oracle_rate_delta for k in got)
    assert [k for k, r in got.items() if r.tension] == [("a", "new")] and {k for k, r in got.items() if r.best} == {("a", "old"), ("b", "new"), (None, "base")}
    assert scans(board) == scans(M.scored_rows(M.seed_stability(rows, "slice", "oracle_rate"), "slice", {"x": "runs > 1"})) == 1
    empty = R.gate_stability(spark.createDataFrame([], "slice string, seed int, accuracy double"))
    assert empty["stability"] == [] and {s["status"] for s in empty["sections"]} == {"waiting"} and not empty["passed"]


def test_budget_and_diagnosis(few):
    curve = R.candidate_budget(few, 4)["curve"]
    assert [r["k"] for r in curve] == [1, 2, 3, 4] and all(a["oracle_rate"] <= b["oracle_rate"] for a, b in zip(curve, curve[1:]))
    same = R.conversion_diagnosis(few, few)["buckets"]
    assert {r["bucket"] for r in same} <= {"common_hit", "common_miss"}
    assert R.persistent_miss_audit(few)["buckets"] is not None


def test_gates(spark):
    rows = spark.createDataFrame([("a", "base", 0.5, 0.4), ("a", "new", 0.6, 0.3), ("b", "base", 0.5, 0.4), ("b", "new", 0.6, 0.5)], "slice string, method string, oracle_rate double, verifier_rate double")
    out = R.gate_compatibility(rows, "base")
    assert [(r["slice"], r["method"]) for r in out["tension"]] == [("a", "new")] and {r["slice"]: r["method"] for r in out["best"]} == {"a": "base", "b": "new"}
    seeds = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.51), ("b", 1, 0.3)], "slice string, seed int, accuracy double")
    stable = R.gate_stability(seeds)
    assert not stable["passed"] and {s["section"]: s["status"] for s in stable["sections"]} == {"spread": "ready", "several_runs": "partial"}
    ladder = R.variant_ladder(spark.createDataFrame([("x", 0.2), ("y", 0.5)], "variant string, accuracy double"), ["x", "y"]).orderBy("step").collect()
    assert ladder[0].delta is None and abs(ladder[1].delta - 0.3) < 1e-9
    with pytest.raises(ValueError):
        R.table(spark.range(2000))


def test_targets(spark):
    rows = [("r1", "d", "v", (0.5, 0.6, 0.3), "released", (0.5, 0.6, 0.31), None, ""), ("r2", "d", "v", (0.5, 0.6, 0.3), "released", (0.5, 0.6, 0.2), (0.5, 0.6, 0.3), ""), ("r3", "d", "v", (0.5, 0.6, 0.3), "rerun_pending", None, None, "")]
    targets = spark.createDataFrame(rows, schemas.TARGET)
    assert [r.bucket for r in R.export_targets(targets).orderBy("row_id").collect()] == ["close", "fallback_close", "pending"]
    out = R.release_readiness(targets)
    assert (out["ok"], out["caveat"], out["pending"], out["blocker"], out["exit_code"]) == (1, 1, 1, 0, 0)


def test_merges_of_metrics(spark, few):
    rows = spark.createDataFrame([(1, None, 0.5), (2, 0.1, 0.2)], "id int, a double, b double")
    fall = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.9, 0.9)], "id int, a double, b double")
    got = {r.id: r for r in M.merge_hygiene(rows, fall, ["a", "b"], "id").collect()}
    assert got[1].a == 0.9 and got[1].b == 0.5 and got[1].provenance == "mixed" and got[2].provenance == "summary"
    assert one_row(M.best_row(spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "id int, m double"), "m", "id")) == {"id": 1, "m": 0.5}
    p = pool(few).withColumn("candidates", F.slice("candidates", 1, 2))
    assert p.count() == few.select("example_id").distinct().count()


def test_persistent_misses_go_through_pools_once(spark, sf):
    plan = entry.queries()["persistent_miss"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1
