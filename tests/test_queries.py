"""Registered queries against their SQL."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry

FAST = ["ovf_summary", "failure_decomposition", "numeric_extract", "choice_extract", "answer_match", "form_buckets", "selector_parseable_then_margin", "budget_curve", "prefix_fill", "family_hygiene", "text_scores", "leaderboard_delta", "ext_event_sessions", "paired_counts", "mcnemar"]


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in "orders lineitem events documents conversations part customer".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rel = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
