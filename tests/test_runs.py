"""Paged services, runs that stop and go on, streams with late and repeated rows."""

import io
import json
from contextlib import redirect_stdout

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from poolwright.plans import run_queries as Q
from poolwright.sources import paged
from poolwright.streaming import ordered, ranges

SCHEMA = "o_orderkey long, o_totalprice double, o_orderstatus string"


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_service(spark, sf):
    paged.register(spark)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    load = lambda: spark.read.format("paged_parquet").schema("row_index long, " + SCHEMA).option("base", f"{sf}/orders.parquet").option("page", 100).option("push", True).load()
    rows = load().where("o_orderstatus = 'F' and o_totalprice > 100000 and o_orderkey in (5, 8, 200, 811) or false").where("row_index >= 3")
    said = plan(rows)
    assert "GreaterThanOrEqual(row_index,3)" in said and "EqualTo(o_orderstatus,F)" in said and "In(o_orderkey" in said and "o_custkey" not in said
    want = orders.where("o_orderstatus = 'F' and o_totalprice > 100000 and o_orderkey in (5, 8, 200, 811)").select("o_orderkey", "o_totalprice", "o_orderstatus")
    assert sorted(map(tuple, rows.drop("row_index").collect())) == sorted(map(tuple, want.collect()))
    places = load().where("row_index between 250 and 449")
    assert places.rdd.getNumPartitions() == 2 and places.count() == 200


def test_a_scan_can_be_used_again(spark, sf):
    rows = paged.scan(spark, f"{sf}/orders.parquet", "row_index long", source=paged.ParquetPagesSource, page=100)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert rows.where("row_index < 10").count() == 10 and rows.count() == n
    both = rows.where("row_index < 10").agg(F.count("*").alias("a")).join(rows.agg(F.count("*").alias("b"))).first()
    assert tuple(both) == (10, n)
    part = paged.scan(spark, f"{sf}/orders.parquet", SCHEMA, [("o_orderstatus", "in", ["F", "O"]), ("row_index", "<", 50)], paged.ParquetPagesSource)
    assert part.count() == spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey < 50 and o_orderstatus in ('F', 'O')").count()
    with pytest.raises(Exception, match="can't filter"):
        paged.scan(spark, "http://x", SCHEMA, [("o_orderstatus", "=", "F")]).collect()


def test_pages_are_dealt_and_bounded():
    reader = paged._Reader(paged.ParquetPages("x"), StructType.fromDDL("row_index long"), {"page": "10", "tasks": "3"})
    assert [p.value for p in reader.dealt(5, 100)] == [(5, 45), (45, 85), (85, 100)] and reader.dealt(7, 7) == []
    for where, want in ([(">", 4)], (5, 20)), ([("=", 7)], (7, 8)), ([("in", [3, 9])], (3, 10)), ([("<", 4), (">=", 9)], (9, 9)), ([("in", [])], (20, 20)):
        reader.where = [("row_index", *x) for x in where]
        assert reader.bounds(20) == want


def test_pages_are_tried_again(spark, tmp_path):
    class Flaky(paged.PagedClient):  # local, so that workers get it by value; each page fails twice, by a file of its own
        def __init__(self, base):
            self.base = base

        def count(self):
            return 25

        def rows(self, offset, length, columns=None, where=()):
            import os

            path = f"{self.base}/{offset}"
            tried = os.path.getsize(path) if os.path.exists(path) else 0
            if tried < 2:
                with open(path, "a") as f:
                    f.write("x")
                raise paged.Busy("busy", 0.01)
            return [{"i": i} for i in range(offset, offset + length)]

    class FlakySource(paged.PagedSource):
        client = Flaky

        @classmethod
        def name(cls):
            return "flaky_rows"

    rows = paged.scan(spark, str(tmp_path), source=FlakySource, page=10)
    assert sorted(json.loads(r.row)["i"] for r in rows.collect()) == list(range(25))
    with pytest.raises(Exception, match="busy"):
        paged.scan(spark, str(tmp_path), source=FlakySource, page=7, attempts=2).collect()


def orders_run(spark, sf, folder, step=lambda part, name: None, **more):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return ranges.Run(rows, "o_orderkey", lambda d: d.withColumn("x", F.col("o_orderkey") * 2), folder, 5, ("x",), step, **more)


def test_killed_at_every_step(spark, sf, tmp_path):
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    steps = [(k, s) for k in range(5) for s in ("data", "log")]
    run = Q.with_interruptions(orders_run(spark, sf, str(tmp_path / "run"), Q.killing(*steps)))
    got = run.result()
    assert got.count() == n == got.select("o_orderkey").distinct().count() and run.pending() == []
    log = run.progress().collect()
    assert sum(r.rows_out for r in log) == n and len(log) == 5 and max(r.rows_in for r in log) < n // 3
    assert run.clear() == 0 and run.go() == []


def test_what_is_left_and_two_runs_at_once(spark, sf, tmp_path):
    folder = str(tmp_path / "run")
    first = orders_run(spark, sf, folder)
    assert first.result().count() == 0 and first.progress().count() == 0 and first.go(2) == [0, 1]
    other = []

    def overtaken(part, name):  # another run enters the range between this one's data and its entry
        if (part, name) == (2, "data"):
            other.append(orders_run(spark, sf, folder).do(2))

    assert orders_run(spark, sf, folder, overtaken).do(2) is False and other == [True]
    assert orders_run(spark, sf, folder).go() == [3, 4]
    assert first.result().select("o_orderkey").distinct().count() == first.result().count() == first.rows.count()
    with pytest.raises(ValueError):
        ranges.Run(first.rows, "o_orderstatus", lambda d: d, folder)


def test_audit_and_awkward_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), ("b", 2), ("a'x", 3), ("", 4), ("b", 5)], "k string, v int")
    run = ranges.Run(rows, "k", lambda d: d, str(tmp_path / "keys"), 3)
    run.go()
    assert sorted(r.v for r in run.result().collect()) == [1, 2, 3, 4, 5]
    bad = ranges.Run(rows, "k", lambda d: d, str(tmp_path / "bad"), 2, ("k",))
    with pytest.raises(ranges.Failed):
        bad.go()
    assert bad.pending()[0] == 0 and bad.clear() == 1
    empty = ranges.Run(rows.limit(0), "k", lambda d: d, str(tmp_path / "none"))
    assert empty.go() == [0] and empty.result().count() == 0


class Handle:
    """State of one key, in memory, and its timers."""

    def __init__(self):
        self.rows, self.last, self.timers = [], None, set()

    def getListState(self, name, schema):
        outer = self

        class List:
            appendValue = staticmethod(lambda v: outer.rows.append(v))
            exists = staticmethod(lambda: bool(outer.rows))
            get = staticmethod(lambda: iter(list(outer.rows)))
            put = staticmethod(lambda v: setattr(outer, "rows", list(v)))
            clear = staticmethod(lambda: setattr(outer, "rows", []))

        return List

    def getValueState(self, name, schema):
        outer = self

        class Value:
            exists = staticmethod(lambda: outer.last is not None)
            get = staticmethod(lambda: outer.last)
            update = staticmethod(lambda v: setattr(outer, "last", v))

        return Value

    def registerTimer(self, ms):
        self.timers.add(ms)


def test_rows_leave_in_order():
    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, work = Handle(), ordered.InOrder()
    work.init(handle)
    feed = lambda wm, *rows: list(work.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["ts_us", "event_id", "label"])]), At(wm)))
    out = lambda wm: [tuple(r) for p in work.handleExpiredTimer((1,), At(wm), None) for r in p[["event_id", "before", "place"]].itertuples(index=False)]
    feed(0, (5000, 1, "a"), (9000, 2, "b"), (9000, 0, "c"))
    feed(0, (7000, 3, "d"))
    assert handle.timers == {6, 8} and out(8) == [(1, None, 1), (3, "a", 2)]
    feed(8, (8000, 4, "late"), (12_000, 5, "e"))
    assert out(20) == [(0, "d", 3), (2, "c", 4), (5, "b", 5)] and handle.rows == []


def test_pages_of_a_row_group_read_it_once(sf, monkeypatch):
    """pages that follow one another don't read their row group anew."""
    import pickle

    import pyarrow.parquet as pq

    reads, own = [], pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, g, **k: reads.append(g) or own(self, g, **k))
    pages = paged.ParquetPages(f"{sf}/orders.parquet")
    n = pages.count()
    got = [k for a in range(0, n, 100) for k in pages.rows(a, min(100, n - a), ["o_orderkey"])["o_orderkey"].to_pylist()]
    assert got == pq.read_table(f"{sf}/orders.parquet")["o_orderkey"].to_pylist() and len(reads) == pq.ParquetFile(f"{sf}/orders.parquet").metadata.num_row_groups
    assert pickle.loads(pickle.dumps(pages))._open is None
