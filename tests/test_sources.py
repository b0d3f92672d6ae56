"""Files, upserts, resumable runs."""

import json

import pytest
from pyspark.sql import functions as F

from poolwright.sources import files as S
from poolwright.sources import paged, schemas
from poolwright.streaming import resume


def test_jsonl(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"example_id": 7, "candidates": ["1"], "metadata": {"a": {"b": 2}}}\n\n{"example_id": "8"}\n')
    rows = S.scan_jsonl(spark, str(path), schemas.POOL, position=True).orderBy("pos").collect()
    assert [r.example_id for r in rows] == ["7", "8"] and rows[1].candidates is None
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        S.scan_jsonl(spark, str(path), schemas.POOL).collect()


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("1", None)], "example_id string, prediction string")
    S.sink_jsonl(rows, str(tmp_path / "out"))
    with pytest.raises(Exception):
        S.sink_jsonl(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"example_id":"1","prediction":null}'


def test_csv_and_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a,\nb"\n')
    assert S.scan_csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).first().asDict() == {"x": "1", "y": "a,\nb"}
    (tmp_path / "r.md").write_text("# Run\n- Accuracy: **0.75**\n")
    assert S.scan_report_metric(spark, str(tmp_path / "r.md")).first().value == 0.75
    doc = S.scan_json_variant(spark, str(tmp_path / "d.json")) if (tmp_path / "d.json").write_text('{"a": {"b": 2}}') else None
    assert doc.select(S.nested_get(F.col("doc"), "a.b").alias("v"), S.first_number(F.col("doc"), ["x", "a.b"], "b").alias("w")).first() == (2.0, 2.0)


def test_upserts(tmp_path):
    S.upsert_csv(tmp_path / "t.csv", ["id", "v"], {"id": 1, "v": "a"}, ["id"])
    S.upsert_csv(tmp_path / "t.csv", ["id", "v"], {"id": 2, "v": "b,c"}, ["id"])
    S.upsert_csv(tmp_path / "t.csv", ["id", "v"], {"id": 1, "v": "d", "w": 5}, ["id"])
    assert (tmp_path / "t.csv").read_text() == 'id,v,w\n1,d,5\n2,"b,c",\n'
    S.upsert_section(tmp_path / "r.md", "One", "x")
    S.upsert_section(tmp_path / "r.md", "Two", "y")
    S.upsert_section(tmp_path / "r.md", "One", "z")
    assert (tmp_path / "r.md").read_text() == "## One\n\nz\n\n## Two\n\ny\n"
    S.upsert_json_field(tmp_path / "j.json", "k", 1, "n")
    S.upsert_json_field(tmp_path / "j.json", "k", 2, "n")
    assert json.loads((tmp_path / "j.json").read_text()) == {"k": 2, "notes": ["n"]}


def test_resume(spark, tmp_path):
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    (source / "a.json").write_text('{"example_id": "1"}\n{"example_id": "2"}\n')
    work = lambda d: d.withColumn("prediction", F.lit("x"))
    resume.run_resumable(spark, str(source), "example_id string", work, str(out), str(mark))
    (source / "b.json").write_text('{"example_id": "3"}\n')
    second = resume.run_resumable(spark, str(source), "example_id string", work, str(out), str(mark))
    assert sum(p["rows"] for p in resume.progress(second)) == 1
    assert sorted(r.example_id for r in spark.read.json(str(out)).collect()) == ["1", "2", "3"]


def test_paged_source(spark):
    class FakeClient(paged.PagedClient):  # local, so that workers get them by value
        def __init__(self, base):
            pass

        def count(self):
            return 5

        def rows(self, offset, length):
            return [{"i": i} for i in range(offset, offset + length)]

    class FakeSource(paged.PagedSource):
        client = FakeClient

        @classmethod
        def name(cls):
            return "fake_rows"

    spark.dataSource.register(FakeSource)
    rows = spark.read.format("fake_rows").option("base", "x").option("block", "2").load()
    assert sorted(json.loads(r.row)["i"] for r in rows.collect()) == [0, 1, 2, 3, 4] and rows.rdd.getNumPartitions() == 3
