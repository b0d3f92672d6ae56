"""The pipeline over a small corpus: each stage's decisions take effect and columns stay."""

import corpus_pipeline
from poolwright.llm.common import stored, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= ids
        ids = kept[-1]
    assert len(good - kept[0]) <= 0.05 * len(good)
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert not any(i in r.text for r in docs.select("text").collect() for i in items)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == ids
