"""Texts go to the workers a few megabytes at a time, in packing and in the whole pipeline."""

import pyarrow as pa

import corpus_pipeline
from sheaf.llm import packing
from sheaf.session import BATCH_KEY


def test_packing_takes_few_bytes_of_text_at_a_time(spark, monkeypatch):
    seen, before = [], spark.conf.get(BATCH_KEY)
    write = packing.written

    def watched(df, name):
        seen.append((name, spark.conf.get(BATCH_KEY)))
        return write(df, name)

    monkeypatch.setattr(packing, "written", watched)
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in packing.pack(docs).collect()) == [1, 2]
    assert seen == [("pieces", "4m")]
    assert spark.conf.get(BATCH_KEY) == before


def test_the_pipeline_takes_few_bytes_at_a_time(spark):
    before = spark.conf.get(BATCH_KEY)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    docs = spark.createDataFrame([(k, "x" * 40_000, "a", "en", 40_000) for k in range(400)], "doc_id long, text string, source string, lang string, n_chars long")
    try:
        corpus_pipeline.modest(spark)
        found = docs.coalesce(1).select("text").mapInArrow(sizes, "bytes long").collect()
        assert max(r.bytes for r in found) < 5 << 20
    finally:
        spark.conf.set(BATCH_KEY, before)
