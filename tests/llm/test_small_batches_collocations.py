"""Collocations take texts a few megabytes at a time, and give rows a few at a time."""

import numpy as np
import pyarrow as pa

from sheaf.llm import collocations
from sheaf.session import BATCH_KEY


def test_collocations_take_few_bytes_of_text_at_a_time(spark, monkeypatch):
    seen, before = {}, spark.conf.get(BATCH_KEY)
    write = collocations.written

    def watched(df, name):
        seen[name] = spark.conf.get(BATCH_KEY)
        return write(df, name)

    monkeypatch.setattr(collocations, "written", watched)
    docs = spark.createDataFrame([("a b c. " * 10, "en"), (None, None)], "text string, lang string")
    assert {(r.phrase, r.a) for r in collocations.collocations(docs).collect()} == {("a b c", 10)}
    assert seen["vocabulary"] == seen["nodes"] == "4m"
    assert spark.conf.get(BATCH_KEY) == before


def test_workers_give_few_rows_at_a_time(monkeypatch):
    text = " ".join(f"w{k}" for k in range(300_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([7])], ["text", "lang_key"])
    given = list(collocations._vocabulary(iter([batch])))
    assert max(b.num_rows for b in given) <= 1 << 16
    table = pa.Table.from_batches(given)
    assert sorted(w for w in table.column("word").to_pylist() if w is not None) == sorted(text.split())
    assert sum(n for n, w in zip(table.column("n").to_pylist(), table.column("word").to_pylist()) if w is None) == 300_000

    class Shared:
        def __init__(self, value):
            self.value = value

    given = list(collocations._edges(Shared(np.zeros(0, np.int64)), Shared(np.zeros(0, np.int64)))(iter([batch])))
    assert max(b.num_rows for b in given) <= 1 << 16
    assert sum(sum(b.column("n").to_pylist()) for b in given) == 300_000
