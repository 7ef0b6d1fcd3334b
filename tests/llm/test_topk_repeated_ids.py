"""Rows with one vec_id against the SQL: each is a candidate, and all of them are one query."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import search


@pytest.mark.parametrize("blocks", [(1024, 8192), (2, 7)])
def test_rows_with_one_id_stay(spark, blocks, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", blocks[0])
    monkeypatch.setattr(search, "CANDIDATE_ROWS", blocks[1])
    rng = random.Random(8)
    rows = [(rng.choice([0, 20, 20, 20, k]), [rng.uniform(-1, 1) for _ in range(6)]) for k in range(90)]
    rows += [(20, rows[0][1])] * 25 + [(41, rows[3][1])] * 30 + [(60, None)]
    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    connection = duckdb.connect()
    connection.register("embeddings", embeddings)
    expected = sorted(connection.execute(search.SQL).fetchall())
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clashing = table.withColumn("row", F.lit(1)).withColumn("w", F.lit(2)).withColumn("rank", F.lit("x"))
    got = search.top_k(clashing, F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == expected
