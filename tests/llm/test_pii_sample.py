"""The field's sample: the smallest hashes of all rows, rows alike once."""

import pytest
from pyspark.sql import functions as F

from sheaf.llm import pii
from sheaf.llm.common import id_column, text_column


def hashes(frame):
    return frame.withColumn("h", F.xxhash64("doc", "text"))


@pytest.mark.parametrize("most", [1, 7, 300, 4000, 10**6])
def test_smallest_hashes_of_all_rows(spark, most):
    rows = spark.range(5000).select(F.col("id").alias("doc"), F.concat(F.lit("call 555 "), F.col("id") % 1700).alias("text"))
    rows = hashes(rows.where("doc % 3 > 0").unionByName(rows.where("doc % 50 = 0")))
    found = [r.h for r in pii.smallest(rows, most).collect()]
    assert sorted(found) == sorted({r.h for r in rows.select("h").collect()})[:most]


def test_a_row_repeated_for_most_of_the_table_counts_once(spark):
    rare = spark.range(40).select("id", F.concat(F.lit("mail a@b.c "), "id").alias("text"))
    hot = spark.range(20000).select(F.lit(99).cast("long").alias("id"), F.lit("mail hot@b.c").alias("text"))
    rows = hashes(rare.unionByName(hot).toDF("doc", "text"))
    found = pii.smallest(rows, 30).collect()
    assert sorted(r.h for r in found) == sorted({r.h for r in rows.select("h").collect()})[:30]
    assert len({(r.doc, r.text) for r in found}) == 30


def test_sample_of_nulls_and_of_nothing(spark):
    rows = hashes(spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, None), (None, None)], "doc long, text string"))
    assert pii.smallest(rows, 10).count() == len({r.h for r in rows.collect()}) == 3
    assert pii.smallest(rows.where("false"), 10).count() == 0
    assert pii.train(spark.createDataFrame([], "doc_id long, text string")) is None


def test_sample_is_the_ordered_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = hashes(docs.select(text_column().alias("text"), id_column().alias("doc")).where(F.col("text").rlike("[0-9@]")))
    plain = found.orderBy("h", "doc").limit(50)
    assert sorted(r.doc for r in pii.smallest(found, 50).collect()) == sorted(r.doc for r in plain.collect())
