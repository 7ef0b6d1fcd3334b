"""Mixing sources to target weights: an exact cut in a hash-random order of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: A source's hash order is cut into ranges of about this many rows, and all into at most so many.
RANGE_ROWS, MOST_RANGES = 512, 100_000


def random_key(*columns: F.Column) -> F.Column:
    """60 hash-random bits of the columns' texts, the same in every run and every engine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Target words per source from (source_key, source_size), one row per source.

    Weights repeat in key order. The whole is shared by weight; what exceeds ``cap`` times a
    source's own words goes to the others by weight. That level is the highest one found when the
    sources are capped one after another in the order of cap per weight.
    """
    order = Window.orderBy("source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    below = Window.orderBy(F.col("most") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(below), F.lit(0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    level = F.max(F.col("left") / F.col("free")).over(whole)
    shared = weighed.withColumn("left", left).withColumn("free", free).withColumn("level", level)
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return shared.select("source_key", "source_size", "source_rows", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """How many words of each document the mix takes.

    Returns (doc_id, source, key, size, source_size, target, taken, copies), one row per row of
    ``docs``. ``key`` identifies rows that are alike in (doc_id, source, text). Documents of a
    source stand in hash order; all are taken ``target div source_size`` times, and those before
    the cut once more. ``taken`` counts the document at the cut in part, so that a source's taken
    words are its target rounded down; ``copies`` counts it whole if at least half is taken.

    Null texts have size 0; a null source is a source of its own, the last; a source without words
    has target 0. Rows alike in every column lie next to each other in the order, and either may
    be cut. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    The order of sources is one small window: a row per source. The documents' order is cut into
    even ranges of the hash key, so a hot source is spread over tasks as any other.
    """
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = random_key(F.col("doc_id"), F.col("source"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = written(docs.select("doc_id", "source", source_key.alias("source_key"), size.alias("size"), key.alias("key")), "mix-rows")
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    # How the order is cut into ranges changes no result, only the spread over tasks.
    per_range = max(RANGE_ROWS, rows.count() // MOST_RANGES)
    # Written, so that its true size decides how it is joined; the ranges are dealt after the join.
    wanted = written(targets(sizes, weights, cap), "mix-targets")
    place = F.floor(F.col("key") / F.lit(float(1 << 60)) * F.ceil(F.col("source_rows") / per_range))
    ranged = rows.join(wanted, "source_key").withColumn("range", place).repartition("source_key", "range")
    sums = ranged.groupBy("source_key", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_key", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["source_key", "range"])
    start = F.col("base") + F.col("inside")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = placed.withColumn("start", start).withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", rest)
    taken = F.expr("epochs * size + greatest(0, least(size, rest - start))")
    copies = F.expr("epochs + int(2 * start + size <= 2 * rest and (rest > 0 or source_size = 0))")
    return cut.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    A document at a cut is taken whole if at least half of it lies before the cut. Rows alike in
    (doc_id, source, text) share one key; each gets its own number of copies, matched in any order.
    """
    key = random_key(F.col("doc_id"), F.col("source"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    # Alike rows: their copies are summed, and dealt evenly to the rows again.
    counts = mix(docs, weights, cap).groupBy("key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_alike"))
    same = Window.partitionBy("_key").orderBy("_key")
    keyed = docs.withColumn("_key", key).join(counts.withColumnRenamed("key", "_key"), "_key")
    single = keyed.where("_alike = 1").withColumn("_times", F.col("_copies"))
    many = keyed.where("_alike > 1").withColumn("_row", F.row_number().over(same) - 1)
    many = many.withColumn("_times", F.expr("_copies div _alike + int(_row < _copies % _alike)")).drop("_row")
    out = single.unionByName(many).where("_times > 0").withColumn("_copy", F.explode(F.expr("sequence(1, int(_times))")))
    return out.select(*docs.columns)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce('s' || source, 't') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
sizes AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM rows GROUP BY source_key),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS most FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER below, 0))::BIGINT::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::BIGINT::DOUBLE AS lev
  FROM weighed WINDOW below AS (ORDER BY most::DOUBLE / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (SELECT source_key, source_size, least(most::DOUBLE, max(lev) OVER () * weight) AS target FROM levels),
cut AS (
  SELECT r.*, w.source_size, w.target,
         CASE WHEN w.source_size > 0 THEN floor(w.target)::BIGINT // w.source_size ELSE 0 END AS epochs,
         coalesce(sum(r.size) OVER (PARTITION BY r.source_key ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN wanted w USING (source_key))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM cut
"""
