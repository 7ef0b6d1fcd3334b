"""Exact top-k by inner product, term at a time over blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import read
from sheaf.session import written

#: Rows of a block of queries and of a block of candidates: what one task holds at a time.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _dense(vectors: pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def top_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids, without rows of the query's own id."""
    chosen = np.flatnonzero(ids != own)
    if len(chosen) > k:
        others = scores[chosen]
        chosen = chosen[others >= np.partition(others, len(others) - k)[len(others) - k]]
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))[:k]]


def _cell(k: int):
    def cell(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy(zero_copy_only=False)
        vectors = _dense(table.column("w"))
        ids = table.column("vec_id").to_numpy()
        queries, query_ids, ids = vectors[asked], ids[asked], ids[~asked]
        largest = int(np.abs(vectors).max(initial=0))
        kind = np.int32 if largest * largest * vectors.shape[1] < 1 << 31 else np.int64
        postings = []  # of each term: the candidates that have it (None: nearly all), and weights
        for column in vectors[~asked].T.astype(kind):
            there = np.flatnonzero(column)
            postings.append((None, np.ascontiguousarray(column)) if 2 * len(there) > len(column) else (there, column[there]))
        out = [[], [], []]
        for own, query in zip(query_ids, queries):
            scores = np.zeros(len(ids), kind)
            for term in np.flatnonzero(query):
                there, weights = postings[term]
                if there is None:
                    scores += kind(query[term]) * weights
                else:
                    scores[there] += kind(query[term]) * weights
            best = top_of(scores, ids, own, k)
            for to, values in zip(out, (np.full(len(best), own), ids[best], scores[best].astype(np.int64))):
                to.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], schema=HITS)

    return cell


def top_k(vectors: DataFrame, asked: F.Column, k: int = 20, scale: int = 64) -> DataFrame:
    """Each query's ``k`` best candidates: (query_id, rank, vec_id, score).

    Queries are the rows of ``vectors`` (vec_id, embedding) where ``asked`` holds, candidates all
    rows but the query's own. Components become floor(scale * x); the score is the inner product,
    components that one side lacks count 0; ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components take no part, nor do rows without an id. Rows with one
    vec_id are candidates each, but not for one another; if they are queries, the best hits of all of
    them are that query's. Empty vectors score 0 with everything. An
    empty table, or one without queries, gives an empty result. Scores are exact while they fit
    in 64 bits.

    Queries and candidates are dealt over blocks of fixed size; a task scores one block of queries
    against one of candidates and keeps k hits for each query, which are merged by query.
    """
    x = F.col("embedding")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    weights = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), weights.alias("w"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    across, down = max(1, -(-n_asked // QUERY_ROWS)), max(1, -(-n // CANDIDATE_ROWS))
    block = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = rows.where(asked).select(block(across).alias("q"), each(down).alias("c"), F.lit(True).alias("asked"), "vec_id", "w")
    others = rows.select(each(across).alias("q"), block(down).alias("c"), F.lit(False).alias("asked"), "vec_id", "w")
    hits = queries.unionByName(others).groupBy("q", "c").applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
