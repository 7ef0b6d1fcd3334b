"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash: for each line key, in how many documents of
the batches it stands for the key occurs, and which document keeps the line. Documents arrive in
batches of falling doc_id. A batch is merged against the runs: keys that no run holds (the anti
join) get their keeper from this batch, the others only add to the count; then the batch becomes a
run of the lowest level. When a level holds ``fanout`` runs they are compacted to one of the next.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import NULL_ID, SPACE, id_column, slices, text_column
from sheaf.operators.skew import measure
from sheaf.session import new_table_path, written

HASH = ["h1", "h2"]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key; None where the key is shorter than ``min_chars``."""
    key = line.strip(SPACE).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and sum(b & 0xC0 != 0x80 for b in key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def _keys_of(min_chars: int):
    def keys(batches):
        for batch in slices(batches, "text"):
            ids, digests = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                found = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                ids += [doc] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_halves(digests)], ["doc", *HASH])

    return keys


def _without(text: bytes, gone, min_chars: int) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [line for line in lines if not ((k := line_key(line, min_chars)) and gone(k))]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _kept_batch(batch, results) -> pa.RecordBatch:
    texts, before, dropped = zip(*results) if results else ((), (), ())
    columns = [
        batch.column("row"),
        pa.array(texts, pa.binary()).cast(pa.string()),
        pa.array(before, pa.int64()),
        pa.array(dropped, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["row", "kept", "n_lines", "n_dropped"])


class Runs:
    """The levels of runs; each run is a table in the shared folder, bucketed and sorted by hash."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, rows: DataFrame) -> tuple[DataFrame, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = new_table_path(self.spark, name)
        (
            rows.repartition(self.buckets, *HASH)
            .write.bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", path)
            .saveAsTable(name)
        )
        return self.spark.table(name), path

    def _compacted(self, runs: list[tuple[DataFrame, str]]) -> DataFrame:
        # Read as plain files: the planner takes a union of bucketed scans for bucketed, but may then
        # still turn the scans' buckets off, which splits keys over tasks.
        rows = self.spark.read.parquet(*[path for _, path in runs])
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Merge a batch of (h1, h2, n, keeper) in: keys held by a run lose their keeper here."""
        for run, _ in (r for level in self.levels for r in level):
            batch = batch.join(run.select(*HASH, F.lit(True).alias("old")), HASH, "left")
            batch = batch.withColumn("keeper", F.when(F.col("old").isNull(), F.col("keeper"))).drop("old")
        self.levels[0].append(self._run(batch))
        for k in range(len(self.levels)):
            if len(self.levels[k]) == self.fanout:
                merged = self._run(self._compacted(self.levels[k]))
                self.levels[k] = []
                self.levels += [[]] * (k + 1 == len(self.levels))
                self.levels[k + 1] = [*self.levels[k + 1], merged]

    def all(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return runs[0][0] if len(runs) == 1 else self._compacted(runs)


def repeated_lines(keys: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, n, keeper) of the keys found in at least ``min_docs`` documents."""
    spark = keys.sparkSession
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(keys.stat.approxQuantile("doc", shares, 0.01))) if shares else []
    runs = Runs(spark, fanout)
    edges = [None, *map(int, bounds), None]
    for low, high in reversed(list(zip(edges, edges[1:]))):
        part = keys
        part = part if low is None else part.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        counted = part.groupBy(*HASH).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
        runs.add(counted)
    return written(runs.all().where(F.col("n") >= min_docs), "repeated-lines")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 4,
    small: bool | None = None,
) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id that holds them.

    Returns (row, kept, n_lines, n_dropped): ``row`` is the input row as a struct, so other columns
    may have any name; ``kept`` is the text without the dropped lines. A line's key is the line
    without ASCII white space at both ends and with A-Z lower-cased; keys of ``min_chars`` code
    points or more in ``min_docs`` documents or more are dropped.

    A null or empty text is one empty line. Rows with the same doc_id count as one document, and
    each is treated by that document's decisions; null ids are one document, smaller than all
    others. An empty table gives an empty result. Texts are examined whole, whatever their length.

    If the repeated keys are measured to be few megabytes, they go to the tasks and texts are not
    shuffled; otherwise they are joined to the documents' keys and texts meet them by id. Both
    give the same rows (``small`` forces one). The batches only say how the runs are built.
    """
    ided = docs.select(id_column().alias("doc"), F.struct("*").alias("row"), text_column().alias("text"))
    keys = written(ided.select("doc", "text").mapInArrow(_keys_of(min_chars), "doc long, h1 long, h2 long"), "line-keys")
    repeated = repeated_lines(keys, min_docs, batches, fanout)
    out = "row " + docs.schema.simpleString() + ", kept string, n_lines long, n_dropped long"
    if small if small is not None else measure(repeated)[1]:
        rows = repeated.select(*HASH, "keeper").toPandas().to_numpy(np.int64)
        keeper = docs.sparkSession.sparkContext.broadcast({a.tobytes(): int(d) for a, d in zip(rows[:, :2], rows[:, 2])})

        def drop_known(found):
            of = keeper.value
            for batch in slices(found, "text"):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                yield _kept_batch(batch, [_without(t, lambda k, d=d: of.get(k, d) != d, min_chars) for d, t in zip(batch.column("doc").to_pylist(), texts)])

        return ided.mapInArrow(drop_known, out)
    # Hot lines: this join's larger side is split by adaptive execution where a key's rows stand out.
    gone = keys.distinct().join(repeated, HASH).where("doc != keeper")
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct(*HASH)).alias("gone"))

    def drop_joined(found):
        for batch in slices(found, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [{struct.pack("<qq", x["h1"], x["h2"]) for x in g or ()} for g in batch.column("gone").to_pylist()]
            yield _kept_batch(batch, [_without(t, s.__contains__, min_chars) for s, t in zip(sets, texts)])

    return ided.join(gone, "doc", "left").mapInArrow(drop_joined, out)


def query(spark, sf_dir):
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", sha)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
