"""What the training-data operators share: ids, written tables, batches of bytes, components."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import time
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import discard, written

#: Stands for a null id inside operators: smaller than every other id.
NULL_ID = -(1 << 63)
#: Seconds for the driver to have shuffle files deleted that it found unused.
RELEASE_S = 0.25
#: White space of words and lines, as bytes and as a trim set.
SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_column(name: str = "doc_id") -> F.Column:
    """The id as a long without nulls, for joins inside an operator."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> F.Column:
    """The id as it came in."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_column(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name), F.lit(""))


def store_of_worker(name: str) -> dict:
    """What tasks of one operator keep in their worker process for later ones; see ``slices``."""
    return sys.modules.setdefault(f"_sheaf_kept_{name}", types.ModuleType(name)).__dict__.setdefault("kept", {})


def tidy() -> None:
    """Give memory that is free in this worker back, as its next task may be of quite another kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give it back by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches again, cut so that ``column`` holds about ``most`` bytes or one row in each.

    Goes through all of a task's rows, so what other operators' tasks kept in this worker is dropped
    before (all but the store ``keep``), and free memory is given back before and after.
    """
    for name in [n for n in sys.modules if n.startswith("_sheaf_kept_") and n != f"_sheaf_kept_{keep}"]:
        del sys.modules[name]
    tidy()
    yield from _sliced(batches, column, most)
    tidy()


def _sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(column)
        ends = np.cumsum(lengths_of(values))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def offsets_of(values: pa.Array) -> np.ndarray:
    kind = np.int64 if values.type in (pa.large_string(), pa.large_binary()) else np.int32
    raw = np.frombuffer(values.buffers()[1], kind)
    return raw[values.offset : values.offset + len(values) + 1].astype(np.int64)


def lengths_of(values: pa.Array) -> np.ndarray:
    return np.diff(offsets_of(values)) if len(values) else np.zeros(0, np.int64)


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array without nulls, and where each value begins and the last one ends."""
    ends = offsets_of(values)
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest id reachable from each end of an edge: (node, component).

    ``edges`` has long columns ``a`` and ``b``. Each round hangs every node's larger neighbours,
    then its smaller ones, below its smallest neighbour, so paths shrink to stars in about
    log(longest path) rounds. Each round is a written table; a hub's rows are counted by partial
    aggregates, and the joins are of the kind that adaptive execution splits by skew.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        last, now = now, written(small.where("a != b").distinct(), "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of words: anything but ASCII white space, or letters, digits and what is not ASCII.
WORD_BYTES = ~np.isin(np.arange(256), list(SPACE))
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, _STEP)
        out[0] = 1
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray, of: np.ndarray = WORD_BYTES, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the number of words in each value.

    ``data`` holds the values' bytes end to end, ``bounds`` where each begins and the last one
    ends; ``of`` marks the bytes of words. Works through ``block`` bytes at a time, so that memory
    beyond the result does not grow with a value (one word longer than a block is taken whole).
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    hashes, begins = [], []
    start = 0
    while start < len(data):
        end = min(start + block, len(data))
        while end < len(data) and of[data[end]] and of[data[end - 1]] and not cut[end]:
            near = np.flatnonzero(~of[data[end : end + 4096]] | cut[end : end + 4096][: len(data[end : end + 4096])])
            end = end + int(near[0]) if len(near) else min(end + 4096, len(data))
        part = _LOWER[data[start:end]]
        inside = of[part]
        first = inside & ~np.concatenate([[False], inside[:-1]]) | inside & cut[start:end]
        index = np.flatnonzero(inside)
        if len(index):
            begin = np.flatnonzero(first)
            at = np.flatnonzero(first[index])  # positions of the begins among the word bytes
            length = np.diff(np.append(at, len(index)))
            place = np.arange(len(index)) - np.repeat(at, length)
            with np.errstate(over="ignore"):
                terms = _BYTES[part[index]] * _powers(int(length.max()))[place]
                hashes.append(mixed(np.add.reduceat(terms, at) + length.astype(np.uint64)))
            begins.append(begin + start)
        start = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return words, np.diff(np.searchsorted(where, bounds))


def texts_with_keys(docs: DataFrame) -> DataFrame:
    """(key, doc, text) of every row; rows alike in id and text have the same key."""
    doc, text = id_column(), text_column()
    return docs.select(F.xxhash64(doc, text).alias("key"), doc.alias("doc"), text.alias("text"))


def maybe_marked(rows: DataFrame, keys: DataFrame, bits: int = 26) -> DataFrame:
    """The rows with a column ``perhaps``: true for all whose ``key`` is in ``keys``, and few others.

    Looked up in a bitmap of 2 ** bits bits (8 MB, fixed), so rows need no shuffle to be told apart.
    """
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << bits)) + 1
    known = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    known = written(known, "bitmap")
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).withColumn("_place", F.bitmap_bit_position(bit))
    byte = "cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int)"
    there = F.coalesce(F.expr(f"shiftright({byte}, cast(_place % 8 as int)) & 1 = 1"), F.lit(False))
    return placed.join(F.broadcast(known), "_bucket", "left").withColumn("perhaps", there).drop("_bucket", "_place", "_bits")


def maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is perhaps in ``keys``: all that are, and few others."""
    return maybe_marked(rows, keys).where("perhaps").drop("perhaps")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written: they go when the driver finds them unused.

    Twice, as right after a query its plan may still be on the way to listeners or finalizers.
    """
    import gc

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(RELEASE_S)
