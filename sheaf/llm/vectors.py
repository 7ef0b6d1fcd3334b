"""Embedding near-dedup with spherical-cap filters from random product codes.

Filter directions are all combinations of one code vector per block of coordinates, so B vectors in
each of m blocks give B^m directions. A vector lies in the filters whose direction it exceeds a
threshold with; they are found by list decoding, block by block, dropping prefixes that cannot reach
the threshold any more. Vectors that share a filter and a label are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import components, read
from sheaf.session import written

#: Independent codes, each after a rotation of its own, even out how many filters a vector gets.
TABLES, SEED = 12, 20260
#: Rows of a filter that one task compares at a time, and how many filters may be split at most.
CELL_ROWS, MOST_SPLIT = 2048, 100_000
#: Rows of a bucket, which holds many filters; up to WIDE rows filters are compared side by side.
BUCKET_ROWS, WIDE = 20_000, 64


@dataclass
class Codes:
    width: int  # padded dimension, a power of two
    blocks: int
    size: int  # code vectors per block
    limit: float

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Random signs for the rotations, and unit code vectors by block, of each table."""
        rng = np.random.default_rng(SEED)
        signs = rng.choice([-1.0, 1.0], (TABLES, 2, self.width))
        codes = rng.standard_normal((TABLES, self.blocks, self.size, self.width // self.blocks))
        return signs, codes / np.linalg.norm(codes, axis=3, keepdims=True) / np.sqrt(self.blocks)


def codes_for(rows: int, width: int, lists: float, per_filter: float) -> tuple[int, int, int, float]:
    """(padded width, blocks, code vectors per block, threshold) for so many filters per vector and rows per filter.

    The threshold is set so that random directions lie in ``lists`` filters on average.
    """
    share = min(0.02, per_filter / max(rows, 1))
    padded = max(16, 1 << (max(width, 1) - 1).bit_length())
    directions = lists / TABLES / share
    # Two blocks spread directions most evenly; more are needed where that takes too many codes.
    blocks = 2 if directions <= 1 << 24 else 4
    size = max(2, round(directions ** (1 / blocks)))
    trial = np.random.default_rng(SEED + 1).standard_normal((48, padded))
    trial /= np.linalg.norm(trial, axis=1, keepdims=True)
    codes = Codes(padded, blocks, size, 0.0).vectors()
    low, high = 0.0, 1.0
    for _ in range(14):
        limit = (low + high) / 2
        best = NormalDist().inv_cdf(1 - share) / padded**0.5
        if limit < best / 2 or np.mean([len(f) for f in decode(trial, *codes, limit)]) > lists:
            low = limit
        else:
            high = limit
    return padded, blocks, size, high


def _matrix(vectors, width: int) -> np.ndarray:
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    # Scaled by the largest component first: squares of very large or small ones stay finite.
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Two rounds of random signs and a Walsh-Hadamard transform: a fast random rotation."""
    width = x.shape[1]
    for sign in signs:
        x = x * sign
        step = 1
        while step < width:
            x = x.reshape(len(x), -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def _decoded(x: np.ndarray, signs: np.ndarray, codes: np.ndarray, limit: float):
    blocks, size = codes.shape[:2]
    scores = np.einsum("nmd,mbd->nmb", _rotated(x, signs).reshape(len(x), blocks, -1), codes, optimize=True)
    best = scores.max(axis=2)
    rest = np.concatenate([np.cumsum(best[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
    for row, after in zip(scores, rest):
        sums, names = np.zeros(1), np.zeros(1, np.int64)
        for block in range(blocks):
            longer = sums[:, None] + row[block]
            prefix, code = np.nonzero(longer >= limit - after[block + 1])
            sums, names = longer[prefix, code], names[prefix] * size + code
        yield np.sort(names)


def decode(x: np.ndarray, signs: np.ndarray, codes: np.ndarray, limit: float) -> list[np.ndarray]:
    """For each unit row, the numbers of all filters whose direction it exceeds ``limit`` with."""
    each = codes.shape[2] ** codes.shape[1]
    tables = [_decoded(x, sign, code, limit) for sign, code in zip(signs, codes)]
    return [np.concatenate([k * each + names for k, names in enumerate(row)]) for row in zip(*tables)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member reachable over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _earlier(packed: list, here: int):
    """Function of (a slice of rows): which rows of the run each shares a filter before ``here`` with."""
    lists = [np.frombuffer(f, np.int64) for f in packed]
    before = [f[f < here] for f in lists]
    row = np.repeat(np.arange(len(before)), [len(f) for f in before])
    _, column, count = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    row, column = row[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    chunks = []
    for start in range(0, int(column.max(initial=-1)) + 1, 1024):
        chosen = (column >= start) & (column < start + 1024)
        chunks.append((row[chosen], column[chosen] - start))

    def shared(part: slice) -> np.ndarray:
        out = np.zeros((part.stop - part.start, len(lists)), bool)
        for rows, columns in chunks:
            has = np.zeros((len(lists), 1024), np.float32)
            has[rows, columns] = 1
            out |= has[part] @ has.T > 0
        return out

    return shared


def _pairs(x: np.ndarray, run: np.ndarray, here: np.ndarray, packed: pa.Array, least: float):
    """Pairs i < j of the same run (rows are sorted by run) at cosine ``least`` or more, and whether
    the run's filter is the first that both lie in."""
    begins = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(run)))
    for begin, size in zip(begins[sizes > WIDE].tolist(), sizes[sizes > WIDE].tolist()):
        rows = x[begin : begin + size]
        earlier = None
        for start in range(0, size, 512):
            part = slice(start, min(start + 512, size))
            i, j = np.nonzero(np.triu(rows[part] @ rows.T, start + 1) >= least)
            if len(i):
                earlier = earlier or _earlier(packed[begin : begin + size].to_pylist(), int(here[begin]))
                yield begin + start + i, begin + j, ~earlier(part)[i, j]
    narrow = np.repeat(sizes <= WIDE, sizes)
    for step in range(1, int(sizes[sizes <= WIDE].max(initial=0))):
        i = np.flatnonzero((run[step:] == run[:-step]) & narrow[step:])
        for start in range(0, len(i), 1 << 14):
            k = i[start : start + (1 << 14)]
            k = k[np.einsum("nd,nd->n", x[k], x[k + step]) >= least]
            lists = [[set(np.frombuffer(packed[int(r)].as_py(), np.int64).tolist()) for r in side] for side in (k, k + step)]
            yield k, k + step, np.array([min(p & q) == h for p, q, h in zip(*lists, here[k].tolist())], bool)


def _bucket(least: float, width: int):
    """Compares the rows of each filter of a bucket of filters."""

    def bucket(table):
        table = table.sort_by([("label", "ascending"), ("filter", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        keys = [table.column(c).to_numpy() for c in ("label", "filter", "i", "j")]
        new = np.append(False, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if table.num_rows else np.zeros(0, bool)
        run = np.cumsum(new)
        ids, copies, piece = (table.column(c).to_numpy() for c in ("id", "copies", "piece"))
        found = [np.zeros((3, 0), np.int64)]
        packed = table.column("filters").combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        for i, j, first in _pairs(_matrix(table.column("v"), width), run, keys[1], packed, least):
            keep = (keys[2][i] == keys[3][i]) | (piece[i] != piece[j])
            found.append(np.stack([i[keep], j[keep], first[keep]]))
        a, b, first = np.concatenate(found, axis=1)
        first = first > 0
        linked = np.unique(np.concatenate([a, b]))
        links = np.bincount(a[first], copies[b[first]], len(ids)) + np.bincount(b[first], copies[a[first]], len(ids))
        root = _roots(len(ids), a, b)
        return pa.table({"id": ids[linked], "links": links[linked].astype(np.int64), "root": ids[root[linked]]})

    return bucket


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, lists: float = 48.0, per_filter: float = 32.0
) -> DataFrame:
    """Near duplicates by cosine among vectors with the same label.

    Returns (vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id,
    embedding, label). Pairs that share a filter are compared in double precision and link at
    cosine >= ``least``; none below it links. Vectors that share no filter are missed: each lies in
    about ``lists`` filters, which at 0.98 finds nearly all pairs (see the tests' recall).

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label
    or id, link with nothing. Exact copies are compared once and counted as often as they stand
    there, so repeated rows link with each other. Missing components of shorter vectors are 0. An
    empty table gives an empty result. Other columns are not looked at.

    Shuffled is a row for each vector and filter, to buckets of about ``BUCKET_ROWS``; a filter with
    more than ``CELL_ROWS`` rows is dealt over pairs of pieces, so that no bucket grows with it.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    compared = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good, F.lit(False))
    values = F.transform(x, lambda e: e.cast("double"))
    same = [F.when(compared, F.xxhash64(F.lit(seed), "label", values)).alias(f"k{seed}") for seed in (1, 2)]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *same, "label", values.alias("v"))
    names = written(rows.select("vec_id", "k1", "k2"), "vector-names")
    groups = rows.where(F.col("k1").isNotNull()).groupBy("k1", "k2")
    groups = groups.agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.xxhash64(F.first("label")).alias("label"), F.first("v").alias("v"))
    groups = written(groups, "vector-groups")
    n, width = groups.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shape = codes_for(n, width or 1, lists, per_filter)

    def filtered(batches):
        signs, codes = Codes(*shape).vectors()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = decode(_matrix(part.column("v"), shape[0]), signs, codes, shape[3])
                filters = pa.array([f.tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "label", "v")), filters, pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], ["id", "copies", "label", "v", "filters", "filter"])

    placed = groups.select("id", "copies", "label", "v").mapInArrow(filtered, "id long, copies long, label long, v array<double>, filters binary, filter array<long>")
    placed = written(placed, "vector-filters")
    split = max(CELL_ROWS, n * lists / MOST_SPLIT)
    sizes = placed.select("label", F.explode("filter").alias("filter")).groupBy("label", "filter").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.where("n > 1")
    # At most MOST_SPLIT filters can be that large, so their list may be broadcast.
    large = sizes.where(F.col("n") > split).select("label", "filter", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("pieces"))
    member = placed.withColumn("filter", F.explode("filter")).join(F.broadcast(written(large, "large-filters")), ["label", "filter"], "left")
    member = member.withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(F.least(o, F.col("piece")).alias("i"), F.greatest(o, F.col("piece")).alias("j")))
    cells = member.withColumn("cell", F.explode(others)).select("label", "filter", "cell.i", "cell.j", "piece", "id", "copies", "v", "filters")
    buckets = max(1, int(n * lists // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("label", "filter", "i", "j"), F.lit(buckets)).alias("bucket")
    links = cells.groupBy(bucket).applyInArrow(_bucket(least, shape[0]), "id long, links long, root long")
    links = written(links, "vector-links")
    found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    joined = groups.select("k1", "k2", "id", "copies").join(counts, "id", "left").join(found, F.col("id") == F.col("node"), "left")
    reps = joined.select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component_id"))
    out = names.join(reps, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "embeddings"))
