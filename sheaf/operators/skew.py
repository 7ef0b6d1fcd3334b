"""Equi-join of rows with a looked-up side when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
# So many keys can be hot at most: a hot one has more than one part in MOST_HOT of all.
MOST_HOT = 10_000
# What one piece of a hot key may carry away from its partner row.
PIECE_BYTES = 256 << 20


def measure(table: DataFrame) -> tuple[int, bool]:
    """The number of rows, and whether all of them together stay below the broadcast limit.

    Measured, not estimated, with one action, so ``table`` should be a written one.
    """
    row = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return rows, size <= BROADCAST_BYTES


def hot_keys(
    rows: DataFrame, key: str, threshold: int = HOT_KEY_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """Keys with more than ``threshold`` rows and into how many pieces to split each.

    Counted with map-side aggregation. ``sizes`` (key, bytes) says what each row of a key carries
    away: a row counts as more if that is large. A hot key also has more than one part in
    ``MOST_HOT`` of all, so the list may be broadcast whatever the input.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    load = F.col("_rows").cast("double")
    if sizes is not None:
        heavy = sizes.groupBy(key).agg(F.sum("bytes").alias("_bytes"))
        counts = counts.join(heavy, key, "left")
        per_row = F.coalesce(F.col("_bytes"), F.lit(0)) / F.lit(PIECE_BYTES / threshold)
        load = load * F.greatest(F.lit(1.0), per_row)
    counts = counts.select(key, load.alias("_load"))
    least = counts.select(F.sum("_load") / MOST_HOT).scalar()
    return counts.where((F.col("_load") > threshold) & (F.col("_load") > least)).select(
        key, F.ceil(F.col("_load") / threshold).cast("int").alias("_pieces")
    )


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    spread_by: str = "path",
    small: bool = False,
    threshold: int = HOT_KEY_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` (few rows per key) on ``key``.

    If the caller has measured that ``rows`` is small, its keys are broadcast to reduce ``table``
    where it is read, and no key can be hot. Otherwise rows of a hot key are dealt over its pieces
    by a hash of ``spread_by``; only that key's rows in ``table`` are repeated, once per piece.
    ``sizes`` see ``hot_keys``.
    """
    if small:
        wanted = F.broadcast(rows.select(key).distinct())
        return rows.join(table.join(wanted, key, "left_semi"), key, how)
    hot = F.broadcast(hot_keys(rows, key, threshold, sizes))
    spread = F.pmod(F.xxhash64(spread_by), F.coalesce(F.col("_pieces"), F.lit(1)))
    left = rows.join(hot, key, "left").withColumn("_piece", spread.cast("int")).drop("_pieces")
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    right = table.join(hot, key, "left").withColumn("_piece", F.explode(pieces)).drop("_pieces")
    return left.join(right, [key, "_piece"], how).drop("_piece")
