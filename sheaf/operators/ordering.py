"""Global order without one big task, and without sorting contents.

Positions, running sums and partition boundaries come from narrow key columns alone. These are
range partitioned, sorted and written out with the partition number and the row's index in it;
then only one total per partition crosses partitions, so what is broadcast has at most as many
rows as there are shuffle partitions. No single key can overload a partition, because the order
columns are unique. Rows with contents are then sent straight to the partition their key belongs
to: one shuffle, and no sampling pass over the contents.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.content import whole_part
from sheaf.operators.skew import measure
from sheaf.session import written

_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition above these bits

PART_BYTES = 256 << 20
# Into so many stretches of parts the keys are routed first; only their bounds are constants.
COARSE = 1024


def ordered_table(keys: DataFrame, order: Sequence[str], costly: bool = False) -> DataFrame:
    """Narrow ``keys`` in ranges of ``order`` (unique), as a written table.

    Finding the ranges reads ``keys`` once more; if they are ``costly``, derived from contents,
    they are written first.
    """
    tagged = (
        (written(keys, "keys") if costly else keys)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return written(tagged, "ordered").select(
        *keys.columns,
        F.shiftright("_mid", _INDEX_BITS).alias("_range"),
        F.col("_mid").bitwiseAND((1 << _INDEX_BITS) - 1).alias("_index"),
    )


def _before(order: str, *group: str):
    window = Window.partitionBy(*group).orderBy(order) if group else Window.orderBy(order)
    return window.rowsBetween(Window.unboundedPreceding, -1)


def with_position(keys: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 1-based global position of each row in the order of ``order`` (unique)."""
    table = ordered_table(keys, order)
    totals = table.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(_before("_range")), F.lit(0))
    carry = totals.select("_range", earlier.alias("_earlier"))
    return table.join(F.broadcast(carry), "_range").select(
        *keys.columns, (F.col("_earlier") + F.col("_index") + 1).alias(name)
    )


def with_total(table: DataFrame, weight: str) -> DataFrame:
    """Add to an ordered table the sum of ``weight`` over all rows before each as ``total``."""
    ranges = table.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(_before("_range")), F.lit(0))
    carry = ranges.select("_range", earlier.alias("_carry"))
    running = F.coalesce(F.sum(weight).over(_before("_index", "_range")), F.lit(0))
    return (
        table.withColumn("_running", running)
        .join(F.broadcast(carry), "_range")
        .withColumn("total", (F.col("_running") + F.col("_carry")).cast("long"))
        .drop("_running", "_carry")
    )


def with_offset(table: DataFrame, totalled: DataFrame, group: str, weight: str) -> DataFrame:
    """Add to ``totalled``, made of a ``table`` ordered by ``group`` first, the same over the rows
    of its group only, as ``offset``. The partitioning of the one serves the other.

    A group of any size is spread over ranges. Only a group that goes on from an earlier range
    needs a carry, and a range has at most one such group.
    """
    sums = table.groupBy("_range", group).agg(F.sum(weight).alias("_sum"))
    carry = (
        sums.withColumn("_carry", F.sum("_sum").over(_before("_range", group)))
        .where(F.col("_carry").isNotNull())
        .select("_range", group, "_carry")
    )
    running = F.coalesce(F.sum(weight).over(_before("_index", "_range", group)), F.lit(0))
    offset = F.col("_running") + F.coalesce("_carry", F.lit(0))
    return (
        totalled.withColumn("_running", running)
        .join(F.broadcast(carry), ["_range", group], "left")
        .withColumn("offset", offset.cast("long"))
        .drop("_running", "_carry")
    )


def part_size(table: DataFrame, weight: str, part_bytes: int = PART_BYTES) -> int:
    """Bytes per partition for all of ``weight``: at most ``part_bytes``, and so that there are no
    fewer partitions than cores."""
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    cores = table.sparkSession.sparkContext.defaultParallelism
    return max(min(part_bytes, -(-total // cores)), 1)


def numbered_parts(firsts: DataFrame) -> tuple[DataFrame, int]:
    """``firsts``, a row per partition with its first ``key``, with the partitions' numbers in key
    order as ``part``; and how many there are."""
    placed = with_position(firsts, ["key"], "_n")
    table = written(placed.withColumn("part", F.col("_n") - 1).drop("_n"), "bounds")
    return table, table.count()


def _last_at_most(found: Column, count: Column, key: Column) -> Column:
    """The index of the last of the sorted ``found`` that is not above ``key``, 0 if all are."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state.low + state.high, 1)
        right = F.struct((middle + 1).alias("low"), state.high.alias("high"))
        left = F.struct(state.low.alias("low"), middle.alias("high"))
        return (
            F.when(state.low >= state.high, state)
            .when(F.get(found, middle) <= key, right)
            .otherwise(left)
        )

    whole = F.struct(F.lit(0).alias("low"), count.cast("int").alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(count + 1)).cast("int") + 1)
    end = F.aggregate(steps, whole, halve, lambda state: state.low)
    return F.greatest(end - 1, F.lit(0))


def route(rows: DataFrame, key: Column, starts: DataFrame, parts: int, part: str) -> DataFrame:
    """Send each row to the partition of its ``key``. Adds the partition number as ``part``.

    ``starts`` (part, key) is a written table: partition ``part`` holds the keys from its ``key``
    up to the next start; keys before the first start go with it. There are ``parts`` of them. Rows
    look their stretch of parts up among at most ``COARSE`` constants,
    and the part within the stretch's list, so neither the driver nor a task holds all starts.
    """
    width = -(-parts // COARSE)
    staged = starts.withColumn("_stretch", whole_part(F.col("part"), F.lit(width)))
    firsts = staged.groupBy("_stretch").agg(F.min("key").alias("key")).orderBy("_stretch").collect()
    if not firsts:
        return rows.withColumn(part, F.lit(0)).repartitionById(1, F.col(part))
    # One constant each, folded once.
    keys = F.from_json(F.lit(json.dumps([r.key for r in firsts])), "array<string>")
    names = F.from_json(F.lit(json.dumps([r._stretch for r in firsts])), "array<bigint>")
    lists = staged.groupBy("_stretch").agg(F.sort_array(F.collect_list(F.struct("key", "part"))).alias("_list"))
    lists = lists.select("_stretch", F.col("_list.key").alias("_keys"), F.col("_list.part").alias("_parts"))
    lists = written(lists, "starts")
    small = measure(lists)[1]
    placed = rows.withColumn("_key", key)
    stretch = F.get(names, _last_at_most(keys, F.lit(len(firsts)), F.col("_key")))
    placed = placed.withColumn("_stretch", stretch).join(F.broadcast(lists) if small else lists, "_stretch")
    number = F.get("_parts", _last_at_most(F.col("_keys"), F.size("_keys"), F.col("_key")))
    numbered = placed.withColumn(part, number.cast("int"))
    return numbered.select(*rows.columns, part).repartitionById(parts, F.col(part))
