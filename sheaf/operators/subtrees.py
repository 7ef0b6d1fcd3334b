"""Subtrees as intervals of the pre-order: what lies below a directory, without its ancestors.

In pre-order a directory is followed by all that is below it. So its subtree is the stretch between
its own row and the first row behind it, which a second row per directory marks. Both are placed by
one ordered table, however deep the tree is: rows grow with entries, not with entries times depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import LOWEST, order_key
from sheaf.operators.ordering import ordered_table, with_total
from sheaf.session import written

#: Sorts behind everything below a directory, and before every sibling behind it.
_BEHIND = "\x01"
_END, _ENTRY = 0, 1


def _marked(entries: DataFrame) -> DataFrame:
    """(path, is_directory, key, kind, one, bytes): entries, and for each directory the end of its subtree.

    Only entries count: one file, and its bytes.
    """
    file = F.col("path").isNotNull() & ~F.col("is_directory")
    rows = entries.where("path is not null").select(
        "path",
        "is_directory",
        order_key(F.col("path")).alias("key"),
        F.lit(_ENTRY).alias("kind"),
        F.lit(1).cast("long").alias("one"),
        file.cast("long").alias("file"),
        F.when(file, F.coalesce("size", F.lit(0))).otherwise(0).cast("long").alias("bytes"),
    )
    zero = F.lit(0).cast("long")
    ends = rows.where("is_directory").select(
        "path",
        "is_directory",
        F.concat("key", F.lit(_BEHIND)).alias("key"),
        F.lit(_END).alias("kind"),
        zero.alias("one"),
        zero.alias("file"),
        zero.alias("bytes"),
    )
    return rows.unionByName(ends)


def _totals(entries: DataFrame, **weights: str) -> DataFrame:
    """Marked rows with the sum of each weight over all rows before, under the given names."""
    table = ordered_table(_marked(entries), ["key", "kind"])
    for name, weight in weights.items():
        table = with_total(table, weight).withColumnRenamed("total", name)
    return table


def nested_sets(entries: DataFrame) -> DataFrame:
    """(path, is_directory, enter, leave): an entry lies below a directory if its ``enter`` is larger
    than the directory's and less than its ``leave``.

    ``entries`` (path, is_directory, size) with unique paths; rows without a path are left out.
    Numbers are from 1 in pre-order; a file leaves at the next number.
    """
    table = _totals(entries, position="one")
    own = F.max(F.when(F.col("kind") == _ENTRY, F.col("position") + 1))
    behind = F.max(F.when(F.col("kind") == _END, F.col("position") + 1))
    return table.groupBy("path", "is_directory").agg(own.alias("enter"), F.coalesce(behind, own + 1).alias("leave"))


def subtree_sizes(entries: DataFrame) -> DataFrame:
    """(path, files, bytes) below each directory, at any depth.

    ``entries`` as in ``nested_sets``; directories themselves have no bytes, and a file of unknown
    size counts none. The last row is the whole tree, with an empty path; an empty table has none.
    """
    table = written(_totals(entries, files_before="file", bytes_before="bytes"), "subtree-totals")

    def below(before: str, own: str):
        inside = F.when(F.col("kind") == _END, F.col(before)).otherwise(-F.col(before) - F.col(own))
        return F.sum(inside).cast("long")

    sizes = table.where("is_directory").groupBy("path").agg(
        below("files_before", "file").alias("files"), below("bytes_before", "bytes").alias("bytes")
    )
    whole = table.agg(F.sum("file").alias("files"), F.sum("bytes").alias("bytes")).where("files is not null")
    return sizes.unionByName(whole.select(F.lit("").alias("path"), "files", "bytes"))


assert LOWEST < _BEHIND
