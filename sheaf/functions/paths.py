"""Column functions on entry paths, sizes and mode bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type field of a POSIX mode.
MODE_TYPE_MASK = 0xF000
MODE_DIRECTORY = 0x4000
MODE_REGULAR = 0x8000
MODE_SYMLINK = 0xA000

SEPARATOR = "/"
# Sorts below every byte that can occur in a path.
LOWEST = "\x00"


def basename(path: Column) -> Column:
    """What follows the last ``/`` or ``\\``; empty after a trailing separator."""
    return F.substring_index(F.translate(path, "\\", SEPARATOR), SEPARATOR, -1)


def parent(path: Column) -> Column:
    """The containing directory, empty for an entry at the root."""
    cut = F.length(path) - F.length(F.substring_index(path, SEPARATOR, -1))
    return F.when(cut > 0, F.substring(path, F.lit(1), cut - 1)).otherwise("")


def join_path(directory: Column, name: Column) -> Column:
    return F.concat_ws(SEPARATOR, F.nullif(directory, F.lit("")), name)


def normalize_path(path: Column) -> Column:
    """``path`` without empty and ``.`` segments, each ``..`` taking back the segment before it.

    By its text alone, relative to the top; the top itself is empty, and what leads above it NULL.
    """
    none = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1))
        further = F.concat(kept, F.array(segment))
        return F.when(segment.isin("", "."), kept).when(segment == "..", up).otherwise(further)

    return F.aggregate(F.split(path, SEPARATOR), none, step, lambda kept: F.array_join(kept, SEPARATOR))


def target_path(path: Column, target: Column, root: str | None = None) -> Column:
    """Where the link at ``path`` leads, as a path of the same table, or NULL if that is outside of it.

    ``target`` is what the link holds: relative to the link's directory, or absolute, which leads
    into the table only below ``root``. A ``..`` takes back the segment written before it, also
    where that segment is itself a link.
    """
    relative = normalize_path(F.concat_ws(SEPARATOR, parent(path), target))
    absolute = F.lit(None).cast("string")
    if root is not None:
        top = F.concat(F.lit(SEPARATOR), normalize_path(F.lit(root)))
        absolute = relative_path(top, F.concat(F.lit(SEPARATOR), normalize_path(target)))
    return F.when(target.isNotNull(), F.when(F.startswith(target, F.lit(SEPARATOR)), absolute).otherwise(relative))


def relative_path(base: Column, target: Column) -> Column:
    """``target`` below ``base``, or NULL; both absolute."""
    prefix = F.when(F.endswith(base, F.lit(SEPARATOR)), base).otherwise(
        F.concat(base, F.lit(SEPARATOR))
    )
    rest = F.substring(target, F.length(prefix) + 1, F.length(target))
    return F.when(F.startswith(target, prefix), rest)


def level(path: Column) -> Column:
    """Depth of the containing directory; an entry at the root has level 0."""
    return (F.length(path) - F.length(F.replace(path, F.lit(SEPARATOR), F.lit("")))).cast("int")


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, outermost first."""
    parts = F.split(path, SEPARATOR)
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEPARATOR))


def order_key(path: Column) -> Column:
    """A string whose order is pre-order: a directory, then all below it, then the next sibling."""
    return F.replace(path, F.lit(SEPARATOR), F.lit(LOWEST))


def size_kb(size: Column) -> Column:
    """Kilobytes, rounded up: 0 for an empty file only."""
    return F.shiftright(size + 1023, 10).cast("long")


def byte_size(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def normalize_pattern(pattern: Column) -> Column:
    return F.btrim(pattern, F.lit(" \t"))


def mode_is(mode: Column, kind: int) -> Column:
    return mode.bitwiseAND(MODE_TYPE_MASK) == kind


def mode_bits(mode: Column) -> Column:
    return mode.bitwiseAND(0o7777)
