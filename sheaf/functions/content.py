"""Column functions on file contents: chunk size, NUL detection, chunk rules, chunk transforms.

A content is examined chunk by chunk, because both the skip rule and user predicates see one
chunk at a time and a refused chunk ends the file. Nothing here explodes rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Read sizes, detection windows, limits and replacement texts.
SMALL_FILE = 4096
LARGE_FILE = 16384
BINARY_FLAG_WINDOW = 8192
BINARY_SKIP_WINDOW = 1024
BINARY_PLACEHOLDER = "// [Binary file content not displayed]\n"
LINK_PLACEHOLDER_HEAD = "// [Symbolic link to: "
LINK_PLACEHOLDER_TAIL = "]\n"
LINK_TOO_LONG = "// [Symbolic link - target too long]\n"
LINK_UNREADABLE = "// [Symbolic link - target unreadable]\n"
LINK_PLACEHOLDER_LIMIT = 2048

# Limits that a run may ask for. None applies by itself.
USUAL_LIMITS = {"max_file_bytes": 1 << 30, "max_depth": 256, "max_path_bytes": 4096, "max_hops": 40}

NUL = b"\x00"

ChunkFunction = Callable[[Column], Column]


@dataclass(frozen=True)
class ContentRule:
    """A predicate on a chunk: ``exclude`` refuses matches, ``include`` refuses the others."""

    kind: str
    match: ChunkFunction

    def __post_init__(self) -> None:
        if self.kind not in ("include", "exclude"):
            raise ValueError(f"unknown rule kind: {self.kind!r}")

    def refuses(self, chunk: Column) -> Column:
        hit = F.coalesce(self.match(chunk), F.lit(False))
        return hit if self.kind == "exclude" else ~hit


def chunk_bytes(size: Column) -> Column:
    """The read size for a file whose recorded size is ``size``."""
    return (
        F.when((size > 0) & (size < SMALL_FILE), size)
        .when(size < LARGE_FILE, F.lit(SMALL_FILE))
        .otherwise(F.lit(LARGE_FILE))
        .cast("int")
    )


def whole_part(n: Column, step: Column | int) -> Column:
    """How many whole ``step`` fit into ``n``, without rounding: what is divided is a multiple."""
    return ((n - n % step) / step).cast("long")


def chunk_count(content: Column, step: Column) -> Column:
    length = F.octet_length(content)
    return (whole_part(length, step) + (length % step > 0).cast("int")).cast("int")


def chunk_numbers(content: Column, step: Column) -> Column:
    """0, 1, ... for each chunk; empty for an empty content."""
    count = chunk_count(content, step)
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def chunk_at(content: Column, number: Column, step: Column) -> Column:
    return F.substring(content, number * step + 1, step)


def is_binary(content: Column) -> Column:
    """The entry attribute: a NUL in the first 8192 bytes."""
    return F.contains(F.substring(content, 1, BINARY_FLAG_WINDOW), F.lit(NUL))


def nul_in_window(chunk: Column) -> Column:
    """The skip rule's test of one chunk: a NUL in its first 1024 bytes."""
    return F.contains(F.substring(chunk, 1, BINARY_SKIP_WINDOW), F.lit(NUL))


SKIP_BINARY = ContentRule("exclude", nul_in_window)


def first_refused(content: Column, size: Column, rules: Sequence[ContentRule]) -> Column:
    """Number of the first chunk that any rule refuses, NULL if none is refused."""
    rules = list(rules)
    if not rules:
        return F.lit(None).cast("int")
    step = chunk_bytes(size)

    def refused(number: Column) -> Column:
        chunk = chunk_at(content, number, step)
        verdict = rules[0].refuses(chunk)
        for rule in rules[1:]:
            verdict = verdict | rule.refuses(chunk)
        return verdict

    found = F.array_min(F.filter(chunk_numbers(content, step), refused))
    if rules == [SKIP_BINARY]:
        # One scan settles the usual case: a text without any NUL has no refused chunk.
        return F.when(F.contains(content, F.lit(NUL)), found)
    return found


def accepted_bytes(content: Column, size: Column, refused: Column) -> Column:
    """How many bytes come before the refused chunk."""
    return F.when(refused.isNull(), F.octet_length(content)).otherwise(
        refused * chunk_bytes(size)
    ).cast("long")


def accepted(content: Column, size: Column, refused: Column) -> Column:
    """The bytes before the refused chunk, all of them if none is refused."""
    kept = F.substring(content, F.lit(1), refused * chunk_bytes(size))
    return F.when(refused.isNull(), content).otherwise(kept)


def transform_chunks(content: Column, size: Column, steps: Sequence[ChunkFunction]) -> Column:
    """Feed every chunk through ``steps`` and join the results.

    A step that yields NULL leaves its chunk unchanged.
    """
    if not steps:
        return content
    step = chunk_bytes(size)

    def chain(number: Column) -> Column:
        chunk = chunk_at(content, number, step)
        for function in steps:
            chunk = F.coalesce(function(chunk), chunk)
        return chunk.cast("string")

    # A binary cast to string keeps its bytes, and array_join copies each byte once.
    pieces = F.transform(chunk_numbers(content, step), chain)
    return F.array_join(pieces, "").cast("binary")


def link_placeholder(target: Column) -> Column:
    """The text shown instead of a link, by what is known of its target."""
    room = LINK_PLACEHOLDER_LIMIT - len(LINK_PLACEHOLDER_HEAD) - len(LINK_PLACEHOLDER_TAIL)
    return (
        F.when(target.isNull() | (F.octet_length(target) == 0), F.lit(LINK_UNREADABLE))
        .when(F.octet_length(target) >= room, F.lit(LINK_TOO_LONG))
        .otherwise(F.concat(F.lit(LINK_PLACEHOLDER_HEAD), target, F.lit(LINK_PLACEHOLDER_TAIL)))
    )
