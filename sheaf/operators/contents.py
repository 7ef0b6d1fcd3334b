"""The content pass: what of each file's bytes goes into the document, and why not the rest.

A file is one row, or several block rows when it is large. Blocks hold whole chunks, so a block
is examined like a small file; only the number of the first refused block, a narrow value, has
to cross from one block of a file to another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.content import (
    BINARY_PLACEHOLDER,
    SKIP_BINARY,
    ChunkFunction,
    ContentRule,
    accepted,
    accepted_bytes,
    chunk_at,
    chunk_bytes,
    chunk_numbers,
    first_refused,
    link_placeholder,
    transform_chunks,
)
from sheaf.operators.filters import too_large
from sheaf.operators.skew import measure
from sheaf.session import written as table_of

OK = "ok"
EXCLUDED = "content_excluded"
TOO_LARGE = "too_large"
UNREADABLE = "unreadable"

BINARY_MODES = ("skip", "include", "placeholder")


def explode_chunks(files: DataFrame, empty: bool = False) -> DataFrame:
    """One row per chunk of ``content``: its number, offset and bytes; with ``empty`` also a row of
    NULLs per file without bytes."""
    step = chunk_bytes(F.col("size"))
    explode = F.explode_outer if empty else F.explode
    numbered = files.withColumn("chunk_no", explode(chunk_numbers(F.col("content"), step)))
    return numbered.withColumn("offset", F.col("chunk_no").cast("long") * step).withColumn(
        "content", chunk_at(F.col("content"), F.col("chunk_no"), step)
    )


def content_rules(binary: str, rules: Sequence[ContentRule] = ()) -> list[ContentRule]:
    """User rules with the built-in one for the binary mode; a refusal by any refuses."""
    if binary not in BINARY_MODES:
        raise ValueError(f"unknown binary mode: {binary!r}")
    return [SKIP_BINARY, *rules] if binary == "skip" else list(rules)


def _shown(
    content: Column,
    size: Column,
    hidden: Column | None,
    notice: Column,
    transforms: Sequence[ChunkFunction],
    written: ChunkFunction | None,
) -> dict[str, Column]:
    """``body`` as the document shows it and ``body_bytes`` before formatting.

    ``notice`` replaces the body where ``hidden``; a format's own chunk event comes last.
    """

    def body(event: ChunkFunction | None) -> Column:
        steps = [*transforms, event] if event else transforms
        result = transform_chunks(content, size, steps)
        if hidden is None:
            return result
        return F.when(hidden, event(notice) if event else notice).otherwise(result)

    # Without an event of the format the body is measured as it stands, not made once more.
    plain = body(None) if written else F.col("body")
    return {"body": body(written), "body_bytes": F.octet_length(plain).cast("long")}


def process_files(
    files: DataFrame,
    binary: str = "skip",
    rules: Sequence[ContentRule] = (),
    transforms: Sequence[ChunkFunction] = (),
    written: ChunkFunction | None = None,
    link_placeholders: bool = False,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """Add ``status``, ``input_bytes`` (accepted), ``body`` and ``body_bytes`` (emitted).

    Needs ``path``, ``size`` and ``content`` (NULL if it could not be read); with
    ``link_placeholders`` also ``is_symlink`` and ``link_target``. Narrow: no shuffle.
    """
    size, content, refused = F.col("size"), F.col("content"), F.col("_refused")
    judged = files.withColumn(
        "_refused", first_refused(content, size, content_rules(binary, rules))
    )
    status = (
        F.when(too_large(size, max_file_bytes), F.lit(TOO_LARGE))
        .when(content.isNull(), F.lit(UNREADABLE))
        .when(refused.isNotNull(), F.lit(EXCLUDED))
        .otherwise(F.lit(OK))
    )
    given, taken = accepted(content, size, refused), accepted_bytes(content, size, refused)
    hidden, notice = None, F.lit(BINARY_PLACEHOLDER.encode())
    if binary == "placeholder":
        hidden = first_refused(given, size, [SKIP_BINARY]).isNotNull()
    if link_placeholders:
        link = F.col("is_symlink")
        status = F.when(link, F.lit(OK)).otherwise(status)
        taken = F.when(link, F.lit(0)).otherwise(taken)
        shown = link_placeholder(F.col("link_target")).cast("binary")
        notice = F.when(link, shown).otherwise(notice)
        hidden = link if hidden is None else link | hidden
    emitted = _shown(given, size, hidden, notice, transforms, written)
    shows = F.col("status").isin(OK, EXCLUDED)
    return (
        judged.withColumn("status", status)
        .withColumn("input_bytes", F.when(shows, taken).otherwise(0).cast("long"))
        .withColumn("body", F.when(shows, emitted["body"]))
        .withColumn("body_bytes", F.when(shows, emitted["body_bytes"]))
        .drop("_refused")
    )


def process_blocks(
    blocks: DataFrame,
    binary: str = "skip",
    rules: Sequence[ContentRule] = (),
    transforms: Sequence[ChunkFunction] = (),
    written: ChunkFunction | None = None,
    one_block: bool = False,
) -> DataFrame:
    """The same for block rows ``(path, size, block_no, content)``, with ``code`` if some may have
    failed.

    Blocks behind a file's first refused block are dropped, that block keeps its accepted part. A
    file of which any block has a ``code`` is unreadable as a whole: its first block says so, with
    the code of the first failed block. With ``one_block`` every file is one block and nothing is
    shuffled. Otherwise the files that have a refused or failed block are found first; unless they
    are very many, they are broadcast, so that contents stay where they are read.
    """
    size, content = F.col("size"), F.col("content")

    def first(found: Column, value: Column) -> Column:
        """Where in its file something lies: block, then what is known of it there."""
        return F.when(found, F.struct(F.col("block_no"), value))

    refused = first_refused(content, size, content_rules(binary, rules))
    marks = {"_cut": first(refused.isNotNull(), refused.alias("chunk_no"))}
    if binary == "placeholder":
        nul = first_refused(content, size, [SKIP_BINARY])
        marks["_nul"] = first(nul.isNotNull(), nul.alias("chunk_no"))
    coded = "code" in blocks.columns
    if coded:
        marks["_bad"] = first(F.col("code").isNotNull(), F.col("code"))
    judged = blocks.withColumns({f"{name}_here": mark for name, mark in marks.items()})
    if one_block:
        joined = judged.withColumns({name: F.col(f"{name}_here") for name in marks})
    else:
        cuts = table_of(
            judged.where(" or ".join(f"{name}_here is not null" for name in marks))
            .groupBy(F.col("path").alias("_path"))
            .agg(*(F.min(f"{name}_here").alias(name) for name in marks)),
            "cuts",
        )
        _, small = measure(cuts)
        right = F.broadcast(cuts) if small else cuts
        joined = judged.join(right, F.col("path") == F.col("_path"), "left").drop("_path")
    at_cut = F.col("block_no") == F.col("_cut.block_no")
    given = accepted(content, size, F.when(at_cut, F.col("_cut.chunk_no")))
    hidden, notice = None, F.lit(BINARY_PLACEHOLDER.encode())
    if binary == "placeholder":
        hidden = F.col("_nul").isNotNull() & (
            F.col("_cut").isNull() | (F.col("_nul") < F.col("_cut"))
        )
    emitted = _shown(given, size, hidden, notice, transforms, written)
    if hidden is not None:
        # The notice stands once, in the file's first block.
        later = hidden & (F.col("block_no") > 0)
        emitted["body"] = F.when(later, F.lit(b"")).otherwise(emitted["body"])
        emitted["body_bytes"] = F.when(later, F.lit(0)).otherwise(emitted["body_bytes"])
    status = F.when(F.col("_cut").isNull(), OK).otherwise(EXCLUDED)
    shown = joined.where("_cut is null or block_no <= _cut.block_no")
    taken = F.octet_length(given).cast("long")
    if coded:
        bad = F.col("_bad").isNotNull()
        reason = F.col("_bad.code")
        failed = F.when(reason == TOO_LARGE, TOO_LARGE).otherwise(UNREADABLE)
        status = F.when(bad, failed).otherwise(status)
        shown = joined.where(
            "(_bad is null and (_cut is null or block_no <= _cut.block_no))"
            " or (_bad is not null and block_no = 0)"
        ).withColumn("code", F.when(bad, reason))
        taken = F.when(bad, F.lit(0)).otherwise(taken)
        emitted["body"] = F.when(~bad, emitted["body"])
        emitted["body_bytes"] = F.when(bad, F.lit(0)).otherwise(emitted["body_bytes"])
    return (
        shown.withColumn("status", status)
        .withColumn("input_bytes", taken.cast("long"))
        .withColumn("body", emitted["body"])
        .withColumn("body_bytes", emitted["body_bytes"].cast("long"))
        .drop(*marks, *(f"{name}_here" for name in marks))
    )
