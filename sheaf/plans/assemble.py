"""A whole run: from a directory tree or entry and content tables to document, statistics and
diagnostics. Entries, and what links and predicates decide, are written as tables on the way; the
contents are read when a sink or a counter asks for them."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.content import ChunkFunction, ContentRule, link_placeholder
from sheaf.operators import contents, filters, links, render, stats
from sheaf.operators.json_blocks import json_block_document
from sheaf.operators.skew import lookup_join
from sheaf.plans.plugins import (
    ContentPlugin,
    FilterPlugin,
    chunk_rules,
    chunk_transforms,
    path_predicates,
    run_content_plugins,
)
from sheaf.session import drop_written, written
from sheaf.sources import filetree
from sheaf.sources.document import write_document

LINK_MODES = ("skip", "follow", "include", "placeholder")


@dataclass(frozen=True)
class Options:
    """What to keep and how to show it. Limits that are None do not apply."""

    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    binary: str = "skip"
    symlinks: str = "skip"
    show_size: bool = False
    format: str = "text"
    plugins: Sequence[FilterPlugin] = ()
    rules: Sequence[ContentRule] = ()
    content_plugins: Sequence[ContentPlugin] = ()
    max_file_bytes: int | None = None
    max_depth: int | None = None
    max_path_bytes: int | None = None
    max_hops: int | None = None
    #: Set if links hold targets as the file system gives them: relative to the link, or absolute
    #: below this folder. None: targets are paths of the table.
    link_root: str | None = None
    block_bytes: int = filetree.BLOCK_BYTES
    own_output: Sequence[str] = field(default=())

    def __post_init__(self) -> None:
        if self.symlinks not in LINK_MODES:
            raise ValueError(f"unknown symlink mode: {self.symlinks!r}")
        if self.binary not in contents.BINARY_MODES:
            raise ValueError(f"unknown binary mode: {self.binary!r}")
        if self.format != "json":
            formatter = render.formatter_named(self.format)
            if self.content_plugins and render.chunk_event(formatter):
                raise ValueError("a format with a chunk event cannot follow content plugins")


@dataclass(frozen=True)
class Run:
    entries: DataFrame  # kept entries, directories included
    processed: DataFrame  # per file or block: status, accepted bytes, body
    diagnostics: DataFrame
    options: Options

    @property
    def fragments(self) -> DataFrame:
        """The document, unsorted."""
        return _fragments(self.entries, self.processed, self.options)

    def stats(self) -> DataFrame:
        """One row of counters."""
        return stats.run_stats(self.processed)

    def write(self, path: str) -> dict:
        """Write the document, see ``write_document``, and report on the run.

        The counters come from the same pass over the contents that writes them.
        """
        started = time.monotonic()
        watched, report = stats.observed(self.processed)
        write_document(_fragments(self.entries, watched, self.options), path, self.entries)
        return report.get | {"seconds": time.monotonic() - started}

    def drop(self) -> None:
        """Delete the intermediate tables of this application, when no run of it is needed."""
        drop_written(self.entries.sparkSession)


def select_by_row(entries: DataFrame, options: Options) -> DataFrame:
    """What an entry's own row decides: globs, with pruning by path, caps, links."""
    kept = filters.keep_entries(entries, options.include, options.exclude, options.own_output)
    kept = kept.where(filters.within_caps(F.col("path"), options.max_depth, options.max_path_bytes))
    return links.skip_links(kept) if options.symlinks == "skip" else kept


def select_entries(entries: DataFrame, options: Options) -> DataFrame:
    """All path rules; user predicates last, as a refused directory hides all below it."""
    predicates = path_predicates(list(options.plugins))
    return filters.keep_by_predicates(select_by_row(entries, options), predicates)


def content_settings(options: Options) -> dict:
    """The keyword arguments of the content pass."""
    plugins = list(options.plugins)
    formatter = None if options.format == "json" else render.formatter_named(options.format)
    return {
        "written": render.chunk_event(formatter) if formatter else None,
        "binary": options.binary,
        "rules": [*options.rules, *chunk_rules(plugins)],
        "transforms": chunk_transforms(plugins),
    }


def _fragments(entries: DataFrame, processed: DataFrame, options: Options) -> DataFrame:
    if options.format == "json":
        if "block_no" in processed.columns:
            return json_block_document(entries, processed)
        return render.json_document(entries, processed)
    formatter = render.formatter_named(options.format)
    return render.document(entries, processed, formatter, options.show_size)


def _processed(files: DataFrame, options: Options) -> DataFrame:
    processed = contents.process_files(
        files,
        max_file_bytes=options.max_file_bytes,
        link_placeholders=options.symlinks == "placeholder",
        **content_settings(options),
    )
    return run_content_plugins(processed, options.content_plugins)


def assemble_tables(
    entries: DataFrame, file_contents: DataFrame, options: Options | None = None
) -> Run:
    """From ``entries`` (path, is_directory, is_symlink, size, link_target) and contents
    ``(path, content)``."""
    options = options or Options()
    if options.link_root is not None and options.symlinks in ("follow", "include"):
        entries = links.placed_targets(entries, options.link_root)
    source = entries
    found = stats.listing_diagnostics(entries, options.max_depth, options.max_path_bytes)
    if options.symlinks == "follow":
        resolved = links.resolve_links(entries, options.max_hops)
        followed = links.follow_links(
            entries, options.max_depth, resolved, options.max_path_bytes
        )
        found = found.unionByName(links.link_diagnostics(followed, resolved))
        source = followed
    kept = select_entries(source, options)
    if options.symlinks == "follow":
        files = _followed_contents(kept, resolved, file_contents)
    elif options.symlinks == "include":
        files = links.contents_through_links(kept, entries, file_contents, options.max_hops)
    else:
        files = kept.where("not is_directory").join(file_contents, "path", "left")
    processed = _processed(files, options)
    found = found.unionByName(stats.content_diagnostics(processed))
    return Run(kept, processed, found, options)


def assemble_corpus(files: DataFrame, options: Options | None = None) -> Run:
    """From a corpus table ``(path, size, content, is_symlink, link_target)``, one row per file.

    Directories are those the paths imply. Rules that a row decides run on the content rows
    themselves, so contents are not joined to anything unless links are read through or user
    predicates apply.
    """
    options = options or Options()
    listed = files.select(
        "path", F.lit(False).alias("is_directory"), "is_symlink", "size", "link_target"
    )
    implied = filters.directories_of(files).select(
        "path",
        F.lit(True).alias("is_directory"),
        F.lit(False).alias("is_symlink"),
        F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("string").alias("link_target"),
    )
    entries = written(listed.unionByName(implied), "entries")
    if options.symlinks in ("follow", "include"):
        return assemble_tables(entries, files.select("path", "content"), options)
    kept = select_entries(entries, options)
    if path_predicates(list(options.plugins)):
        taken = files.join(kept.select("path"), "path", "left_semi")
    else:
        taken = select_by_row(files.withColumn("is_directory", F.lit(False)), options)
    processed = _processed(taken, options)
    found = stats.listing_diagnostics(
        entries, options.max_depth, options.max_path_bytes
    ).unionByName(stats.content_diagnostics(processed))
    return Run(kept, processed, found, options)


def _followed_contents(
    kept: DataFrame, resolved: DataFrame, file_contents: DataFrame
) -> DataFrame:
    """A followed file's content is that of its physical path, or of that path's link target."""
    ends = resolved.where("target is not null").select(
        F.col("path").alias("physical_path"), F.col("target").alias("_end")
    )
    files = kept.where("not is_directory")
    # A file below a much-followed directory occurs once per way to it, hence the lookups.
    seen = lookup_join(files, ends, "physical_path", "left")
    keyed = seen.withColumn("_from", F.coalesce("_end", "physical_path")).drop("_end")
    sources = file_contents.select(F.col("path").alias("_from"), "content")
    return lookup_join(keyed, sources, "_from", "left").drop("_from")


def assemble_tree(
    spark: SparkSession, root: str, options: Options | None = None, output: str | None = None
) -> Run:
    """From a directory tree; ``output`` is where the document will be written, kept out of it."""
    options = options or Options()
    own = filters.self_output_patterns(
        os.path.abspath(root), os.path.abspath(output) if output else None
    )
    listed, found = filetree.read_tree(
        spark,
        root,
        exclude=[*own, *options.exclude],
        include=options.include,
        follow=options.symlinks == "follow",
        max_depth=options.max_depth,
        max_path_bytes=options.max_path_bytes,
    )
    kept = select_entries(listed, options)
    readable = links.skip_links(kept) if options.symlinks == "placeholder" else kept
    processed = _tree_contents(readable, root, options)
    if options.symlinks == "placeholder":
        processed = processed.unionByName(_placeholders(kept, content_settings(options)["written"]))
    if options.content_plugins:
        processed = run_content_plugins(processed, options.content_plugins, options.block_bytes)
    # What failed is known from the reads themselves.
    return Run(kept, processed, found.unionByName(stats.content_diagnostics(processed)), options)


def _tree_contents(entries: DataFrame, root: str, options: Options) -> DataFrame:
    """Files of one block are processed where they are read; only those of several blocks, if
    there are any, need to know of each other's blocks."""
    sized = filetree.with_blocks(entries.where("not is_directory"), options.block_bytes)
    large = filters.too_large(F.col("size"), options.max_file_bytes)
    several = sized.where((F.col("blocks") > 1) & ~large)
    if several.isEmpty():
        return process_tree_blocks(_blocks(entries, root, options), options, one_block=True)
    rest = sized.where((F.col("blocks") == 1) | large)
    single = process_tree_blocks(_blocks(rest, root, options), options, one_block=True)
    return single.unionByName(process_tree_blocks(_blocks(several, root, options), options))


def _blocks(files: DataFrame, root: str, options: Options) -> DataFrame:
    return filetree.read_blocks(files, root, options.block_bytes, options.max_file_bytes)


def process_tree_blocks(
    blocks: DataFrame, options: Options, one_block: bool = False
) -> DataFrame:
    """Processed blocks; a file of which any block could not be read is unreadable as a whole."""
    processed = contents.process_blocks(blocks, one_block=one_block, **content_settings(options))
    return processed.select(*BLOCK_COLUMNS)


BLOCK_COLUMNS = ["path", "size", "block_no", "blocks", "status", "code", "input_bytes", "body", "body_bytes"]


def _placeholders(kept: DataFrame, written: ChunkFunction | None) -> DataFrame:
    notice = link_placeholder(F.col("link_target")).cast("binary")
    return kept.where("is_symlink").select(
        "path",
        "size",
        F.lit(0).alias("block_no"),
        F.lit(1).alias("blocks"),
        F.lit(contents.OK).alias("status"),
        F.lit(None).cast("string").alias("code"),
        F.lit(0).cast("long").alias("input_bytes"),
        (written(notice) if written else notice).alias("body"),
        F.octet_length(notice).cast("long").alias("body_bytes"),
    )
