"""Filter, transform and render files as they arrive.

Rules, transforms and rendering are Columns of one row, so they run on a stream unchanged and
need no state or watermark. Order is a property of the whole document: a batch job sorts the
table of fragments when a document is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sheaf.operators import contents, filters, links, render
from sheaf.plans.assemble import Options, content_settings
from sheaf.plans.plugins import path_predicates
from sheaf.sources.document import write_document


def stream_fragments(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Content fragments of a stream of whole files ``(path, size, content, is_symlink)``, for link
    placeholders also ``link_target``.

    Path predicates see the files' own rows; a stream has none of directories. What needs other
    rows than a file's own raises: links read through or followed, content plugins, JSON.
    """
    options = options or Options()
    if options.symlinks not in ("skip", "placeholder"):
        raise ValueError(f"a stream cannot {options.symlinks} links")
    if options.content_plugins:
        raise ValueError("a stream cannot run content plugins")
    if options.format == "json":
        raise ValueError("a stream cannot write one JSON document")
    kept = filters.keep_entries(
        files.withColumn("is_directory", F.lit(False)),
        options.include,
        options.exclude,
        options.own_output,
    )
    caps = filters.within_caps(F.col("path"), options.max_depth, options.max_path_bytes)
    kept = kept.where(caps)
    for predicate in path_predicates(list(options.plugins)):
        kept = kept.where(F.coalesce(predicate(kept), F.lit(False)))
    if options.symlinks == "skip":
        kept = links.skip_links(kept)
    processed = contents.process_files(
        kept,
        max_file_bytes=options.max_file_bytes,
        link_placeholders=options.symlinks == "placeholder",
        **content_settings(options),
    )
    return render.content_fragments(processed, render.formatter_named(options.format))


def append_fragments(fragments: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each fragment exactly once to the parquet table at ``table``."""
    return (
        fragments.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def document_so_far(
    spark, table: str, path: str, entries: DataFrame, options: Options | None = None
) -> None:
    """Write what has arrived as one sorted document, with its heads and the listing of
    ``entries`` (path, is_directory, size), those that have arrived."""
    options = options or Options()
    formatter = render.formatter_named(options.format)
    frame = render.around(entries, formatter, options.show_size)
    write_document(frame.unionByName(spark.read.parquet(table)), path, entries)
