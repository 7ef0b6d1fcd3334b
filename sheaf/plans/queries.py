"""The registered queries: one per operator, each over a whole given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import content as C
from sheaf.functions import paths as P
from sheaf.operators import contents, filters, links, render, stats
from sheaf.operators.json_blocks import json_blocks
from sheaf.operators.ordering import with_position
from sheaf.operators.subtrees import nested_sets, subtree_sizes as sizes_below
from sheaf.plans import fixtures, plugins
from sheaf.plans.assemble import Options, assemble_corpus, assemble_tables
from sheaf.session import written
from sheaf.sources.index import document_index as index_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Small enough that the test tables exercise them.
SMALL_CAP = 8000
SHALLOW = 3
SHORT_VOLUME = 64 << 10
SHORT_BLOCK = 101
OWN_ROOT, OWN_OUTPUT = "/corpus", "/corpus/out/doc_?7.md"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def digest(text: Column) -> list[Column]:
    """Bytes cannot be compared as text when a chunk boundary splits a character."""
    return [F.md5(text).alias("md5"), F.octet_length(text).cast("long").alias("bytes")]


def entries_of(files: DataFrame) -> DataFrame:
    """Files and the directories their paths imply."""
    rows = files.select("path", "is_directory", "size")
    directories = filters.directories_of(files).select(
        "path", F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size")
    )
    return rows.unionByName(directories)


def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.skip_links(fixtures.corpus(spark, sf_dir))


def kept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(kept_files(spark, sf_dir))


# Scalar functions


@query
def path_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    raw = (
        F.when(n % 3 == 0, F.translate("path", "/", "\\"))
        .when(n % 10 == 1, F.concat("path", F.lit("/")))
        .otherwise(F.col("path"))
    )
    named = fixtures.corpus(spark, sf_dir).select("doc_id", raw.alias("path"))
    return named.withColumn("name", P.basename(F.col("path")))


@query
def path_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("/data/"), "source")
    target = F.concat(F.lit("/data/"), "path")
    return fixtures.corpus(spark, sf_dir).select(
        "doc_id", base.alias("base"), P.relative_path(base, target).alias("relative")
    )


@query
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.element_at(F.array(*map(F.lit, ("/./", "//", "/x/../", "/../", "/../../", "/", "/a/b/../../..//"))), (F.col("doc_id") % 7 + 1).cast("int"))
    raw = F.concat("source", way, "path", F.when(F.col("doc_id") % 3 == 0, "/..").otherwise("/."))
    return fixtures.corpus(spark, sf_dir).select("doc_id", raw.alias("raw"), P.normalize_path(raw).alias("normalized"))


@query
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = F.when(F.col("doc_id") % 10 == 0, "").otherwise(P.parent(F.col("path")))
    return fixtures.corpus(spark, sf_dir).select(
        "doc_id", P.join_path(directory, P.basename(F.col("path"))).alias("joined")
    )


@query
def path_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pages(spark, sf_dir).select(
        "page_id", "path", P.level(F.col("path")).alias("level")
    )


@query
def size_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.corpus(spark, sf_dir).select(
        "doc_id", "size", P.size_kb(F.col("size")).alias("kb")
    )


@query
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id",
        P.byte_size(F.col("text")).alias("bytes"),
        F.length("text").cast("long").alias("characters"),
    )


@query
def is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.corpus(spark, sf_dir).select(
        "doc_id", C.is_binary(F.col("content")).alias("is_binary")
    )


@query
def pattern_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.concat(
        F.repeat(F.lit(" "), (n % 3).cast("int")),
        F.when(n % 4 == 0, "\t").otherwise(""),
        F.lit("* "),
        "source",
        F.repeat(F.lit(" \t"), (n % 2).cast("int")),
    )
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", P.normalize_pattern(raw).alias("pattern")
    )


# Sources


@query
def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pages(spark, sf_dir).select("path", "size", F.md5("content").alias("md5"))


@query
def corpus_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.conversations(spark, sf_dir)
    return rows.select("path", "size", F.md5("content").alias("md5"))


@query
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.directories_of(fixtures.corpus(spark, sf_dir))


@query
def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes_below(entries_of(fixtures.corpus(spark, sf_dir)))


@query
def subtree_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_sets(entries_of(fixtures.corpus(spark, sf_dir)))


@query
def page_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.directories_of(fixtures.pages(spark, sf_dir))


@query
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contents.explode_chunks(fixtures.corpus(spark, sf_dir))
    return rows.select("path", "chunk_no", "offset", *digest(F.col("content")))


# Filters


@query
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = [*fixtures.INCLUDE, *filters.trimmed(fixtures.EXCLUDE), "*/DE/doc_*[!02468].?"]
    patterns = spark.createDataFrame(list(enumerate(globs)), fixtures.PATTERNS)
    return filters.match_patterns(fixtures.corpus(spark, sf_dir).select("path"), patterns)


@query
def include_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    return filters.keep_entries(entries, include=fixtures.INCLUDE).select("path", "is_directory")


@query
def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    kept = filters.keep_entries(entries, exclude=fixtures.EXCLUDE, prune=False)
    return kept.select("path", "is_directory")


@query
def include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    kept = filters.keep_entries(entries, fixtures.INCLUDE, fixtures.EXCLUDE, prune=False)
    return kept.select("path", "is_directory")


@query
def prune_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    return filters.keep_entries(entries, exclude=fixtures.EXCLUDE).select("path", "is_directory")


@query
def self_output_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = filters.self_output_patterns(OWN_ROOT, OWN_OUTPUT)
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    return filters.keep_entries(entries, own_output=own).select("path", "is_directory")


@query
def symlink_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_files(spark, sf_dir).select("path", "size")


@query
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = contents.process_files(kept_files(spark, sf_dir), max_file_bytes=SMALL_CAP)
    text = render.file_text(render.TextFormatter())
    return processed.select("path", "size", "status", *digest(text))


@query
def depth_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    return entries.where(filters.within_caps(F.col("path"), SHALLOW)).select("path", "is_directory")


def _not_french(entries: DataFrame) -> Column:
    """A user predicate on entries: it hides whole directories and single files."""
    hidden = F.col("is_directory") & (P.basename(F.col("path")) == "fr")
    return ~hidden & (F.col("is_directory") | (F.col("size") % 3 != 0))


@query
def plugin_path_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(fixtures.corpus(spark, sf_dir))
    plugin = plugins.register_filter("not_french", path=_not_french)
    kept = filters.keep_by_predicates(entries, plugins.path_predicates([plugin]))
    return kept.select("path", "is_directory")


# Content rules and transforms


def _processed(files: DataFrame, **settings) -> DataFrame:
    processed = contents.process_files(files, **settings)
    return processed.select("path", "status", "input_bytes", *digest(F.col("body")))


@query
def binary_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(fixtures.corpus(spark, sf_dir))


@query
def binary_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(fixtures.corpus(spark, sf_dir), binary="include")


@query
def binary_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(fixtures.corpus(spark, sf_dir), binary="placeholder")


@query
def plugin_content_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plugin = plugins.register_filter(
        "no_letter", content=lambda chunk: ~F.contains(chunk, F.lit(b"zz"))
    )
    rules = plugins.chunk_rules([plugin])
    return _processed(fixtures.corpus(spark, sf_dir), binary="include", rules=rules)


@query
def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        C.ContentRule("exclude", lambda chunk: F.contains(chunk, F.lit(b"@"))),
        C.ContentRule("include", lambda chunk: F.contains(chunk, F.lit(b"th"))),
    ]
    return _processed(fixtures.corpus(spark, sf_dir), binary="include", rules=rules)


@query
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plugin = plugins.register_filter(
        "marked", transform=lambda chunk: F.concat(F.lit(b"<"), chunk, F.lit(b">"))
    )
    steps = [
        *plugins.chunk_transforms([plugin]),
        # Gives nothing for a short chunk, which so stays as it is.
        lambda chunk: F.when(F.octet_length(chunk) > 1000, F.substring(chunk, 1, 1000)),
        lambda chunk: F.concat(chunk, F.lit(b"\n")),
    ]
    return _processed(fixtures.corpus(spark, sf_dir), transforms=steps)


@query
def symlink_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, target = F.col("doc_id"), F.col("link_target")
    # Every case: a usual target, one too long to show, one that cannot be read.
    shown = F.when(n % 5 == 0, F.repeat(target, 200)).when(n % 5 != 1, target)
    files = fixtures.linked_corpus(spark, sf_dir).withColumn("link_target", shown)
    return _processed(files, link_placeholders=True)


@query
def symlink_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = written(fixtures.link_entries(spark, sf_dir), "entries")
    sources = links.skip_links(fixtures.corpus(spark, sf_dir)).select("path", "content")
    files = links.contents_through_links(entries, entries, sources)
    processed = contents.process_files(files)
    return processed.select(
        "path", "is_symlink", "size", "status", "input_bytes", *digest(F.col("body"))
    )


# Rendering


def _positioned(rows: DataFrame) -> DataFrame:
    """Rows with ``path`` and what they show, and their place in the listing."""
    keyed = rows.withColumn("order_key", P.order_key(F.col("path")))
    return with_position(keyed, ["order_key"]).drop("order_key")


@query
def dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positioned(entries_of(fixtures.corpus(spark, sf_dir)).select("path"))


@query
def structure_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = kept_entries(spark, sf_dir)
    kept = filters.keep_entries(entries, fixtures.INCLUDE, fixtures.EXCLUDE)
    return _positioned(render.structure_lines(kept).select("path", "text"))


@query
def structure_listing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = kept_entries(spark, sf_dir)
    return _positioned(render.structure_lines(entries, show_size=True).select("path", "text"))


@query
def file_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each row has its content: nothing is joined.
    processed = contents.process_files(kept_files(spark, sf_dir))
    text = render.file_text(render.TextFormatter())
    return processed.select("path", "status", *digest(text))


def _whole_document(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    files = kept_files(spark, sf_dir).withColumn("link_target", F.lit(None).cast("string"))
    run = assemble_corpus(files, options)
    # Digests first: no text crosses between tasks to get its position.
    shown = run.fragments.select("section", "order_key", *digest(F.col("text")))
    placed = render.with_document_position(shown, run.entries)
    return placed.select("section", "position", "md5", "bytes")


@query
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Options(include=fixtures.INCLUDE, exclude=fixtures.EXCLUDE, show_size=True)
    return _whole_document(spark, sf_dir, options)


@query
def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every fragment of ``render_text``'s document lies in it."""
    files = kept_files(spark, sf_dir).withColumn("link_target", F.lit(None).cast("string"))
    options = Options(include=fixtures.INCLUDE, exclude=fixtures.EXCLUDE, show_size=True)
    return index_of(assemble_corpus(files, options).fragments).drop("block_no")


class MarkdownFormatter(render.Formatter):
    """A format of a user's own: every event writes something."""

    name = "markdown"
    begin_document = "# Corpus\n\n"
    begin_structure = "## Files\n\n"
    end_structure = "\n"
    begin_content = "## Contents\n\n"
    end_content = "----\n"
    end_document = "end\n"

    def directory(self, path: Column, depth: Column) -> Column:
        return F.concat(F.lit("- **"), path, F.lit("**\n"))

    def entry(self, path: Column, depth: Column, size: Column, show_size: bool) -> Column:
        return F.concat(F.lit("- "), path, F.lit(" at "), depth.cast("string"), F.lit("\n"))

    def header(self, path: Column, size: Column) -> Column:
        return F.concat(F.lit("### "), path, F.lit(" "), size.cast("string"), F.lit("\n"))

    def chunk(self, body: Column) -> Column:
        return F.concat(F.lit(b"~~~\n"), body, F.lit(b"\n~~~\n"))

    def footer(self) -> Column:
        return F.lit("\n")


@query
def custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    render.register_formatter(MarkdownFormatter())
    return _whole_document(spark, sf_dir, Options(binary="placeholder", format="markdown"))


@query
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.json_files(contents.process_files(kept_files(spark, sf_dir)))
    parsed = F.from_json("json", "path string, size bigint, content string, encoding string")
    return rows.select(parsed.alias("j")).select("j.*")


@query
def render_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from block rows; only this comparison puts a file's texts together."""
    files = contents.process_files(kept_files(spark, sf_dir)).select("path", "size", "body")
    count = F.greatest(F.ceil(F.octet_length("body") / SHORT_BLOCK), F.lit(1))
    blocks = files.withColumn("block_no", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    piece = F.substring(F.col("body"), F.col("block_no") * SHORT_BLOCK + 1, F.lit(SHORT_BLOCK))
    made = json_blocks(blocks.withColumn("body", piece))
    rows = made.groupBy("path").agg(F.expr("listagg(json, '') within group (order by block_no)").alias("json"))
    parsed = F.from_json("json", "path string, size bigint, content string, encoding string")
    return rows.select(parsed.alias("j")).select("j.*")


@query
def bundle_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = kept_files(spark, sf_dir)
    processed = contents.process_files(files)
    volumes = render.bundles(files, processed, "source", volume_bytes=SHORT_VOLUME)
    return volumes.select("source", "volume", "files", *digest(F.col("text")))


@query
def bundle_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.conversations(spark, sf_dir)
    processed = contents.process_files(files)
    volumes = render.bundles(files, processed, "conv_id", volume_bytes=1 << 10)
    return volumes.select("conv_id", "volume", "files", F.col("text").cast("string").alias("text"))


# Links


@query
def symlink_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = links.follow_links(written(fixtures.link_tree(spark, sf_dir), "entries"))
    depth = P.level(F.col("path")).alias("level")
    return followed.select("path", "is_directory", "is_symlink", "size", depth)


@query
def symlink_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links followed whose targets are relative to the link, or absolute."""
    placed = links.placed_targets(fixtures.relative_link_tree(spark, sf_dir), fixtures.MOUNT)
    followed = links.follow_links(written(placed, "entries"))
    return followed.select("path", "physical_path", "is_directory", "is_symlink", "size", "is_cycle")


@query
def symlink_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = links.follow_links(written(fixtures.link_tree(spark, sf_dir), "entries"))
    return followed.where("is_cycle").select("path", "physical_path")


# Statistics and diagnostics


@query
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = contents.process_files(
        kept_files(spark, sf_dir),
        max_file_bytes=SMALL_CAP,
        transforms=[lambda chunk: F.concat(chunk, F.lit(b"\n"))],
    )
    return stats.run_stats(processed)


@query
def progress_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.progress_by_file(contents.process_files(kept_files(spark, sf_dir)))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries too deep, files too large, and links read through that lead nowhere."""
    entries = written(fixtures.link_entries(spark, sf_dir), "entries")
    sources = links.skip_links(fixtures.corpus(spark, sf_dir)).select("path", "content")
    options = Options(symlinks="include", max_file_bytes=SMALL_CAP, max_depth=SHALLOW)
    return assemble_tables(entries, sources, options).diagnostics


@query
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnostics(spark, sf_dir).select("path", "code", "message")


@query
def link_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = written(fixtures.link_tree(spark, sf_dir), "entries")
    resolved = links.resolve_links(tree)
    return links.link_diagnostics(links.follow_links(tree, resolved=resolved), resolved)


@query
def diagnostic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.diagnostic_counts(_diagnostics(spark, sf_dir))


@query
def content_plugin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers through a whole run, as a content plugin of its options."""
    files = kept_files(spark, sf_dir).withColumn("link_target", F.lit(None).cast("string"))
    options = Options(binary="include", content_plugins=[plugins.LineNumbers()])
    processed = assemble_corpus(files, options).processed
    return processed.select("path", "status", "input_bytes", *digest(F.col("body")))
