"""Corpora derived from the given tables: rows that already are paths and contents.

The tables hold no paths, NULs or links, so these are derived from ids by fixed rules. Every
corpus is a lazy DataFrame over its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERNS = "pattern_id int, pattern string"

# The rules that derive paths and bytes.
EXTENSIONS = [".txt", ".md", ".c", ".h", ".log", ".PY"]
INCLUDE = ["*.c", "*.h", "*.py", "src0/*", "doc_1?.txt"]
EXCLUDE = [".git", "build", "*.log", "  *.tmp ", "doc_[0-4].md", ""]
NUL = b"\x00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path(doc_id: Column, source: Column, lang: Column, stem: Column | str = "doc_") -> Column:
    top = (
        F.when(doc_id % 29 == 0, ".git/")
        .when(doc_id % 7 == 0, "src/")
        .when(doc_id % 5 == 0, "build/")
        .otherwise("")
    )
    names = F.array(*(F.lit(e) for e in EXTENSIONS))
    extension = F.get(names, (doc_id % len(EXTENSIONS)).cast("int"))
    stem = F.lit(stem) if isinstance(stem, str) else stem
    return F.concat(top, source, F.lit("/"), lang, F.lit("/"), stem, doc_id, extension)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``(doc_id, source, lang, path, content, size, is_symlink, is_directory)``.

    Every document with its whole text. Beside some of them stand further files: an empty one, one
    with a NUL before or behind the text, and a link (a row of its own, whose content is the text).
    """
    n = F.col("doc_id")
    stems = F.array_compact(
        F.array(
            F.lit("doc_"),
            F.when(n % 41 == 0, "empty_"),
            F.when((n % 26 == 0) | (n % 26 == 13), "nul_"),
            F.when(n % 11 == 0, "link_"),
        )
    )
    raw, stem = F.col("text").cast("binary"), F.col("stem")
    with_nul = F.when(n % 26 == 0, F.concat(F.lit(NUL), raw)).otherwise(F.concat(raw, F.lit(NUL)))
    content = F.when(stem == "empty_", F.lit(b"")).when(stem == "nul_", with_nul).otherwise(raw)
    return (
        table(spark, sf_dir, "documents")
        .withColumn("stem", F.explode(stems))
        .withColumn("content", content)
        .select(
            "doc_id",
            "source",
            "lang",
            _doc_path(n, F.col("source"), F.col("lang"), stem).alias("path"),
            "content",
            F.octet_length("content").cast("long").alias("size"),
            (stem == "link_").alias("is_symlink"),
            F.lit(False).alias("is_directory"),
        )
    )


def linked_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with ``link_target``: a link leads to the next document, or nowhere."""
    docs = table(spark, sf_dir, "documents")
    targets = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"),
        _doc_path(F.col("doc_id"), F.col("source"), F.col("lang")).alias("next_path"),
    ).where(F.col("doc_id") % 11 == 0)
    lost = F.concat(F.lit("missing/doc_"), F.col("doc_id"))
    target = F.when(F.col("is_symlink"), F.coalesce("next_path", lost))
    return (
        corpus(spark, sf_dir)
        .join(targets, "doc_id", "left")
        .withColumn("link_target", target)
        .drop("next_path")
    )


def link_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked corpus as a file system lists it: a link's size is its target's length."""
    own = F.when(F.col("is_symlink"), F.octet_length("link_target")).otherwise(F.col("size"))
    return linked_corpus(spark, sf_dir).select(
        "path", "is_directory", "is_symlink", own.cast("long").alias("size"), "link_target"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ``(page_id, path, content, size)``: host first, deep paths."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    bare = F.rtrim(F.regexp_replace(bare, "[?#].*$", ""), F.lit("/"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(bare, F.lit("/page_"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.col("html").cast("binary").alias("content"),
        F.octet_length("html").cast("long").alias("size"),
        F.lit(False).alias("is_directory"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as ``(conv_id, path, content, size)``: a directory per conversation."""
    turn = F.lpad(F.col("turn").cast("string"), 4, "0")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.concat(F.lit("conv_"), "conv_id", F.lit("/"), turn, F.lit("_"), "role", F.lit(".txt")).alias(
            "path"
        ),
        F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit(False).alias("is_directory"),
    )


#: Where the relative tree is mounted, for links that hold absolute targets.
MOUNT = "/data/tree"


def relative_link_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``link_tree`` with what a file system holds: targets relative to the link, with ``.``, ``..``
    and empty segments, absolute ones below and outside of ``MOUNT``, and one that leads above the top."""
    tree = link_tree(spark, sf_dir)
    target, name = F.col("link_target"), F.substring_index("path", "/", -1)
    levels = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    climb = F.repeat(F.lit("../"), levels)
    raw = (
        F.when(name == "self", F.lit("./self"))
        .when(name == "lost", F.concat(F.lit("../"), climb, target))
        .when(name == "first", F.concat(F.lit(".//x/.././"), climb, target, F.lit("/.")))
        .when(name == "twin", F.concat(F.lit(MOUNT + "/./"), target, F.lit("/")))
        .when(name == "up", F.concat(F.lit("/data/other/"), target))
        .otherwise(F.concat(climb, target))
    )
    held = tree.withColumn("link_target", F.when(F.col("is_symlink"), raw))
    return held.withColumn("size", F.when(F.col("is_symlink"), F.octet_length("link_target")).otherwise(F.col("size")).cast("long"))


def link_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with every kind of link: documents in ``source/lang`` and links made per directory.

    Upward links (cycles), links to themselves, to nothing, to a file, two links to one
    directory, chains of links, and links whose target lies behind a linked directory.
    """
    docs = table(spark, sf_dir, "documents")
    source, lang = F.col("source"), F.col("lang")
    slash = F.lit("/")
    path = F.concat(source, slash, lang, F.lit("/doc_"), F.col("doc_id"), F.lit(".txt"))
    files = docs.select(
        path.alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit(None).cast("string").alias("link_target"),
    )
    homes = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    folders = homes.select(F.concat(source, slash, lang).alias("path")).unionByName(
        homes.select(source.alias("path")).distinct()
    )
    directories = folders.select(
        "path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("link_target")
    )
    in_lang = homes.select(
        F.concat(source, slash, lang, F.lit("/back")).alias("path"), source.alias("link_target")
    )
    per_source = homes.groupBy("source").agg(F.min(F.struct("first", "lang")).alias("head"))
    number = F.substring(source, F.lit(4), F.length(source)).cast("long")
    following = F.concat(F.lit("src"), number + 1)
    head_path = F.concat(
        source, slash, F.col("head.lang"), F.lit("/doc_"), F.col("head.first"), F.lit(".txt")
    )
    fresh = number % 4

    def link(name: str, target: Column, when: Column) -> Column:
        made = F.struct(
            F.concat(source, slash, F.lit(name)).alias("path"), target.alias("link_target")
        )
        return F.when(when, made)

    made = F.array(
        link("self", F.concat(source, F.lit("/self")), F.lit(True)),
        link("lost", F.concat(F.lit("missing/"), source), F.lit(True)),
        link("first", head_path, F.lit(True)),
        link("next", following, fresh == 0),
        link("twin", following, fresh == 0),
        link("hop", F.concat(following, F.lit("/hop2")), fresh == 1),
        link("hop2", F.concat(following, F.lit("/en")), fresh == 2),
        link("up", F.concat(F.lit("src"), number - 2), fresh == 3),
        link("via", F.concat(source, F.lit("/next/en")), fresh == 0),
        link("beyond", F.concat(source, F.lit("/twin/en/back/"), "head.lang"), fresh == 0),
    )
    at_source = per_source.select(F.inline(F.array_compact(made)))
    links = in_lang.unionByName(at_source).select(
        "path", F.octet_length("link_target").cast("long").alias("size"), "link_target"
    )
    return (
        files.withColumn("is_directory", F.lit(False))
        .unionByName(directories.withColumn("is_directory", F.lit(True)))
        .unionByName(links.withColumn("is_directory", F.lit(False)))
        .withColumn("is_symlink", F.col("link_target").isNotNull())
    )
