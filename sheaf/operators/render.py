"""Render entries and contents to document fragments, and join fragments in order.

A fragment is ``(section, order_key, block_no, text)``; sorted by the first three columns the
texts are the document. It is never gathered into one row: a sink writes it as ordered part
files, ``bundles`` as volumes of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.content import ChunkFunction, whole_part
from sheaf.functions.paths import LOWEST, level, order_key, size_kb
from sheaf.operators.contents import OK
from sheaf.operators.ordering import (
    PART_BYTES,
    numbered_parts,
    ordered_table,
    part_size,
    route,
    with_offset,
    with_position,
    with_total,
)
from sheaf.operators.skew import measure

FRAGMENT_ORDER = ["section", "order_key", "block_no"]
HEAD, STRUCTURE, CONTENT_HEAD, CONTENT, TAIL = range(5)
VOLUME_BYTES = 16 << 20


class Formatter:
    """What a document looks like: constant texts and Columns for its events.

    Subclass to define a format; the defaults write nothing.
    """

    name = ""
    begin_document = ""
    begin_structure = ""
    end_structure = ""
    begin_content = ""
    end_content = ""
    end_document = ""

    def directory(self, path: Column, depth: Column) -> Column:
        return F.lit("")

    def entry(self, path: Column, depth: Column, size: Column, show_size: bool) -> Column:
        return F.lit("")

    def header(self, path: Column, size: Column) -> Column:
        return F.lit("")

    def chunk(self, data: Column) -> Column:
        """Each chunk of a body; only formats that override it pay for it."""
        return data

    def footer(self) -> Column:
        return F.lit("")


class TextFormatter(Formatter):
    # The headings and marks of the text document.
    name = "text"
    begin_structure = "Directory Structure:\n==================\n\n"
    begin_content = "\nFile Contents:\n=============\n\n"
    indent = "  "
    directory_mark = "📁 "
    file_mark = "📄 "
    file_head = "// File: "
    file_foot = "\n\n"

    def directory(self, path: Column, depth: Column) -> Column:
        mark = F.lit(self.directory_mark)
        return F.concat(F.repeat(F.lit(self.indent), depth), mark, path, F.lit("/\n"))

    def entry(self, path: Column, depth: Column, size: Column, show_size: bool) -> Column:
        shown = [F.lit("["), size_kb(size).cast("string"), F.lit(" KB] ")] if show_size else []
        indent = F.repeat(F.lit(self.indent), depth)
        return F.concat(indent, F.lit(self.file_mark), *shown, path, F.lit("\n"))

    def header(self, path: Column, size: Column) -> Column:
        return F.concat(F.lit(self.file_head), path, F.lit("\n"))

    def footer(self) -> Column:
        return F.lit(self.file_foot)


_FORMATTERS: dict[str, Formatter] = {"text": TextFormatter()}


def register_formatter(formatter: Formatter) -> None:
    _FORMATTERS[formatter.name] = formatter


def formatter_named(name: str) -> Formatter:
    if name not in _FORMATTERS:
        raise ValueError(f"unknown format: {name!r}")
    return _FORMATTERS[name]


def chunk_event(formatter: Formatter) -> ChunkFunction | None:
    """The format's chunk event, to be given to the content pass, if it has one of its own."""
    return None if type(formatter).chunk is Formatter.chunk else formatter.chunk


def structure_lines(
    entries: DataFrame, formatter: Formatter | None = None, show_size: bool = False
) -> DataFrame:
    """Entries ``(path, is_directory, size)`` with their listing line as ``text``."""
    formatter = formatter or TextFormatter()
    path, depth = F.col("path"), level(F.col("path"))
    line = F.when(F.col("is_directory"), formatter.directory(path, depth)).otherwise(
        formatter.entry(path, depth, F.col("size"), show_size)
    )
    return entries.withColumn("text", line)


def file_text(formatter: Formatter) -> Column:
    """Header, body and footer of a processed whole file; the footer only if all went well."""
    head = formatter.header(F.col("path"), F.col("size")).cast("binary")
    body = F.coalesce("body", F.lit(b""))
    foot = F.when(F.col("status") == OK, formatter.footer().cast("binary")).otherwise(F.lit(b""))
    return F.concat(head, body, foot)


def block_text(formatter: Formatter) -> Column:
    """The same for a block row: the header before the first, the footer after the last block."""
    head = formatter.header(F.col("path"), F.col("size")).cast("binary")
    body = F.coalesce("body", F.lit(b""))
    foot = formatter.footer().cast("binary")
    ends = (F.col("status") == OK) & (F.col("block_no") == F.col("blocks") - 1)
    return F.concat(
        F.when(F.col("block_no") == 0, head).otherwise(F.lit(b"")),
        body,
        F.when(ends, foot).otherwise(F.lit(b"")),
    )


def _frame(df: DataFrame, formatter: Formatter) -> DataFrame:
    """The constant fragments around the two sections."""
    texts = {
        HEAD: formatter.begin_document + formatter.begin_structure,
        CONTENT_HEAD: formatter.end_structure + formatter.begin_content,
        TAIL: formatter.end_content + formatter.end_document,
    }
    rows = [F.struct(F.lit(s).alias("section"), F.lit(t).alias("t")) for s, t in texts.items() if t]
    if not rows:
        rows = [F.struct(F.lit(HEAD).alias("section"), F.lit("").alias("t"))]
    one = df.sparkSession.range(0, 1, 1, 1)
    return one.select(F.inline(F.array(*rows))).select(
        "section",
        F.lit("").alias("order_key"),
        F.lit(0).alias("block_no"),
        F.col("t").cast("binary").alias("text"),
    )


def structure_fragments(
    entries: DataFrame, formatter: Formatter, show_size: bool = False
) -> DataFrame:
    return structure_lines(entries, formatter, show_size).select(
        F.lit(STRUCTURE).alias("section"),
        order_key(F.col("path")).alias("order_key"),
        F.lit(0).alias("block_no"),
        F.col("text").cast("binary").alias("text"),
    )


def content_fragments(processed: DataFrame, formatter: Formatter) -> DataFrame:
    """From whole-file rows, or from block rows if there is a ``block_no``."""
    blocked = "block_no" in processed.columns
    return processed.select(
        F.lit(CONTENT).alias("section"),
        order_key(F.col("path")).alias("order_key"),
        F.col("block_no").cast("int") if blocked else F.lit(0).alias("block_no"),
        (block_text(formatter) if blocked else file_text(formatter)).alias("text"),
    )


def around(entries: DataFrame, formatter: Formatter, show_size: bool = False) -> DataFrame:
    """All fragments of the whole document but the contents, unsorted."""
    return _frame(entries, formatter).unionByName(structure_fragments(entries, formatter, show_size))


def document(
    entries: DataFrame,
    processed: DataFrame,
    formatter: Formatter | None = None,
    show_size: bool = False,
) -> DataFrame:
    """All fragments of the whole document, unsorted."""
    formatter = formatter or TextFormatter()
    frame = around(entries, formatter, show_size)
    return frame.unionByName(content_fragments(processed, formatter))


def _listed_keys(entries: DataFrame) -> DataFrame:
    """``(section, order_key, bytes)`` of the fragments of entries, bytes as recorded.

    Derived from the entries alone, so no content is read for them.
    """
    path, size = F.col("path"), F.col("size")
    line = F.struct(F.lit(STRUCTURE).alias("section"), F.octet_length(path).cast("long").alias("b"))
    body = F.struct(F.lit(CONTENT).alias("section"), (F.octet_length(path) + size).alias("b"))
    lines = F.when(F.col("is_directory"), F.array(line)).otherwise(F.array(line, body))
    return entries.select(
        order_key(path).alias("order_key"), F.explode(lines).alias("line")
    ).select("line.section", "order_key", F.col("line.b").alias("bytes"))


def with_document_position(fragments: DataFrame, entries: DataFrame) -> DataFrame:
    """Whole-file fragments, or what is left of them, with their place in the document as
    ``position``. They meet it by their keys: leave the texts out before, if only digests are
    wanted."""
    frame = fragments.where(~F.col("section").isin(STRUCTURE, CONTENT))
    keys = _listed_keys(entries).drop("bytes").unionByName(frame.select("section", "order_key"))
    places = with_position(keys, ["section", "order_key"])
    return fragments.join(places, ["section", "order_key"])


def in_order(
    fragments: DataFrame, entries: DataFrame | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Fragments sorted over all partitions, so that part files in name order are the document.

    With the run's ``entries`` the partition bounds come from recorded sizes, so partitions are
    even in bytes and contents are read and shuffled once. Without them Spark samples.
    """
    if entries is None:
        return fragments.orderBy(*FRAGMENT_ORDER)
    frame = entries.sparkSession.range(TAIL + 1).select(
        F.col("id").cast("int").alias("section"),
        F.lit("").alias("order_key"),
        F.lit(0).cast("long").alias("bytes"),
    )
    listed = _listed_keys(entries).unionByName(frame)
    keys = ordered_table(listed, ["section", "order_key"])
    sized = with_total(keys, "bytes")
    step = part_size(keys, "bytes", part_bytes)
    key = F.concat(F.col("section").cast("string"), F.col("order_key"))
    part = whole_part(F.col("total"), F.lit(step)).alias("_of")
    starts, parts = numbered_parts(sized.groupBy(part).agg(F.min(key).alias("key")).drop("_of"))
    routed = route(fragments, key, starts, parts, "_part").drop("_part")
    return routed.sortWithinPartitions(*FRAGMENT_ORDER)


def bundles(
    files: DataFrame,
    processed: DataFrame,
    group: str,
    formatter: Formatter | None = None,
    volume_bytes: int = VOLUME_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One document per ``group``, as numbered volumes ``(group, volume, files, text)``.

    ``files`` gives the recorded ``path``, ``size`` and ``group`` of what ``processed`` holds. A
    volume takes the files that start in its ``volume_bytes`` of the group's recorded bytes, so
    no row exceeds that by more than one file, however large the group; the volumes of a group in
    order are its document. Groups of any size are spread: partitions begin at volumes and are
    even in bytes. The contents are read once and shuffled once, for the numbering of volumes and
    the joining of texts alike.
    """
    formatter = formatter or TextFormatter()
    path = F.col("path")
    # A NULL group is a group of its own, with a key that no text gives.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    narrow = files.select(named.alias("_group"), order_key(path).alias("order_key"), "size")
    keys = ordered_table(narrow, ["_group", "order_key"], costly=True)
    totalled = with_total(keys, "size")
    sized = with_offset(keys, totalled, "_group", "size").withColumn(
        "volume", whole_part(F.col("offset"), F.lit(volume_bytes))
    )
    key = F.concat(F.col("_group"), F.lit(LOWEST), F.col("order_key"))
    step = part_size(keys, "size", part_bytes)
    volumes = sized.groupBy("_group", "volume").agg(
        F.min(key).alias("key"), F.min("total").alias("total"), F.min("offset").alias("offset")
    )
    first = F.min(F.struct("key", "_group", "offset"))
    part = whole_part(F.col("total"), F.lit(step)).alias("_of")
    firsts = volumes.groupBy(part).agg(first.alias("first"))
    firsts, parts = numbered_parts(firsts.select("first.*"))
    carry = firsts.select(
        F.col("part").cast("int").alias("_part"), "_group", F.col("offset").alias("_carry")
    )
    texts = processed.select(
        F.col(group),
        named.alias("_group"),
        order_key(path).alias("order_key"),
        "size",
        file_text(formatter).alias("text"),
    )
    routed = route(texts, key, firsts.select("part", "key"), parts, "_part")
    within = (
        Window.partitionBy("_part", "_group")
        .orderBy("order_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("size").over(within), F.lit(0))
    # A row per partition: broadcast while that is little.
    carry = F.broadcast(carry) if measure(firsts)[1] else carry
    numbered = routed.withColumn("_local", offset).join(carry, ["_part", "_group"], "left")
    begins = F.col("_local") + F.coalesce("_carry", F.lit(0))
    volume = whole_part(begins, F.lit(volume_bytes))
    return (
        numbered.withColumn("volume", volume.cast("long"))
        .groupBy("_part", group, "volume")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.expr("listagg(text, X'') within group (order by order_key)").alias("text"),
        )
        .drop("_part")
    )


def one_line_base64(data: Column) -> Column:
    """Base64 without line breaks, whatever the session's setting for them is."""
    return F.translate(F.base64(data), "\r\n", "")


def json_files(processed: DataFrame) -> DataFrame:
    """One JSON object per file, ``path``, ``size`` and ``content``, as ``json``.

    Content that is not UTF-8 is base64 and says so in ``encoding``.
    """
    body = F.coalesce(F.col("body"), F.lit(b"")).cast("string")
    valid = F.is_valid_utf8(body)
    record = F.struct(
        F.col("path"),
        F.col("size"),
        F.when(valid, body).otherwise(one_line_base64(F.col("body"))).alias("content"),
        F.when(~valid, F.lit("base64")).alias("encoding"),
    )
    return processed.withColumn("json", F.to_json(record))


def json_document(entries: DataFrame, processed: DataFrame) -> DataFrame:
    """The fragments of the one JSON document ``{"files": [...]}``, unsorted."""
    keyed = json_files(processed).select(order_key(F.col("path")).alias("order_key"), "json")
    # From the narrow entries, so that contents are not read to find the first file.
    keys = entries.where("not is_directory").select(order_key(F.col("path")).alias("k"))
    first = keys.select(F.min("k")).scalar()
    comma = F.when(F.col("order_key") == first, F.lit("")).otherwise(F.lit(","))
    body = keyed.select(
        F.lit(CONTENT).alias("section"),
        "order_key",
        F.lit(0).alias("block_no"),
        F.concat(comma, F.col("json"), F.lit("\n")).cast("binary").alias("text"),
    )
    frame = Formatter()
    frame.begin_document = '{"files":[\n'
    frame.end_document = "]}\n"
    return _frame(processed, frame).unionByName(body)
