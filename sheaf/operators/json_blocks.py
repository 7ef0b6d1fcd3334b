"""JSON of files that are several block rows, without joining a file's blocks.

Borders between blocks are moved forward, by at most three bytes, to where JSON can be cut: to the
next character in a file that is UTF-8 as a whole, to the next multiple of three bytes in one that
is not and becomes base64. What a block lacks behind its end are then at most the first three bytes
behind it, so only such edges cross between blocks, in a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import order_key
from sheaf.operators.render import CONTENT, Formatter, _frame, one_line_base64
from sheaf.operators.skew import measure
from sheaf.session import written

_EDGE = 3
# Bodies below this length travel whole in the narrow table.
_TINY = 8
# In hexadecimal: bytes inside a character, and the last byte that is not inside one with all behind it.
_INSIDE = "^(?:[89AB].){0,3}"
_LAST_CHARACTER = "^(?:..)*?([0-7C-F].(?:[89AB].)*)$"


def _inside(data: Column) -> Column:
    """How many bytes, three at most, ``data`` has before its first character begins."""
    found = F.regexp_extract(F.hex(F.substring(data, 1, _EDGE)), _INSIDE, 0)
    return F.shiftright(F.length(found), 1)


def _is_text(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def block_edges(blocks: DataFrame) -> DataFrame:
    """``(path, block_no, behind, start, opens, closes, valid)`` of block rows ``(path, block_no, body)``.

    ``behind`` are the first bytes after the block in its file, ``start`` the bytes before it,
    ``opens`` and ``closes`` mark a file's first and last block, ``valid`` says whether the whole
    file is UTF-8. One narrow pass; blocks may be of any length, also empty or NULL.
    """
    body = F.coalesce("body", F.lit(b""))
    tail = F.regexp_extract(F.hex(F.substring("_body", -4, 4)), _LAST_CHARACTER, 1)
    tiny = F.col("bytes") < _TINY
    skipped = F.when(F.col("block_no") > 0, _inside(F.col("_body"))).otherwise(0)
    core = F.substring("_body", skipped + 1, F.col("bytes") - skipped - F.octet_length("_rest"))
    narrow = (
        blocks.select("path", F.col("block_no").cast("int").alias("block_no"), body.alias("_body"))
        .withColumn("bytes", F.octet_length("_body").cast("int"))
        .withColumn("_rest", F.when(tiny, F.col("_body")).otherwise(F.unhex(tail)))
        .select(
            "path",
            "block_no",
            "bytes",
            "_rest",
            F.when(F.col("bytes") > 0, F.substring("_body", 1, _EDGE)).alias("_head"),
            F.when(tiny, F.lit(True)).otherwise(_is_text(core)).alias("_core"),
        )
    )
    narrow = written(narrow, "edges")
    in_file = Window.partitionBy("path").orderBy("block_no")
    # From the end: a running value costs one step a row there.
    back = Window.partitionBy("path").orderBy(F.desc("block_no"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("_head")
    edges = narrow.withColumn("_own", head)
    for _ in range(_EDGE - 1):
        # Heads of very short blocks are filled up from the blocks behind them.
        longer = F.substring(F.concat("_own", F.coalesce(F.last(head, True).over(later), F.lit(b""))), 1, _EDGE)
        edges = edges.withColumn("_head", longer)
    edges = edges.withColumns(
        {
            "behind": F.coalesce(F.last(head, True).over(later), F.lit(b"")),
            "closes": F.row_number().over(back) == 1,
            "opens": F.row_number().over(in_file) == 1,
            "start": F.coalesce(F.sum("bytes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    joined = F.concat("_rest", "behind")
    # What stands before a short block's first character belongs to the block before it.
    skip = F.when((F.col("start") > 0) & (F.col("bytes") < _TINY), _inside(joined)).otherwise(0)
    end = F.octet_length("_rest") + _inside(F.col("behind"))
    first = (F.col("start") == 0) & (F.col("bytes") > 0)
    sound = _is_text(F.substring(joined, skip + 1, end - skip)) & F.col("_core")
    # The file's first byte begins a character.
    sound = sound & (~first | (_inside(head) == 0))
    every = Window.partitionBy("path")
    return edges.withColumn("valid", F.min(sound).over(every)).select(
        "path", "block_no", "behind", "start", "opens", "closes", "valid"
    )


def json_block_text(body: Column) -> Column:
    """A block's part of its file's JSON object; needs the columns of ``block_edges``."""
    whole = F.concat(body, F.col("behind"))
    length = F.octet_length(body)
    start, end = F.col("start"), F.col("start") + length

    def piece(skip: Column, more: Column) -> Column:
        return F.substring(whole, skip + 1, F.greatest(length + more - skip, F.lit(0)))

    def to_third(place: Column) -> Column:
        return ((3 - place % 3) % 3).cast("int")

    skip = F.when(start > 0, _inside(whole)).otherwise(0)
    quoted = F.to_json(F.struct(piece(skip, _inside(F.col("behind"))).cast("string").alias("c")))
    text = F.substring(quoted, F.lit(7), F.length(quoted) - 8)
    coded = one_line_base64(piece(to_third(start), to_third(end)))
    # The record up to its content, and what follows that.
    known = F.to_json(F.struct("path", "size"))
    opening = F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(',"content":"'))
    closing = F.when(F.col("valid"), F.lit('"}')).otherwise(F.lit('","encoding":"base64"}'))
    return F.concat(
        F.when(F.col("opens"), opening).otherwise(""),
        F.when(F.col("valid"), text).otherwise(coded),
        F.when(F.col("closes"), closing).otherwise(""),
    )


def json_blocks(blocks: DataFrame) -> DataFrame:
    """``(path, block_no, opens, closes, json)``: in order, the texts of a file are its JSON object
    ``path``, ``size`` and ``content``.

    Content that is not UTF-8 as a whole is base64 and says so in ``encoding``. The narrow edges
    are made in a pass of their own; if they are not measured to be small, contents are shuffled
    once to meet them.
    """
    edges = written(block_edges(blocks), "block-edges")
    side = F.broadcast(edges) if measure(edges)[1] else edges
    body = F.coalesce("body", F.lit(b""))
    rows = blocks.select("path", F.col("block_no").cast("int").alias("block_no"), "size", body.alias("body"))
    met = rows.join(side, ["path", "block_no"])
    return met.select("path", "block_no", "opens", "closes", json_block_text(F.col("body")).alias("json"))


def json_block_document(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The fragments of the one JSON document ``{"files": [...]}``, unsorted, a row per block."""
    keys = entries.where("not is_directory").select(order_key(F.col("path")).alias("k"))
    first = keys.select(F.min("k")).scalar()
    key = order_key(F.col("path"))
    comma = F.when(F.col("opens") & (key != first), F.lit(",")).otherwise(F.lit(""))
    line = F.when(F.col("closes"), F.lit("\n")).otherwise(F.lit(""))
    body = json_blocks(blocks).select(
        F.lit(CONTENT).alias("section"),
        key.alias("order_key"),
        "block_no",
        F.concat(comma, F.col("json"), line).cast("binary").alias("text"),
    )
    frame = Formatter()
    frame.begin_document = '{"files":[\n'
    frame.end_document = "]}\n"
    return _frame(blocks, frame).unionByName(body)
