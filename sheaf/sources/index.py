"""A byte index of the written document: where each fragment lies in it, and in which part file.

The index is narrow, made in one pass over the fragments. With it any file of the document is a
ranged read, and every part can be compared with what was meant to be written, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.content import whole_part
from sheaf.functions.paths import LOWEST, SEPARATOR
from sheaf.operators.ordering import ordered_table, with_total
from sheaf.operators.render import CONTENT, FRAGMENT_ORDER
from sheaf.sources.document import open_folder, qualified

MISSING, DIFFERENT = "missing", "different"
# Texts that a task holds at a time, if no single one is larger.
_BATCH_BYTES = 1 << 20


def document_index(fragments: DataFrame) -> DataFrame:
    """``(section, path, block_no, offset, bytes, md5)`` of every fragment, as it is written.

    Contents are read once; offsets are running sums of the narrow sizes over ranges of the
    document's order. Constant fragments have an empty path. A NULL text counts as empty.
    """
    text = F.coalesce("text", F.lit(b""))
    sized = fragments.select(
        *FRAGMENT_ORDER, F.octet_length(text).cast("long").alias("bytes"), F.md5(text).alias("md5")
    )
    table = ordered_table(sized, FRAGMENT_ORDER, costly=True)
    path = F.replace(F.col("order_key"), F.lit(LOWEST), F.lit(SEPARATOR))
    return with_total(table, "bytes").select(
        "section", path.alias("path"), "block_no", F.col("total").alias("offset"), "bytes", "md5"
    )


def file_ranges(index: DataFrame) -> DataFrame:
    """``(path, offset, bytes, blocks)``: the one range of each file, header and footer included."""
    found = index.where(F.col("section") == CONTENT).groupBy("path")
    return found.agg(
        F.min("offset").alias("offset"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("blocks")
    )


def part_index(spark: SparkSession, path: str) -> DataFrame:
    """``(part, start, length)`` of the part files of a written document; none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.substring_index("path", "/", -1).alias("part"), "length").where("length > 0")
    return with_total(ordered_table(named, ["part"]), "length").select(
        "part", F.col("total").alias("start"), "length"
    )


def located(index: DataFrame, parts: DataFrame) -> DataFrame:
    """The index with ``part`` and ``at``, the place in it; NULL where no part reaches so far.

    A fragment lies in one part as a whole. Both sides meet by stretches of the mean part's length:
    a part covers few of them, and what falls into one is at most that many bytes of fragments.
    Fragments without bytes are nowhere and left out.
    """
    total, count = parts.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, -(-total // max(count, 1)))
    first, last = (whole_part(c, F.lit(width)) for c in (F.col("start"), F.col("start") + F.col("length") - 1))
    covered = parts.withColumn("_stretch", F.explode(F.sequence(first, last)))
    asked = index.where("bytes > 0").withColumn("_of", whole_part(F.col("offset"), F.lit(width)))
    meets = (F.col("_of") == F.col("_stretch")) & (F.col("offset") >= F.col("start"))
    inside = meets & (F.col("offset") < F.col("start") + F.col("length"))
    at = F.col("offset") - F.col("start")
    return asked.join(covered, inside, "left").select(*index.columns, "part", at.alias("at"))


def read_ranges(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of ``located`` with ``text``, read from the document at ``path``.

    A task opens a part once and reads its ranges in order. Rows without a part get NULL; a range
    beyond a part's end gives what there is.
    """
    base = qualified(rows.sparkSession, path)
    columns = rows.columns
    kinds = rows.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = open_folder(base)
        name, file = None, None

        def with_texts(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], [*columns, "text"]
            )

        for batch in batches:
            texts: list[bytes | None] = []
            begin = held = 0
            ranges = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "at", "bytes")))
            for k, (part, at, size) in enumerate(ranges):
                if part != name:
                    if file is not None:
                        file.close()
                    name, file = part, None if part is None else filesystem.open_input_file(f"{folder}/{part}")
                if file is None:
                    texts.append(None)
                else:
                    file.seek(at)
                    texts.append(file.read(size))
                    held += size
                if held >= _BATCH_BYTES:
                    yield with_texts(batch.slice(begin, k + 1 - begin), texts)
                    begin, held, texts = k + 1, 0, []
            if texts:
                yield with_texts(batch.slice(begin), texts)
        if file is not None:
            file.close()

    ordered = rows.repartition("part").sortWithinPartitions("part", "at")
    return ordered.mapInArrow(read, kinds.add("text", "binary"))


def read_files(index: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """The fragments, with ``text``, of the files that ``wanted`` (path) names."""
    chosen = index.where(F.col("section") == CONTENT).join(wanted.select("path").distinct(), "path", "left_semi")
    chosen = chosen.select(*index.columns)
    return read_ranges(located(chosen, part_index(index.sparkSession, path)), path)


def verify_document(index: DataFrame, path: str) -> DataFrame:
    """The fragments that the document at ``path`` does not hold as the index has them, with a
    ``code``: their place is missing, or other bytes stand there."""
    found = read_ranges(located(index, part_index(index.sparkSession, path)), path)
    code = F.when(F.col("text").isNull(), MISSING).when(F.md5("text") != F.col("md5"), DIFFERENT)
    return found.withColumn("code", code).where("code is not null").select(*index.columns, "part", "code")
