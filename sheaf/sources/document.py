"""Sinks: one document as ordered part files, JSON lines, and a table of fragments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sheaf.operators.render import in_order, json_files


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    partition: int


def open_folder(path: str) -> tuple:
    """The file system of ``path``, which has a scheme, and its place there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    raise ValueError(f"the document's path needs a scheme: {path}")


class _DocumentWriter(DataSourceArrowWriter):
    """Each task writes one part of raw bytes; the commit keeps the parts of successful attempts."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = path
        self.overwrite = overwrite
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        context = TaskContext.get()
        filesystem, base = open_folder(self.path)
        number = context.partitionId()
        name = None
        out = None
        for batch in iterator:
            for text in batch.column(batch.schema.get_field_index("text")):
                if out is None:
                    filesystem.create_dir(base, recursive=True)
                    name = f"part-{number:06d}-{self.run}-{context.taskAttemptId()}"
                    out = filesystem.open_output_stream(f"{base}/{name}")
                out.write(text.as_buffer())
        if out is not None:
            out.close()
        return _Part(name, number)

    def _files(self) -> tuple:
        from pyarrow import fs

        filesystem, base = open_folder(self.path)
        filesystem.create_dir(base, recursive=True)
        return filesystem, base, filesystem.get_file_info(fs.FileSelector(base))

    def commit(self, messages: list[_Part | None]) -> None:
        filesystem, base, files = self._files()
        kept = {m.name for m in messages if m is not None and m.name}
        for info in files:
            own = self.run in info.base_name
            stale = self.overwrite and info.base_name.startswith(("part-", "_SUCCESS"))
            if info.is_file and info.base_name not in kept and (own or stale):
                filesystem.delete_file(info.path)
        with filesystem.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Part | None]) -> None:
        filesystem, _, files = self._files()
        for info in files:
            if self.run in info.base_name:
                filesystem.delete_file(info.path)


class DocumentSink(DataSource):
    """``df.write.format("document")``: writes the ``text`` bytes of the rows, nothing between."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "text binary"

    def writer(self, schema, overwrite: bool) -> _DocumentWriter:
        return _DocumentWriter(self.options["path"], overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one it lies on the cluster's default file system.

    A file system of one machine is refused on a cluster, as each executor would write to its own.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(conf).makeQualified(place).toString()
    own = full.startswith("file:") and not path.startswith("file:")
    if own and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} would lie on each machine's own disk; give it a scheme")
    return full


def write_document(fragments: DataFrame, path: str, entries: DataFrame | None = None) -> None:
    """Replace the document at ``path``, a folder that all executors reach.

    ``entries`` are the run's, see ``in_order``.
    """
    fragments.sparkSession.dataSource.register(DocumentSink)
    ordered = in_order(fragments, entries).select("text")
    full = qualified(fragments.sparkSession, path)
    ordered.write.format("document").mode("overwrite").save(full)


def write_text(fragments: DataFrame, path: str, entries: DataFrame | None = None) -> None:
    """The same through Spark's text sink, for any file system Spark writes to.

    That sink ends every record with a line feed, so each fragment gives its own last one up. A
    fragment that ends without one, a file cut at a refused chunk, cannot be written this way:
    the write fails rather than change the document.
    """
    ends = F.substring("text", -1, 1) == F.lit(b"\n")
    line = F.substring(F.col("text"), F.lit(1), F.octet_length("text") - 1).cast("string")
    refused = F.raise_error(F.lit("a fragment has no last line feed; use write_document"))
    ordered = in_order(fragments, entries).select(
        F.when(ends, line).otherwise(refused.cast("string")).alias("value")
    )
    ordered.write.mode("overwrite").text(path)


def write_json(processed: DataFrame, path: str) -> None:
    """One JSON object per line and file."""
    json_files(processed).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_fragments(fragments: DataFrame, path: str) -> None:
    fragments.write.mode("overwrite").parquet(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The part files with their bytes, for tests and small documents; order by ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
