"""A directory tree as DataFrames: entries with their attributes, and file contents in blocks.

The tree has to be mounted at the same place on every executor. Spark's own file sources are no
substitute: they leave out dot files, names with a leading underscore, empty files, directories
and broken links.
"""

from __future__ import annotations

import errno
import os
import re
import stat
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import reports
from sheaf.functions.content import BINARY_FLAG_WINDOW, chunk_bytes
from sheaf.functions.globs import glob_alternation
from sheaf.operators.contents import TOO_LARGE
from sheaf.operators.filters import OMITTABLE_PREFIX, too_large, trimmed
from sheaf.session import new_table_path

BLOCK_BYTES = 16 << 20
# Entries a task lists before it hands the rest of its work back to be spread anew.
TASK_ENTRIES = 20_000
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20

_ROWS = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # entry, todo or diagnostic
        T.StructField("path", T.StringType()),
        T.StructField("full_path", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("listed", T.BooleanType()),  # a todo directory that is an entry already
        T.StructField("entered", T.ArrayType(T.StringType())),
        T.StructField("size", T.LongType()),
        T.StructField("read_size", T.LongType()),
        T.StructField("modified_time", T.LongType()),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("is_symlink", T.BooleanType()),
        T.StructField("is_binary", T.BooleanType()),
        T.StructField("permissions", T.IntegerType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("inode", T.StringType()),
        T.StructField("read_error", T.StringType()),  # why the content cannot be opened
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
_BLANK = dict.fromkeys(_ROWS.names)


def _code(error: OSError) -> str:
    if error.errno == errno.EACCES:
        return "permission_denied"
    return "disappeared" if error.errno == errno.ENOENT else "cannot_open"


def _warn(path: str, code: str, about: str | None = None) -> dict:
    message = reports.text(code, path if about is None else about)
    return _BLANK | {"kind": "diagnostic", "path": path, "code": code, "message": message}


def _shown(name: str) -> str:
    """A name of the file system as text: bytes that are not UTF-8 become ``\\xNN``."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _real(full: str) -> str | bytes:
    """The name in the file system that ``full`` shows: as it is, unless only escapes explain it."""
    if "\\x" not in full or os.path.lexists(full):
        return full
    raw = re.sub(rb"\\x([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]), os.fsencode(full))
    return raw if os.path.lexists(raw) else full


def _sniff(full: str) -> tuple[bool, str | None]:
    """Whether the file is binary, or why it cannot be opened."""
    try:
        with open(_real(full), "rb") as file:
            return b"\x00" in file.read(BINARY_FLAG_WINDOW), None
    except OSError as error:
        return False, _code(error)


def _lister(
    follow: bool,
    include: Sequence[str],
    exclude: Sequence[str],
    max_depth: int | None,
    max_path_bytes: int | None,
    sniff: bool,
    budget: int,
):
    """The task function: turns todo rows into entries, diagnostics and further todo rows."""
    wanted = re.compile(glob_alternation(include)).fullmatch if include else None
    hidden = re.compile(glob_alternation(exclude)).fullmatch
    inside = re.compile(glob_alternation([p + "/*" for p in exclude])).fullmatch

    def entry(path: str, full: str, depth: int) -> tuple[list[dict], str | None]:
        """The rows of one entry, and the directory to go down if it is one."""
        name = path.rsplit("/", 1)[-1]
        if max_path_bytes is not None and len(os.fsencode(full)) >= max_path_bytes:
            return [_warn(path, "path_too_long")], None
        real = _real(full)
        try:
            info = os.lstat(real)
        except OSError as error:
            return [_warn(path, _code(error))], None
        rows = []
        is_link = stat.S_ISLNK(info.st_mode)
        is_dir, size, read_size = stat.S_ISDIR(info.st_mode), info.st_size, info.st_size
        target = down = read_error = None
        if is_link:
            try:
                target = _shown(os.fsdecode(os.readlink(real)))
                seen = os.stat(real)
                read_size = 0 if stat.S_ISDIR(seen.st_mode) else seen.st_size
                if follow:
                    is_dir, size = stat.S_ISDIR(seen.st_mode), seen.st_size
                    down = _shown(os.fsdecode(os.path.realpath(real)))
            except OSError as error:
                read_size, read_error = 0, _code(error)
                if follow:
                    rows.append(_warn(path, "unresolvable_link"))
        if wanted and not is_dir:
            short = path.removeprefix(OMITTABLE_PREFIX)
            if not (wanted(path) or wanted(name) or wanted(short)):
                return [], None
        if hidden(path) or hidden(name) or (is_dir and inside(path)):
            return [], None
        is_binary = None
        if sniff:
            is_binary = False
            if stat.S_ISREG(info.st_mode):
                is_binary, read_error = _sniff(full)
        rows.append(
            _BLANK
            | {
                "kind": "entry",
                "path": path,
                "full_path": full,
                "level": depth,
                "size": size,
                "read_size": read_size,
                "modified_time": int(info.st_mtime),
                "is_directory": is_dir,
                "is_symlink": is_link,
                "is_binary": is_binary,
                "permissions": info.st_mode,
                "link_target": target,
                "device": str(info.st_dev),
                "inode": str(info.st_ino),
                "read_error": read_error,
            }
        )
        return rows, (down or full) if is_dir else None

    def listing(todo: dict, left: int) -> Iterator[dict]:
        """One todo row; beyond ``left`` entries the rest comes back as todo rows."""
        path, full, depth = todo["path"], todo["full_path"], todo["level"]
        entered = list(todo["entered"])
        if not todo["listed"]:
            rows, full = entry(path, full, depth)
            yield from rows
            if full is None:
                return
            depth += 1
        try:
            own = os.stat(_real(full))
            mark = f"{own.st_dev}:{own.st_ino}"
            if mark in entered:
                yield _warn(path, "cycle")
                return
            scan = os.scandir(os.fsdecode(_real(full)))
        except OSError as error:
            yield _warn(path, _code(error), path or full)
            return
        entered.append(mark)
        with scan:
            for item in scan:
                name = _shown(item.name)
                below = f"{path}/{name}" if path else name
                if max_depth is not None and depth >= max_depth:
                    yield _warn(below, "depth_exceeded")
                    continue
                if os.fsencode(name) != os.fsencode(item.name):
                    yield _warn(below, "name_not_utf8")
                todo_row = _BLANK | {
                    "kind": "todo",
                    "path": below,
                    "full_path": f"{full}/{name}",
                    "level": depth,
                    "entered": entered,
                }
                if left <= 0:
                    yield todo_row | {"listed": False}
                    continue
                left -= 1
                rows, down = entry(below, todo_row["full_path"], depth)
                yield from rows
                if down is not None:
                    yield todo_row | {"listed": True, "full_path": down, "level": depth + 1}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = budget
        out: list[dict] = []
        for batch in batches:
            stack = batch.to_dict("records")
            while stack:
                todo = stack.pop()
                if left <= 0:
                    out.append(_BLANK | todo | {"kind": "todo"})
                else:
                    for row in listing(todo, left):
                        if row["kind"] == "todo" and left > 0:
                            if row["listed"]:
                                stack.append(row)
                                continue
                        left -= row["kind"] == "entry"
                        out.append(row)
                        if len(out) >= BATCH_ROWS:
                            yield pd.DataFrame(out, columns=_ROWS.names, dtype=object)
                            out = []
        if out:
            yield pd.DataFrame(out, columns=_ROWS.names, dtype=object)

    return work


def read_tree(
    spark: SparkSession,
    root: str,
    exclude: Sequence[str] = (),
    follow: bool = False,
    max_depth: int | None = None,
    task_entries: int = TASK_ENTRIES,
    parallelism: int | None = None,
    include: Sequence[str] = (),
    max_path_bytes: int | None = None,
    sniff: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """List all below ``root``: ``(entries, diagnostics)``. Nothing that is missing raises.

    A task lists up to ``task_entries`` entries and hands the rest back; each round spreads that
    rest over all tasks, so neither a deep subtree nor one huge directory stays with one task.
    Rounds are written to the shared folder. ``exclude`` globs stop the listing at a directory,
    ``include`` globs leave other files out. No file is opened unless ``sniff`` asks for
    ``is_binary``. A name that is not UTF-8 is shown with escapes and a diagnostic.
    """
    table = new_table_path(spark, "tree")
    globs = trimmed(include), trimmed(exclude)
    work = _lister(follow, *globs, max_depth, max_path_bytes, sniff, task_entries)
    slots = parallelism or spark.sparkContext.defaultParallelism * 4
    first = _BLANK | {"path": "", "full_path": os.path.abspath(root), "level": 0}
    todo = spark.createDataFrame([first | {"listed": True, "entered": []}], _ROWS)
    columns = ["path", "full_path", "level", "listed", "entered"]
    done = 0
    while done == 0 or not todo.isEmpty():
        spread = todo.select(*columns).repartition(slots if done else 1)
        rows = spread.mapInPandas(work, _ROWS)
        rows.write.parquet(f"{table}/round={done}")
        todo = spark.read.schema(_ROWS).parquet(f"{table}/round={done}").where("kind = 'todo'")
        done += 1
    found = spark.read.schema(_ROWS).parquet(*(f"{table}/round={n}" for n in range(done)))
    entries = found.where("kind = 'entry'").select(
        "path",
        "size",
        F.timestamp_seconds("modified_time").alias("modified_time"),
        "is_directory",
        "is_symlink",
        "is_binary",
        "permissions",
        "level",
        "link_target",
        "device",
        "inode",
        "read_size",
        "read_error",
    )
    return entries, found.where("kind = 'diagnostic'").select("path", "code", "message")


_BLOCKS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("block_no", T.IntegerType()),
        T.StructField("blocks", T.IntegerType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("code", T.StringType()),
    ]
)
_ARROW_BLOCKS = pa.schema(
    [
        ("path", pa.string()),
        ("size", pa.int64()),
        ("block_no", pa.int32()),
        ("blocks", pa.int32()),
        ("content", pa.binary()),
        ("code", pa.string()),
    ]
)


def with_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``block_bytes`` and the number of ``blocks``; a block holds whole chunks, an empty
    file has one block."""
    step = chunk_bytes(F.col("size")).cast("long")
    whole = step * F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / step))
    count = F.greatest(F.lit(1), F.ceil(F.col("read_size") / F.col("block_bytes")))
    return files.withColumn("block_bytes", whole).withColumn("blocks", count.cast("int"))


def _read(base: str, row: dict) -> dict:
    content = code = None
    try:
        with open(_real(f"{base}/{row['path']}"), "rb") as file:
            file.seek(row["block_no"] * row["block_bytes"])
            content = file.read(row["block_bytes"])
    except IsADirectoryError:
        content = b""  # a link to a directory opens but yields nothing
    except OSError as error:
        code = _code(error)
    return row | {"content": content, "code": code}


def read_blocks(
    entries: DataFrame,
    root: str,
    block_bytes: int = BLOCK_BYTES,
    max_file_bytes: int | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """The bytes of the files in ``entries``: ``(path, size, block_no, blocks, content, code)``.

    A block that cannot be read has a ``code`` and no content; a file over the size limit is one
    such row, unread. Reads are spread by block, so neither file sizes nor directories skew them.
    """
    base = os.path.abspath(root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(_read(base, row))
                held += len(rows[-1]["content"] or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW_BLOCKS)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW_BLOCKS)

    files = with_blocks(entries.where(~F.col("is_directory")), block_bytes)
    slots = parallelism or entries.sparkSession.sparkContext.defaultParallelism * 4
    plan = (
        files.where(~too_large(F.col("size"), max_file_bytes))
        .withColumn("block_no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("path", "size", "blocks", "block_bytes", "block_no")
        .repartition(slots, "path", "block_no")
    )
    large = files.where(too_large(F.col("size"), max_file_bytes)).select(
        "path",
        "size",
        F.lit(0).alias("block_no"),
        F.lit(1).alias("blocks"),
        F.lit(None).cast("binary").alias("content"),
        F.lit(TOO_LARGE).alias("code"),
    )
    return plan.mapInArrow(work, _BLOCKS).unionByName(large)
