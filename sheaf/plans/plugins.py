"""User extensions: filters as Columns, formatters, and content plugins with per-file state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.content import LARGE_FILE, SMALL_FILE, ChunkFunction, ContentRule
from sheaf.sources.filetree import BLOCK_BYTES


@dataclass(frozen=True)
class FilterPlugin:
    """Any of: a predicate on entries, a predicate on chunks, a transform of chunks.

    Each takes and gives Columns; wrap a pandas UDF where built-in functions do not suffice.
    """

    name: str
    path: Callable[[DataFrame], Column] | None = None
    content: ChunkFunction | None = None
    transform: ChunkFunction | None = None


_FILTERS: dict[str, FilterPlugin] = {}


def register_filter(
    name: str,
    path: Callable[[DataFrame], Column] | None = None,
    content: ChunkFunction | None = None,
    transform: ChunkFunction | None = None,
) -> FilterPlugin:
    _FILTERS[name] = FilterPlugin(name, path, content, transform)
    return _FILTERS[name]


def path_predicates(plugins: list[FilterPlugin]) -> list[Callable[[DataFrame], Column]]:
    return [p.path for p in plugins if p.path]


def chunk_rules(plugins: list[FilterPlugin]) -> list[ContentRule]:
    """A plugin keeps what it accepts, so its predicate is an include rule."""
    return [ContentRule("include", p.content) for p in plugins if p.content]


def chunk_transforms(plugins: list[FilterPlugin]) -> list[ChunkFunction]:
    return [p.transform for p in plugins if p.transform]


class ContentPlugin:
    """Sees each file's chunks in order and may keep state between them.

    Instances are sent to the tasks. ``chunk`` returns the bytes to emit, or None to keep the
    input; ``end`` may return bytes to append to the file's last chunk.
    """

    def start(self, path: str) -> object:
        return None

    def chunk(self, state: object, data: bytes) -> bytes | None:
        return None

    def end(self, state: object) -> bytes | None:
        return None


def apply_content_plugin(chunks: DataFrame, plugin: ContentPlugin) -> DataFrame:
    """Run ``plugin`` over chunk rows ``(path, chunk_no, content)``; content becomes its output.

    Files are spread by path and their chunks sorted, then streamed: a task holds one file's
    state and one batch of chunks, never a file. ``end`` needs the file's last chunk, so that
    one is held back until the next file begins. An empty file is one row whose content is NULL:
    the plugin sees its start and end, and no chunk.
    """
    columns = ["path", "chunk_no", "content"]
    ordered = chunks.select(*columns).repartition("path").sortWithinPartitions("path", "chunk_no")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, state, held = None, None, None

        def closed() -> list:
            tail = plugin.end(state) or b""
            return [held[0], held[1], bytes(held[2] or b"") + tail]

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.path != path:
                    if held is not None:
                        out.append(closed())
                    path, held = row.path, None
                    state = plugin.start(path)
                if held is not None:
                    out.append(held)
                data = None if row.content is None else plugin.chunk(state, row.content)
                number = 0 if pd.isna(row.chunk_no) else int(row.chunk_no)
                held = [row.path, number, row.content if data is None else data]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([closed()], columns=columns)

    return ordered.mapInPandas(work, "path string, chunk_no int, content binary")


class _Stage:
    """One plugin on one file, fed in pieces of any length; it sees the file's chunks."""

    def __init__(self, plugin: ContentPlugin, path: str, step: int) -> None:
        self.plugin, self.step = plugin, step
        self.state = plugin.start(path)
        self.rest = bytearray()

    def _made(self, data: bytes) -> bytes:
        made = self.plugin.chunk(self.state, data)
        return data if made is None else bytes(made)

    def feed(self, data: bytes) -> bytes:
        self.rest += data
        whole = len(self.rest) - len(self.rest) % self.step
        out = [self._made(bytes(self.rest[k : k + self.step])) for k in range(0, whole, self.step)]
        del self.rest[:whole]
        return b"".join(out)

    def end(self) -> bytes:
        last = self._made(bytes(self.rest)) if self.rest else b""
        return last + bytes(self.plugin.end(self.state) or b"")


class _File:
    """A file led through all plugins: what one makes is cut into chunks anew for the next."""

    def __init__(self, plugins: Sequence[ContentPlugin], path: str, size: int) -> None:
        self.stages = [_Stage(p, path, _step(size)) for p in plugins]

    def feed(self, data: bytes, first: int = 0) -> bytes:
        for stage in self.stages[first:]:
            data = stage.feed(data)
        return data

    def end(self) -> bytes:
        return b"".join(self.feed(stage.end(), k + 1) for k, stage in enumerate(self.stages))


def _step(size: int | None) -> int:
    """The chunk size of a file whose recorded size is ``size``, as ``chunk_bytes`` has it."""
    if size is None or size >= SMALL_FILE:
        return SMALL_FILE if size is not None and size < LARGE_FILE else LARGE_FILE
    return size if size > 0 else SMALL_FILE


def _replaced(batch: pa.RecordBatch, values: dict[str, list]) -> pa.RecordBatch:
    for name, column in values.items():
        at = batch.schema.get_field_index(name)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))
    return batch


def _whole_files(plugins: Sequence[ContentPlugin]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, paths, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("body", "path", "size"))
            made = []
            for body, path, size in zip(bodies, paths.to_pylist(), sizes.to_pylist()):
                if body.is_valid:
                    file = _File(plugins, path, size)
                    made.append(file.feed(body.as_py()) + file.end())
                else:
                    made.append(None)
            lengths = [None if m is None else len(m) for m in made]
            yield _replaced(batch, {"body": made, "body_bytes": lengths})

    return work


def _blocked_files(plugins: Sequence[ContentPlugin], block_bytes: int):
    """Over block rows sorted by file and block: blocks again, of at most ``block_bytes``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, row, pending, number, taken = None, None, None, bytearray(), 0, 0

        def block(data: bytes | None, last: bool) -> pa.RecordBatch:
            nonlocal number, taken
            length = 0 if data is None else len(data)
            # How many there are is known with the last one only; before, there is one more.
            blocks = number + 1 if last else number + 2
            values = {"block_no": [number], "blocks": [blocks], "input_bytes": [taken], "body": [data], "body_bytes": [length]}
            number, taken = number + 1, 0
            return _replaced(row, values)

        def full() -> Iterator[pa.RecordBatch]:
            # More than a block, as what is left may be the last one, which closes the file.
            while len(pending) > block_bytes:
                yield block(bytes(pending[:block_bytes]), False)
                del pending[:block_bytes]

        def closed() -> Iterator[pa.RecordBatch]:
            if row is None:
                return
            if file is None:
                yield block(None, True)
                return
            pending.extend(file.end())
            yield from full()
            yield block(bytes(pending), True)

        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("path", "size", "body", "input_bytes")}
            for k in range(batch.num_rows):
                name, size, body, given = (batch.column(at[c])[k] for c in ("path", "size", "body", "input_bytes"))
                if row is None or name.as_py() != path:
                    yield from closed()
                    path, number, taken = name.as_py(), 0, 0
                    pending.clear()
                    # A row without its body, which is read already.
                    row = _replaced(batch.slice(k, 1), {"body": [None]})
                    file = _File(plugins, path, size.as_py()) if body.is_valid else None
                taken += given.as_py() or 0
                if file is not None and body.is_valid:
                    pending.extend(file.feed(body.as_py()))
                    yield from full()
        yield from closed()

    return work


def run_content_plugins(
    processed: DataFrame, plugins: Sequence[ContentPlugin], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Processed files with the bodies of readable ones led through ``plugins``, in order.

    Bodies are cut into the chunks of their files' recorded sizes. Whole-file rows are worked on
    where they are. Block rows of a file meet in one task, sorted, and stream through it: it holds
    one block and the plugins' states, and emits blocks of at most ``block_bytes``, numbered anew;
    ``blocks`` is right in the last one and larger than ``block_no`` + 1 before. A file without a
    body stays so. No rows give no rows.
    """
    if not plugins:
        return processed
    if "block_no" not in processed.columns:
        return processed.mapInArrow(_whole_files(plugins), processed.schema)
    ordered = processed.repartition("path").sortWithinPartitions("path", "block_no")
    return ordered.mapInArrow(_blocked_files(plugins, block_bytes), processed.schema)


class LineNumbers(ContentPlugin):
    """Puts the running line number in front of every chunk; a line counts where it ends."""

    def start(self, path: str) -> list[int]:
        return [1]

    def chunk(self, state: list[int], data: bytes) -> bytes:
        line = state[0]
        state[0] += bytes(data).count(b"\n")
        return f"{line}: ".encode() + bytes(data)


def chunk_body(chunks: DataFrame) -> DataFrame:
    """Chunk rows joined in order to one body per file."""
    return chunks.groupBy("path").agg(
        F.expr("listagg(content, X'') within group (order by chunk_no)").alias("body")
    )
