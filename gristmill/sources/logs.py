"""Growing logs as a Python data source: ``spark.read`` and ``spark.readStream`` with ``format("gristmill_log")``.

Rows are ``path``, ``start`` (byte at which the line begins) and ``line``.  Spark's file streams take each file once, whole; this
one follows files that are appended to.  An offset holds how many bytes of each file have been read, always up to the end of a line,
so a batch that runs again reads the same bytes, and a restart goes on where the checkpoint ends.

Bytes are dealt to tasks in blocks of ``blockBytes`` (64 MB): a task reads the lines that begin in its block, in
Arrow batches of about 1 MB, and holds one batch and one line at most.  Offsets and lists of blocks are kept by the driver: some 100 bytes
a file.  Line ends are line feeds, bytes that are no UTF-8 become U+FFFD, and empty lines are rows.  A last line without
a line feed is a row of a batch; a stream waits for its end.  A stream fails if a file shrinks; one that vanishes keeps its offset.
Files whose names begin with ``_`` or ``.`` and compressed files are not logs.  Paths may be URIs that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import trim
from .scans import extract_text

FORMAT = "gristmill_log"
SCHEMA = "path string, start bigint, line string"
BLOCK_BYTES = 64 << 20
_READ, _BATCH = 1 << 20, 1 << 20
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("line", pa.string())])


@dataclass
class Block(InputPartition):
    """Bytes ``low`` to ``high`` of a file that is read up to ``end``."""

    path: str
    low: int
    high: int
    end: int


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", root))


def _files(root: str) -> dict[str, int]:
    """Sizes of the files of a folder, or of one file."""
    system, path = _opened(root)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(path) :].split("/"))
    return {f.path: f.size for f in found if f.is_file and (f is info or not hidden(f.path))}


def _blocks(path: str, low: int, end: int, size: int) -> list[Block]:
    return [Block(path, at, min(at + size, end), end) for at in range(low, end, size)]


def _first_line(file, low: int, high: int) -> int | None:
    """Where the first line begins that begins in ``low`` to ``high``."""
    if not low:
        return 0
    at = low - 1
    file.seek(at)
    while at < high - 1:
        data = file.read(min(_READ, high - 1 - at))
        if not data:
            return None
        if (place := data.find(b"\n")) >= 0:
            return at + place + 1
        at += len(data)
    return None


def lines_of(file, block: Block) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a block and where they do; the last may reach beyond it."""
    start = _first_line(file, block.low, block.high)
    if start is None or start >= block.high:
        return
    file.seek(start)
    at, parts = start, []
    while at < block.end and start < block.high:
        data = file.read(min(_READ, block.end - at))
        if not data:
            break
        at += len(data)
        *whole, rest = data.split(b"\n")
        for piece in whole:
            line = b"".join([*parts, piece])
            parts = []
            if start >= block.high:
                return
            yield start, line
            start += len(line) + 1
        parts.append(rest)
    if start < block.high and any(parts):
        yield start, b"".join(parts)


def _read(root: str, block: Block) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block.path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], schema=_ARROW)

    starts, texts, size = [], [], 0
    with _opened(root)[0].open_input_file(block.path) as file:
        for start, line in lines_of(file, block):
            starts.append(start)
            texts.append(line.decode("utf-8", "replace"))
            size += len(line) + 64
            if size >= _BATCH:
                yield batch()
                starts, texts, size = [], [], 0
    if starts:
        yield batch()


class LogReader(DataSourceReader):
    """All lines the files hold when the query is planned."""

    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def partitions(self) -> list[Block]:
        return [b for path, end in sorted(_files(self.root).items()) for b in _blocks(path, 0, end, self.size)] or [Block("", 0, 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition) if partition.end else iter(())


class LogStreamReader(DataSourceStreamReader):
    """Whole lines as they are appended."""

    def __init__(self, root: str, size: int):
        self.root, self.size, self.seen = root, size, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system = _opened(self.root)[0]
        for path, size in _files(self.root).items():
            known = self.seen.get(path, 0)
            if size > known:
                self.seen[path] = self._last_end(system, path, known, size)
            elif size < known:
                raise ValueError(f"{path} has shrunk from {known} to {size} bytes")
        return dict(self.seen)

    @staticmethod
    def _last_end(system: fs.FileSystem, path: str, known: int, size: int) -> int:
        """The end of the last whole line between two places, sought from behind."""
        with system.open_input_file(path) as file:
            high = size
            while high > known:
                low = max(known, high - (1 << 16))
                file.seek(low)
                if (place := file.read(high - low).rfind(b"\n")) >= 0:
                    return low + place + 1
                high = low
        return known

    def partitions(self, start: dict, end: dict) -> list[Block]:
        for path, before in start.items():
            if end.get(path, before) < before:
                raise ValueError(f"{path} has shrunk from {before} to {end[path]} bytes")
        return [b for path, stop in sorted(end.items()) for b in _blocks(path, start.get(path, 0), stop, self.size)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)


class LogSource(DataSource):
    """Options: ``path`` (a folder, searched through, or a file) and ``blockBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _made(self, kind):
        return kind(self.options["path"], int(self.options.get("blockBytes", BLOCK_BYTES)))

    def reader(self, schema) -> LogReader:
        return self._made(LogReader)

    def streamReader(self, schema) -> LogStreamReader:
        return self._made(LogStreamReader)


def read_log(spark: SparkSession, path: str, stream: bool = False, **options: str | int) -> DataFrame:
    """The lines of a folder of logs, now or as they come."""
    spark.dataSource.register(LogSource)
    return (spark.readStream if stream else spark.read).format(FORMAT).options(**options).load(path)


def read_log_responses(spark: SparkSession, path: str, stream: bool = False, **options: str | int) -> DataFrame:
    """``label`` (``path:start``) and ``text`` of JSON lines; the text is null where none is recognised.  Blank lines are dropped."""
    lines = read_log(spark, path, stream, **options).where(trim(F.col("line")) != "")
    return lines.select(F.concat_ws(":", "path", F.col("start").cast("string")).alias("label"), extract_text(F.col("line")).alias("text"))
