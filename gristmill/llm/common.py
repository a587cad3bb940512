"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from hashlib import blake2b
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^" + SPACE + "]+")
UPPER_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Paths of the tables of this process that have not been deleted.
_written: list[str] = []
#: How many words' hashes a process remembers, and up to which length.
WORDS_HELD, WORD_BYTES = 1 << 16, 64
#: Rows that go to a Python worker at once, where the session keeps Spark's default: texts are long.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in this process alone (tests, a laptop) a fresh temporary
    folder is made and remembered in the session; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return found.rstrip("/")


def table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what follows re-reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, start: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what ``table`` wrote (from the ``start``-th on): call it when results have been written elsewhere."""
    for path in [p for p in _written[start:] if p not in keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end the tables written inside; the function that is yielded writes one that stays."""
    start, kept = len(_written), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = table(df, name)
        kept.append(_written[-1])
        return out

    try:
        yield keep
    finally:
        drop_tables(spark, start, tuple(kept))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` has about ``most`` bytes; a column of numbers holds the sizes themselves.

    A row is never cut, so a single long text makes a slice of its own.
    """
    for batch in batches:
        held = batch.column(column)
        sizes = pc.fill_null(held if pa.types.is_integer(held.type) else pc.binary_length(held), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        if at < batch.num_rows:
            yield batch.slice(at)
        del batch
        pa.default_memory_pool().release_unused()


def words_of(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text) if text else []


class _Hashes(dict):
    """64-bit BLAKE2b hashes of words; those of short words are remembered, up to a number."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_HELD:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def hashed_words(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all lists in order, and where each list's begin."""
    bounds = np.array(list(accumulate(map(len, lists), initial=0)))
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(lists)), np.uint64, int(bounds[-1])), bounds


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty.  ``bytes.split`` cuts it into words at ASCII white space only."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def floor_components(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, x as double; null for a vector that is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda c: F.floor(c * scale)))


def integer_rows(vectors: Iterable) -> np.ndarray:
    """Vectors of one dimension as the rows of an array: 64-bit integers if sums of products of theirs are exact in doubles, else Python integers."""
    v = np.stack([np.asarray(x, np.int64) for x in vectors])
    most = max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
    return v if 8 * most * most * max(1, v.shape[1]) < 2**53 else v.astype(object)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
