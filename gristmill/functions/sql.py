"""Names for Spark SQL: the functions that run in Python, and the schedule of stream checks as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import detectors
from ..sources import scans
from ..streaming import guard
from . import json as j

#: Rows that a Python worker holds at a time.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

NAMES = {
    "compression_ratio": detectors._lz_ratio,
    "is_json": j._is_json,
    "string_leaves": j._spans,
    "extract_text": scans._find_text,
    "extract_scores": scans._find_scores,
}


@F.udtf(returnType="at_chars bigint, kind string, span string")
class StreamChecks:
    """The spans that become due while a text comes in chunks of one size; for lateral joins.  None for null texts."""

    def eval(self, text: str | None, chunk: int) -> Iterator[tuple[int, str, str]]:
        c, s = guard._Counters(), guard.Schedule()
        for at in range(0, len(text or ""), chunk):
            if c.take(len(text[at : at + chunk]), s)[0]:
                yield c.n, "window", text[max(0, c.n - s.window) : c.n]


def register(spark: SparkSession, prefix: str = "gristmill_") -> None:
    """Make the functions known to ``spark.sql`` of this session.

    Where the session has Spark's default, workers get ``BATCH_ROWS`` rows at a time: whole texts go to them, several functions to a row.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    for name, function in NAMES.items():
        spark.udf.register(prefix + name, function)
    spark.udtf.register(prefix + "stream_checks", StreamChecks)
