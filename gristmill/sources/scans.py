"""Scans of texts, logged responses, logged scores and labelled fixtures."""

from __future__ import annotations

import json
import math
import sys
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import parse
from ..functions.text import trim
from ..operators.check import CODES

# The fields a logged response may stand in, in order.
TEXT_FIELDS = ("text", "output", "content", "response", "completion", "answer")

#: Of so many blocks of files the table of line numbers is broadcast, at 24 bytes each.
MOST_BLOCKS = 4_000_000

FIXTURE = (
    "id string, note string, text string, category string, expect array<string>, "
    "options struct<expectJson: boolean, requiredKeys: array<string>, expectLang: string, expectScript: string, minLength: int, maxTruncation: double, finishReason: string>, "
    "measured struct<chars: int, wordTokens: int, nonSpacedRatio: double, tailNonSpacedRatio: double, tailLoop: struct<score: double, mode: string>, scores: map<string, double>>"
)


def find_text(value: Any) -> str | None:
    """The response text in a logged value of any shape, or None."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        for name in TEXT_FIELDS:
            if isinstance(value.get(name), str) and value[name]:
                return value[name]
        choices = value.get("choices")
        if isinstance(choices, list):
            messages = [c.get("message") for c in choices if isinstance(c, dict)]
            joined = "".join(m["content"] for m in messages if isinstance(m, dict) and isinstance(m.get("content"), str))
            if joined:
                return joined
        blocks = value.get("content")
        if isinstance(blocks, list):
            joined = "".join(b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
            if joined:
                return joined
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    for child in children:
        if isinstance(child, dict | list) and (found := find_text(child)):
            return found
    return None


def find_scores(value: Any) -> tuple[dict[str, float], dict[str, str] | None] | None:
    """Scores and modes in a logged value of any shape, or None."""
    if not isinstance(value, dict):
        return None
    raw = value.get("modes")
    modes = {c: raw[c] for c in CODES if isinstance(raw, dict) and raw.get(c) in ("word", "char")} or None
    for name in ("scores", "verdict", "guard"):
        if found := find_scores(value.get(name)):
            return found[0], found[1] or modes
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
    scores = {c: float(value[c]) for c in CODES if number(value.get(c))}
    return (scores, modes) if scores else None


@F.pandas_udf(T.StringType())
def _find_text(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: find_text(parse(s)[1]))


_SCORES = T.StructType([T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())), T.StructField("modes", T.MapType(T.StringType(), T.StringType()))])


@F.pandas_udf(_SCORES)
def _find_scores(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find_scores(parse(s)[1]) or (None, None) for s in lines], columns=["scores", "modes"])


def extract_text(line: Column) -> Column:
    """The response text of a logged JSON line; null if there is none."""
    return _find_text(line)


def extract_scores(line: Column) -> Column:
    """``struct(scores, modes)`` of a logged JSON line; null fields if there are none."""
    return _find_scores(line)


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``label`` (path) and ``text``: one row for each whole file.

    Scans skip empty files, so the list of files is joined back; an empty file has an empty text.
    """
    files = spark.read.text(paths, wholetext=True)
    name = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    labels = spark.createDataFrame([(f,) for f in files.inputFiles()], "label string").select(name(F.col("label")).alias("label"))
    texts = files.select(name(F.col("_metadata.file_path")).alias("label"), F.col("value").alias("text"))
    return labels.join(texts, "label", "left").select("label", F.coalesce("text", F.lit("")).alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path``, ``line_no`` (from 1, blank lines counted) and ``line`` of text files, which may be split.

    A block's lines lie together in one task, so their running ids count from the block's least.  The number of lines in the blocks before is added
    from a table of blocks (three numbers each) that is broadcast up to ``MOST_BLOCKS`` rows; lines themselves are not shuffled.
    """
    files = spark.read.option("lineSep", "\n").text(paths)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    found = rows.groupBy(F.xxhash64("path").alias("file"), F.col("block").alias("start")).agg(F.min("at").alias("least"), F.count("*").alias("lines"))
    starts = found.selectExpr("file", "start", "least - coalesce(sum(lines) over (partition by file order by start rows between unbounded preceding and 1 preceding), 0) - 1 as zero")
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    blocks = size // max(1, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) + len(files._jdf.inputFiles())
    placed = rows.join(F.broadcast(starts) if blocks <= MOST_BLOCKS else starts, (F.xxhash64(rows["path"]) == F.col("file")) & (rows["block"] == F.col("start")))
    return placed.select("path", (F.col("at") - F.col("zero")).cast("long").alias("line_no"), "line")


def read_responses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``label`` (``path:line``) and ``text`` of JSON lines; the text is null where none is recognised.  Blank lines are dropped."""
    lines = read_lines(spark, paths).where(trim(F.col("line")) != "")
    return lines.select(F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("label"), extract_text(F.col("line")).alias("text"))


def read_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``scores`` and ``modes`` of JSON lines; both null where none are recognised.  Blank lines are dropped."""
    lines = spark.read.text(paths).where(trim(F.col("value")) != "")
    return lines.select(extract_scores(F.col("value")).alias("found")).select("found.scores", "found.modes")


def read_stdin(spark: SparkSession, jsonl: bool = False) -> DataFrame:
    """``label`` and ``text`` from standard input, read by the driver."""
    raw = sys.stdin.read()
    if not jsonl:
        return spark.createDataFrame([("stdin", raw)], "label string, text string")
    lines = [(f"stdin:{i}", line) for i, line in enumerate(raw.split("\n"), 1) if line.strip()]
    return spark.createDataFrame(lines, "label string, line string").select("label", extract_text(F.col("line")).alias("text"))


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled fixtures, one JSON object a file; ``expectScript`` becomes an array, ``label`` is the parent folder."""
    rows = spark.read.schema(FIXTURE).option("multiLine", True).json(folder).withColumn("label", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    script = F.col("options.expectScript")
    scripts = F.when(script.startswith("["), F.from_json(script, "array<string>")).otherwise(F.when(script.isNotNull(), F.array(script)))
    return rows.withColumn("options", F.col("options").withField("expectScript", scripts)).orderBy("id")


def dump(value: Any) -> str:
    """Compact JSON."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
