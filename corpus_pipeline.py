"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and calls one operator of ``gristmill.llm``; between stages
the documents are written as Parquet in the shared folder and read again.  All stages but the
last return the columns of ``documents`` (``doc_id, text, lang, source, n_chars``); extra columns are dropped.

1. ``language_id`` learns from labelled rows outside the held-out fold and drops documents
   whose language is unknown (null, no letter) or whose calibrated probability is rejected.
2. ``near_dedup`` keeps one document of each near-duplicate group (similarity 0.8 of
   five-word shingles), the one with the smallest id; repeated rows leave one.
3. ``substring_dedup`` removes every word covered by a repeated window of 35 words.  A document in
   which nothing repeats keeps its text as it is; one of which nothing is left goes.
4. ``pii`` replaces personal data, and secrets in trusted contexts, by the name of their kind in angle brackets.
5. ``packing`` tokenizes the texts and packs them into sequences of 2048 ids.

Null texts go in the first stage.  Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import language_id, near_dedup, packing, pii, suffix_dedup
from gristmill.llm.common import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, model)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80, agree=75, bands=32, rows_each=4)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_spans(docs)
    text = pii.redacted(F.col("text"), F.concat("base", "added"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", _language), ("near_dedup", _near_duplicates), ("substring_dedup", _substrings), ("pii", _personal_data), ("packing", _packing)]

#: The stages learn a model and hash shingles; SQL cannot express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage writes on its way goes when its result is written
            docs = keep(stage(spark, docs, sf_dir).select(*COLUMNS), name)
    return STAGES[-1][1](spark, docs, sf_dir)
