"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased UTF-8; its subwords are runs of 3 to 5 bytes with no white space
inside (a neighbouring space marks the edge of a word), hashed into a fixed number of rows.  The text is
the mean of its subwords' embeddings; a linear softmax gives a probability for each
language.  A prediction averages embeddings of ``DIMENSIONS`` numbers and applies the weights once a text; with fewer labels than that the weights are applied to the embeddings beforehand.  Embeddings and weights are learned together by stochastic gradient descent in
numpy, on the driver, from a sample whose size is bounded by ``sample_rows``, or by one row
for each label if there are more labels; executors turn the sampled texts into counts of
whole texts first.  Every non-null label with a text that is not blank is learned; the model
takes 2 MB and 128 bytes for each label, on the driver and in each task.  A part of the sample is held
back to calibrate a temperature and the level below which a prediction is rejected: the lower of ``SURE`` and the
probability that all but ``LOST`` of that part's correct predictions reach.  A text is rejected too if its subwords are
strange: their mean logarithmic frequency in the sample is less than ``FAMILIAR`` times what all but ``LOST`` of that part
reach.  That catches languages that were not learned, for which the softmax alone may be sure.

Texts that are null or hold no letter get the label ``und`` with score 0.  So does every
text if there is no labelled row to learn from.  Repeated rows and equal texts get equal
results; other columns are ignored.  Prediction is a map over rows without a shuffle, in
slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
DIMENSIONS = 16
SAMPLE_ROWS = 1600
EPOCHS, UPDATES = 12, 500
BATCH = 32
RATE = 2.0
SURE = 0.5
LOST = 0.005
FAMILIAR = 0.5
SEED = 9
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text number, bucket)`` of all subwords of each size, texts in order."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(x) for x in raw])
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    wide = data.astype(np.uint64) + np.uint64(1)
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        inside = owner[:n] == owner[size - 1 :]
        for j in range(size):
            h = (h ^ wide[j : j + n]) * _PRIMES[j]
            if 0 < j < size - 1:
                inside &= ~space[j : j + n]
        h ^= h >> np.uint64(29)
        yield owner[:n][inside], (h[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Languages, embeddings with the logarithmic frequency as last column, weights, bias, inverse temperature and the levels of rejection."""

    languages: tuple[str, ...]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float
    level: float
    floor: float = 0.0

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and how familiar the subwords are, of each text."""
        total, n = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for owner, bucket in subwords(texts):
            if not len(owner):
                continue
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[first]] += np.add.reduceat(self.table[bucket], first, axis=0)
            n += np.bincount(owner, minlength=len(texts))
        mean = total / np.maximum(n, 1)[:, None]
        return (mean[:, :-1] @ self.weights + self.bias) * self.sharpness, mean[:, -1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Label, probability and whether it is rejected, for each text."""
        judged = [bool(t) and _LETTER.search(t) is not None for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        z, familiar = self.measure([t if ok else "" for t, ok in zip(texts, judged, strict=True)])
        p = softmax(z)
        best = p.argmax(axis=1)
        return [(self.languages[b], float(row[b]), bool(row[b] < self.level or f < self.floor)) if ok else (UNKNOWN, 0.0, True) for ok, b, row, f in zip(judged, best, p, familiar, strict=True)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(labelled: DataFrame, text: str, label: str, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled rows, as many of each label as there are; at least one of each label."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), key, text), F.lit(1 << 30))
    known = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\S")).withColumn("draw", draw)
    counts = known.groupBy(label).agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()  # one row for each label, as in the model
    if not counts:
        return known.limit(0)
    each = max(1, rows // len(counts))
    # the least draw is always within the bound, so that no label is lost by chance
    bounds = [(r[label], max(r["least"], int(min(1.0, (1.3 * each + 20) / r["n"]) * (1 << 30)))) for r in counts]
    kind = labelled.schema[label].dataType.simpleString()
    bound = labelled.sparkSession.createDataFrame(bounds, f"bounded {kind}, bound long")
    drawn = known.join(F.broadcast(bound), F.col(label) == F.col("bounded")).where("draw <= bound").drop("bounded", "bound")
    return drawn.selectExpr("*", f"row_number() over (partition by `{label}` order by draw, `{key}`) as nth").where(F.col("nth") <= each)


def _counted(rows: DataFrame, text: str, label: str) -> DataFrame:
    """``label``, ``buckets`` and ``shares`` of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            parts = list(subwords(texts))
            owner, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            found, n = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(found, np.arange(len(texts) + 1) * BUCKETS)
            buckets = [(found[a:b] % BUCKETS).astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            shares = [(n[a:b] / max(1, n[a:b].sum())).astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["label", "buckets", "shares"])

    return rows.select(F.col(label).alias("label"), F.col(text).alias("text"), "draw").orderBy("label", "draw").drop("draw").mapInArrow(run, "label string, buckets binary, shares binary")


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn every label from at most ``sample_rows`` rows, or one a label; each fifth row of a label calibrates."""
    rows = _counted(sample(labelled, text, label, key, sample_rows), text, label).collect()
    rows = [r for r in rows if len(r["buckets"])]
    names = tuple(sorted({r["label"] for r in rows}))
    if not names:
        return Model((), np.zeros((BUCKETS, 1)), np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[r["label"]] for r in rows])

    def dense(part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), BUCKETS), np.float32)
        for i, k in enumerate(part):
            x[i, np.frombuffer(rows[k]["buckets"], np.uint16)] = np.frombuffer(rows[k]["shares"], np.float32)
        return x

    draw = np.random.default_rng(SEED)
    # each fifth row of a label calibrates, so that a label of few rows is learned
    place = np.arange(len(rows)) - np.searchsorted(y, y)
    held = place % 5 == 4
    fit = np.flatnonzero(~held)
    e = draw.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = draw.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    scale = np.float32(np.sqrt(BUCKETS) / 4)
    epochs = max(EPOCHS, -(-UPDATES * BATCH // len(fit)))  # a small sample is gone through more often
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        for part in np.array_split(draw.permutation(fit), max(1, len(fit) // BATCH)):
            xb = dense(part)
            h = xb @ e
            d = softmax(h @ w + b)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            back = d @ w.T
            w -= rate * (h.T @ d)
            b -= rate * d.sum(axis=0)
            e -= rate * scale * (xb.T @ back)
    e, w = e.astype(np.float64), w.astype(np.float64)
    judged = np.flatnonzero(held) if held.any() else fit
    z, truth = np.concatenate([dense(p) @ e @ w + b for p in np.array_split(judged, -(-len(judged) // BATCH))]), y[judged]
    grid = np.geomspace(0.25, 16, 25)
    loss = [-np.log(np.maximum(softmax(z * s)[np.arange(len(truth)), truth], 1e-12)).mean() for s in grid]
    sharpness = float(grid[int(np.argmin(loss))])
    p = softmax(z * sharpness)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    level = float(min(SURE, np.quantile(right, LOST, method="lower"))) if len(right) else SURE
    share = np.zeros(BUCKETS)
    for part in np.array_split(fit, max(1, len(fit) // BATCH)):
        share += dense(part).sum(axis=0)
    often = np.log1p(share / max(1, len(fit)) * BUCKETS)
    familiar = np.concatenate([dense(p) @ often for p in np.array_split(judged, -(-len(judged) // BATCH))])
    floor = float(FAMILIAR * np.quantile(familiar, LOST, method="lower"))
    if len(names) < DIMENSIONS:  # the shorter of the two forms of one product
        e, w = e @ w, np.eye(len(names))
    return Model(names, np.concatenate([e, often[:, None]], axis=1), w, b.astype(np.float64), sharpness, level, floor)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = model.predict(batch.column("text").to_pylist())
            label, score, rejected = map(list, zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(label), pa.array(score, pa.float64()), pa.array(rejected)], ["key", "lang_pred", "score", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def keep_identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is known and not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept = [not rejected for _, _, rejected in model.predict(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(kept))], ["row"])

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))
