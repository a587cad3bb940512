"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are grouped by length into bands of nearly equal norm (approximate
percentiles), and large bands are split by a hash of the id into blocks that fit in
memory.  The longest band gives each query a first bound on its k-th score.  A query then goes only to
those of the other bands whose longest vector can reach its bound; this is decided in Spark, before anything is
copied, and bands without queries are not read.  In a block the bound becomes a local cosine
threshold; the block is pruned either by length (a prefix of the block, sorted by norm) or by one coordinate (the
range that a vector within the cosine threshold can have there), whichever leaves
fewer vectors.  Where neither prunes much, an incremental bound follows, for many queries at once: vectors are turned to the
block's principal axes, the product over the first axes plus the product of what the other axes hold of both lengths
bounds the score, and vectors are dropped after each ``STEPS`` share of the axes.  What is left is verified by exact integer products.  Query
rows meet candidates in blocks of both; what leaves a block is at most k rows a query.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id.  Vectors meet only vectors of their own dimension.  A query excludes
the rows with its own id; repeated candidates count as often as they occur; repeated
equal queries are asked once.  Ties go to the smaller id.  An empty table has no queries and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BANDS = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
#: After which shares of the principal axes vectors are dropped.
STEPS = (0.5, 0.625, 0.75, 0.875)
_FOUND = "qkey bigint, qhash bigint, vkey bigint, score bigint"


def quantised(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``key`` and ``v``: floor(scale * x) of every finite component, for rows that take part."""
    v = F.transform(df[vector], lambda x: x.cast("double"))
    bad = F.exists(df[vector], lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(df[key].isNotNull() & df[vector].isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(df[key].alias("key"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """At most ``k`` verified candidates for each query of one pair of blocks."""
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("qkey", "qhash", "vkey", "score")})
    if not len(candidates) or not len(queries):
        return empty
    c, q = np.stack(candidates["v"].to_numpy()).astype(np.int64), np.stack(queries["v"].to_numpy()).astype(np.int64)
    big = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1]) >= 2**53
    kind = object if big else np.float64
    c, q = c.astype(kind), q.astype(kind)
    norm = np.sqrt((c.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    c, norm, keys = c[order], norm[order], candidates["key"].to_numpy()[order]
    unit = c.astype(float) / np.maximum(norm, 1e-300)[:, None]
    by = np.argsort(unit, axis=0, kind="stable")
    sorted_unit = np.take_along_axis(unit, by, axis=0)
    out, broad = [], []
    for i, (row, bound) in enumerate(zip(q, queries["bound"], strict=True)):
        length = math.sqrt(float((row.astype(float) ** 2).sum()))
        chosen = slice(0, len(c))
        if not pd.isna(bound) and bound > 0 and length > 0:
            cosine = bound / (length * max(norm[0], 1e-300)) * (1 - 1e-9)
            if cosine > 1:
                continue
            n_length = int(np.searchsorted(-norm, -(bound / length) * (1 - 1e-9), side="right"))
            f = int(np.argmax(np.abs(row.astype(float))))
            x = float(row[f]) / length
            spread = math.sqrt(max(0.0, (1 - cosine**2) * (1 - x * x)))
            at_one = math.acos(min(1.0, max(-1.0, x)))
            reach = math.acos(min(1.0, cosine))
            low = x * cosine - spread if at_one + reach < math.pi else -1.0
            high = x * cosine + spread if at_one > reach else 1.0
            a, b = np.searchsorted(sorted_unit[:, f], [low - 1e-9, high + 1e-9])
            chosen = slice(0, n_length) if n_length <= b - a else by[a:b, f]
        if isinstance(chosen, slice) and 2 * chosen.stop >= len(c) and not big:
            broad.append(i)
        else:
            out.append(_best(i, c[chosen] @ row, keys[chosen], queries, k))
    turned = _turned(c) if broad else None
    for part in np.array_split(broad, -(-len(broad) // 64)) if broad else []:
        alive = _promising(turned, q[part], queries["bound"].to_numpy()[part], keys[:, None] != queries["key"].to_numpy()[part][None], k)
        for j, i in enumerate(part):
            rows = np.flatnonzero(alive[:, j])
            out.append(_best(i, c[rows] @ q[i], keys[rows], queries, k))
    return pd.concat(out) if out else empty


def _turned(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The principal axes of some vectors (columns, the longest first), the vectors along them, and the lengths of what is left after each axis."""
    x = c.astype(float)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    y = x @ axes
    return axes, y, _tails(y)


def _tails(y: np.ndarray) -> np.ndarray:
    squares = np.concatenate([np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], axis=1)
    return np.sqrt(squares)


def _promising(turned: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray, bounds: np.ndarray, others: np.ndarray, k: int, shares: list | None = None) -> np.ndarray:
    """Which vectors (rows) may be among the ``k`` best of which queries (columns); ``shares`` gets the part that is left after each step."""
    axes, y, tails = turned
    z = q.astype(float) @ axes
    z_tails, d = _tails(z), y.shape[1]
    # products of rounded numbers are off by less than this
    slack = 1e-9 * (1 + tails[:, :1] @ z_tails[:, :1].T)
    least = np.where(np.isnan(bounds.astype(float)), -np.inf, bounds.astype(float))[None]
    alive, score, at = others.copy(), np.zeros(others.shape), 0
    for share in STEPS:
        to = max(at, int(d * share))
        score += y[:, at:to] @ z[:, at:to].T
        at = to
        rest = tails[:, to : to + 1] @ z_tails[:, to : to + 1].T + slack
        if len(y) > k:
            low = np.where(others, score - rest, -np.inf)
            least = np.maximum(least, np.partition(low, len(low) - k, axis=0)[len(low) - k][None])
        alive &= score + rest >= least
        if shares is not None:
            shares.append(alive.mean())
    return alive


def _best(i: int, scores: np.ndarray, ids: np.ndarray, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of one query's scores, ties to the smaller id."""
    qkey, bound = queries["key"].iat[i], queries["bound"].iat[i]
    keep = ids != qkey
    if not pd.isna(bound):
        keep &= scores >= bound
    scores, ids = scores[keep], ids[keep]
    if len(scores) > 4 * k and scores.dtype != object:
        high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[high], ids[high]
    best = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], int)
    return pd.DataFrame({"qkey": qkey, "qhash": queries["qhash"].iat[i], "vkey": ids[best], "score": [int(s) for s in scores[best]]})


def _blocks(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search the blocks of candidates for the queries that are ``asked`` of their bands (``dim``, ``band``, ``salts``, ``part``)."""
    met = asked.select("dim", "band", "part").distinct()
    left = candidates.join(met, ["dim", "band"]).select("dim", "band", "salt", "part", "key", "v").groupBy("dim", "band", "salt", "part")
    fresh = [F.col(c).alias(f"q_{c}") for c in ("dim", "band", "part")] + [F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("q_salt"), *[F.col(c).alias(c) for c in ("key", "v", "qhash", "bound")]]
    right = asked.select(*fresh).groupBy("q_dim", "q_band", "q_salt", "q_part")
    return left.cogroup(right).applyInPandas(lambda a, b: _search(a, b, k), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.selectExpr("*", "row_number() over (partition by qkey, qhash order by score desc, vkey) as rank").where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, bands: int = BANDS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` for integer vectors ``(key, v)``; ``is_query`` picks the queries."""
    rows = vectors.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    edges = sorted(set(rows.agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)], 10_000)).first()[0] or []))
    band = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: F.col("norm") >= e))
    # each step reads the tables of the ones before: one plan of all of them is more than the driver should hold
    banded = table(rows.withColumn("band", band), "topk_vectors")
    highest = F.max("band").over(Window.partitionBy("dim"))
    # at most one row for each dimension and band
    sizes = table(banded.groupBy("dim", "band").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("salts"), F.max("norm").alias("longest")).withColumn("top", F.col("band") == highest), "topk_bands")
    placed = banded.join(sizes.select("dim", "band", "salts", "top"), ["dim", "band"]).withColumn("salt", F.pmod(F.xxhash64("key", F.spark_partition_id()), F.col("salts")).cast("int"))
    asked = table(banded.where(is_query).select("key", "v", "dim", "norm", F.xxhash64("v").alias("qhash")).distinct(), "topk_queries")
    n_query = max(1, math.ceil(asked.count() / query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n_query)).cast("int"))
    first = table(_blocks(placed.where("top"), asked.withColumn("bound", F.lit(None).cast("double")).join(sizes.where("top"), "dim"), k), "topk_first")
    bounds = _top(first, k).where(F.col("rank") == k).select(F.col("qkey").alias("key"), "qhash", F.col("score").cast("double").alias("bound"))
    able = F.col("bound").isNull() | (F.col("bound") <= F.col("norm") * F.col("longest") * (1 + 1e-9))
    bounded = table(asked.join(bounds, ["key", "qhash"], "left"), "topk_bounded")
    rest = _blocks(placed.where("not top"), bounded.join(sizes.where("not top"), "dim").where(able), k)
    return _top(first.unionByName(rest), k).select(F.col("qkey").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vkey").alias("vec_id"), "score")
