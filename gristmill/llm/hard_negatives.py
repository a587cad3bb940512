"""Hard-negative mining with bit-sliced integer products.

Each anchor's positives are its best rows of the same label; each positive's negatives are the best rows of
other labels whose score lies between two shares of the positive's.  Scores are inner products of integer
vectors.  The components of a block of candidates are held as bit planes; planes are multiplied with the anchors from the most
significant on, and after each plane every pair has an interval that holds its score: what is
known, plus or minus what the remaining bits can add.  A pair is dropped as soon as its interval cannot
qualify: it misses every window of scores, or enough others are certain to be better.  What
is left after the last plane has its exact score.

Positives: rows meet by the hash of their label.  Negatives: anchors and candidates meet in blocks of both, whatever
their labels.  Either way a group of many rows is split into blocks by a hash of the id, so that a label
with most of all rows spreads; equal vectors of one label are multiplied once in a block, and what leaves
a block is bounded by the number of its anchors.  All pairs of anchors and candidates are judged; none is sampled.

Rows without an id or label take no part, nor do vectors that are null or hold null or non-finite components; vectors meet only vectors
of their dimension.  An anchor's positives exclude the rows with its own id; repeated candidates count as often as they
occur, repeated equal anchors are asked once.  Ties go to the smaller id.  An anchor without positives, or a positive whose window
is empty (for one, because its score is negative), gives no rows; nor does an empty table.  Scores beyond a long are its greatest or least value.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import floor_components, integer_rows

SIDE_ROWS = 8192
CHUNK = 32
DENSE = 0.2
_LEAST = -(2**62)
MOST = 2**63 - 1


class Planes:
    """Integer vectors as bit planes, most significant first: each component is ``least`` plus its bits."""

    def __init__(self, v: np.ndarray):
        self.n, self.d = v.shape
        self.least = int(v.min()) if v.size else 0
        rest = v.astype(object) - self.least if v.dtype == object else v - self.least
        self.bits = int(rest.max()).bit_length() if v.size else 0
        self.packed = [np.packbits(((rest >> b) & 1).astype(np.uint8), axis=1) for b in range(self.bits)]

    def plane(self, b: int, kind: type, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.unpackbits(self.packed[b][rows], axis=1, count=self.d).astype(kind)


def survivors(c: Planes, q: np.ndarray, alive: np.ndarray, keep: Callable, counts: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row of q, rows of c, exact scores)`` of the pairs that ``keep(rows of q, low, high, alive)`` never dropped.

    ``alive`` (rows of q by rows of c) says which pairs are asked for at all.  ``counts`` gets the pairs multiplied with each plane.
    """
    exact = object if q.dtype == object else np.float64
    by = q.astype(exact)
    below, above = np.where(q < 0, -q, 0).sum(axis=1), np.where(q > 0, q, 0).sum(axis=1)
    score = np.repeat((q.sum(axis=1) * c.least)[:, None], c.n, axis=1)
    b = c.bits
    while b and alive.any() and alive.mean() > DENSE:
        b -= 1
        if counts is not None:
            counts.append(alive.size)
        score = score + (by @ c.plane(b, exact).T).astype(q.dtype) * (1 << b)
        rest = (1 << b) - 1
        alive = keep(np.arange(len(q)), score - (rest * below)[:, None], score + (rest * above)[:, None], alive)
    for i in range(len(q)):
        rows = np.flatnonzero(alive[i])
        known = score[i, rows]
        for at in range(b - 1, -1, -1):
            if not len(rows):
                break
            if counts is not None:
                counts.append(len(rows))
            known = known + (c.plane(at, exact, rows) @ by[i]).astype(q.dtype) * (1 << at)
            rest = (1 << at) - 1
            still = keep(np.array([i]), (known - rest * below[i])[None], (known + rest * above[i])[None], np.ones((1, len(rows)), bool))[0]
            rows, known = rows[still], known[still]
        if len(rows):
            yield i, rows, known


def _bar(low: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k``-th highest lower bound among the pairs chosen, or less than any score if there are fewer."""
    n, least = low.shape[1], -(1 << 200) if low.dtype == object else _LEAST
    if n < k:
        return np.full(len(low), least, low.dtype)
    held = np.where(among, low, least)
    return np.sort(held, axis=1)[:, n - k] if held.dtype == object else np.partition(held, n - k, axis=1)[:, n - k]


def _distinct(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Labels and vectors of a block, each pair once, and the ascending ids of each pair's rows."""
    block = block.sort_values("key", kind="stable")
    v, labels, keys = integer_rows(block["v"]), block["label"].to_numpy(), block["key"].to_numpy()
    place: dict = {}
    number = np.array([place.setdefault((x, tuple(row) if v.dtype == object else row.tobytes()), len(place)) for x, row in zip(labels, v, strict=True)])
    first = np.zeros(len(place), int)
    first[number[::-1]] = np.arange(len(number))[::-1]
    order = np.argsort(number, kind="stable")
    return labels[first], v[first], np.split(keys[order], np.cumsum(np.bincount(number))[:-1])


def _best(rows: np.ndarray, scores: np.ndarray, ids: list[np.ndarray], k: int, own: int | None = None) -> list[tuple[int, int]]:
    """The ``k`` best ``(id, score)`` of the rows behind distinct vectors, ties to the smaller id."""
    out: list[tuple[int, int]] = []
    for score in sorted({int(s) for s in scores}, reverse=True):
        if len(out) >= k:
            break
        tied = np.sort(np.concatenate([(ids[r] if own is None else ids[r][ids[r] != own])[:k] for r in rows[scores == score]]))
        out += [(int(x), min(max(score, -MOST), MOST)) for x in tied[: k - len(out)]]
    return out


def _same_kind(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as 64-bit integers, or both as Python's."""
    if c.dtype != q.dtype or c.size and float(abs(c).max()) * float(abs(q).max()) * 8 * max(1, c.shape[1]) >= 2**53:
        return c.astype(object), q.astype(object)
    return c, q


def _positives(candidates: pd.DataFrame, anchors: pd.DataFrame, k: int, counts: list | None = None) -> pd.DataFrame:
    """The best rows of each anchor's own label in one block."""
    out = []
    for label, asked in anchors.groupby("label") if len(candidates) else ():
        own = candidates[candidates["label"] == label]
        if not len(own):
            continue
        _, v, ids = _distinct(own)
        v, q = _same_kind(v, integer_rows(asked["v"]))
        planes, single = Planes(v), np.array([x[0] if x[0] == x[-1] else -1 for x in ids])
        only = np.array([x[0] == x[-1] for x in ids])
        keys, hashes = asked["key"].to_numpy(), asked["hash"].to_numpy()
        for at in range(0, len(q), CHUNK):
            here = slice(at, at + CHUNK)
            alive = ~(only[None, :] & (single[None, :] == keys[here][:, None]))
            keep = lambda rows, low, high, held: held & (high >= _bar(low, held, k)[:, None])
            for i, rows, scores in survivors(planes, q[here], alive, keep, counts):
                out += [(keys[at + i], hashes[at + i], x, s) for x, s in _best(rows, scores, ids, k, keys[at + i])]
    return pd.DataFrame(out, columns=["akey", "ahash", "pkey", "score"])


def _negatives(candidates: pd.DataFrame, anchors: pd.DataFrame, k: int, low_share: int, high_share: int, counts: list | None = None) -> pd.DataFrame:
    """The best rows of other labels in each window of each anchor, in one block."""
    out = []
    if len(candidates) and len(anchors):
        labels, v, ids = _distinct(candidates)
        v, q = _same_kind(v, integer_rows(anchors["v"]))
        planes, own = Planes(v), anchors["label"].to_numpy()
        positives = [[(p["prank"], -(-low_share * int(p["score"]) // 100), high_share * int(p["score"]) // 100) for p in row] for row in anchors["positives"]]
        most = max(map(len, positives))
        # a window that is missing is empty: its lower end lies above its upper end
        lows = np.array([[p[1] for p in row] + [1] * (most - len(row)) for row in positives], q.dtype)
        highs = np.array([[p[2] for p in row] + [0] * (most - len(row)) for row in positives], q.dtype)
        for at in range(0, len(q), CHUNK):
            here = slice(at, at + CHUNK)

            def keep(rows: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, at: int = at) -> np.ndarray:
                able = np.zeros_like(held)
                for w in range(most):
                    a, b = lows[at + rows, w][:, None], highs[at + rows, w][:, None]
                    fits = held & (high >= a) & (low <= b)
                    sure = fits & (low >= a) & (high <= b)
                    able |= fits & (high >= _bar(low, sure, k)[:, None]) if int(sure.sum(axis=1).max(initial=0)) >= k else fits
                return able

            for i, rows, scores in survivors(planes, q[here], labels[None, :] != own[here][:, None], keep, counts):
                for rank, a, b in positives[at + i]:
                    inside = (scores >= a) & (scores <= b)
                    out += [(anchors["key"].iat[at + i], anchors["hash"].iat[at + i], rank, x, s) for x, s in _best(rows[inside], scores[inside], ids, k)]
    return pd.DataFrame(out, columns=["akey", "ahash", "prank", "nkey", "score"])


def _blocks(rows: DataFrame, anchors: DataFrame, side_rows: int):
    """Candidates and anchors of equal ``dim`` and ``home``, in blocks of at most about ``side_rows`` of either, side by side."""
    at = ["dim", "home"]
    sizes = rows.groupBy(*at).agg(F.ceil(F.count("*") / side_rows).cast("int").alias("salts"))
    asked = anchors.groupBy(*at).agg(F.ceil(F.count("*") / side_rows).cast("int").alias("parts"))
    sizes = sizes.join(asked, at)
    spread = lambda n, salt: F.pmod(F.xxhash64("key", F.spark_partition_id(), F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, at).withColumn("salt", spread("salts", 1)).select(*at, "salt", "key", "label", "v", each("parts").alias("part"))
    right = anchors.join(sizes, at).withColumn("a_part", spread("parts", 2)).select(*[F.col(c).alias(f"a_{c}") for c in at], "a_part", *[F.col(c).alias(c) for c in anchors.columns if c not in at], each("salts").alias("a_salt"))
    return left.groupBy(*at, "salt", "part").cogroup(right.groupBy("a_dim", "a_home", "a_salt", "a_part"))


def vectors(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``key``, ``label`` and ``v`` (``floor(256 * x)``) of the rows that take part."""
    rows = df.select(df[key].alias("key"), label.alias("label"), floor_components(df[vector]).alias("v"))
    return rows.where("key is not null and label is not null and v is not null")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, side_rows: int = SIDE_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``, ``negative_score`` for rows ``(key, label, v)``.

    Negatives have a score between ``low`` and ``high`` percent of the positive's.
    """
    kind = rows.schema["key"].dataType.simpleString()
    named = rows.where("key is not null and label is not null and v is not null").select("key", "label", "v", F.size("v").alias("dim"))
    homes = max(1, -(-named.count() // side_rows))
    by_label = named.withColumn("home", F.pmod(F.xxhash64("label"), F.lit(homes)).cast("int"))
    anchors = by_label.where(is_anchor).withColumn("hash", F.xxhash64("label", "v")).distinct()
    found = _blocks(by_label, anchors, side_rows).applyInPandas(lambda a, b: _positives(a, b, positives), f"akey {kind}, ahash bigint, pkey {kind}, score bigint")
    best = found.selectExpr("*", "row_number() over (partition by akey, ahash order by score desc, pkey) as prank").where(F.col("prank") <= positives)
    lists = best.groupBy(F.col("akey").alias("key"), F.col("ahash").alias("hash")).agg(F.collect_list(F.struct("prank", "pkey", "score")).alias("positives"))
    asked = anchors.drop("home").join(lists, ["key", "hash"]).withColumn("home", F.lit(0))
    mined = _blocks(named.withColumn("home", F.lit(0)), asked, side_rows).applyInPandas(lambda a, b: _negatives(a, b, negatives, low, high), f"akey {kind}, ahash bigint, prank int, nkey {kind}, score bigint")
    ranked = mined.selectExpr("*", "row_number() over (partition by akey, ahash, prank order by score desc, nkey) as rank").where(F.col("rank") <= negatives)
    named_positives = best.select("akey", "ahash", "prank", F.col("pkey").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named_positives, ["akey", "ahash", "prank"]).select(
        F.col("akey").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("nkey").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
