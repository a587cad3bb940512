"""Centroid clustering by Lloyd's rounds with two trees.

Vectors are read once into blocks; each block gets a cover tree (a node's points lie within its radius of its
centre, its children's centres lie further apart than half that radius, and a centre stays the centre of one of its children) and is
written with it to the shared folder.  In each round a cover tree is built over the centroids, and both
trees are descended together: for a node of vectors, nodes of centroids are dropped whose least possible distance exceeds the
greatest that another one guarantees.  A node of vectors for which one centroid is left is assigned whole; the leaves that remain are compared with
their remaining centroids exactly, in integers.

Rounds move little: a task adds up its blocks to one sum for each centroid and component, Spark adds up the tasks, and
the driver holds ``k`` centroids.  Blocks are of bounded size whatever clusters look like, so a cluster with most of
all vectors is no burden on one task.

Vectors that are null, of another number of components than ``dimensions``, or hold null or non-finite components take no part.  Equal
vectors and repeated rows each count and get equal results; ties go to the smaller centroid.  Rows without an id are assigned
(with a null id) but are no starting centroids.  With fewer than ``k`` rows there are as many centroids as rows; an empty table
gives no rows.  Distances and sums of distances beyond a long are its greatest value.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import floor_components, integer_rows, table

BLOCK_ROWS = 2048
LEAF = 16
#: Bounds are rounded outwards by this share, so that rounding never drops a tie.
SLACK = 1e-9
MOST = 2**63 - 1


@dataclass
class CoverTree:
    """Nodes in preorder over points in the order of ``order``: each node owns the points from ``start`` to ``stop``.

    ``centre`` is a point's number, ``radius`` bounds its points' distance to it, ``after`` is the next node that is no descendant.
    """

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    after: np.ndarray

    def is_leaf(self, node: int) -> bool:
        return bool(self.after[node] == node + 1)

    def children(self, node: int) -> list[int]:
        out, at = [], node + 1
        while at < self.after[node]:
            out.append(at)
            at = int(self.after[at])
        return out


def cover_tree(points: np.ndarray, leaf: int) -> CoverTree:
    """The cover tree of floating-point vectors; groups of at most ``leaf`` points are leaves, and so are those of equal points.

    Children of few points become one leaf of their parent, unless ``leaf`` is 1.
    """
    order: list[np.ndarray] = []
    nodes: list[list] = []
    far = lambda rows, at: np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1))

    def add(rows: np.ndarray, centre: int, away: np.ndarray, whole: bool, begin: int) -> None:
        at, radius = len(nodes), float(away.max())
        nodes.append([begin, begin + len(rows), centre, radius * (1 + SLACK), 0])
        if whole or radius == 0 or len(rows) <= leaf:
            order.append(rows)
        else:
            few: list[np.ndarray] = []
            middle, distance = centre, away
            while len(rows):
                near = distance <= radius / 2
                group = rows[near]
                if len(group) <= leaf and leaf > 1:
                    few.append(group)
                else:
                    add(group, middle, distance[near], False, begin)
                    begin += len(group)
                rows, away = rows[~near], away[~near]
                if len(rows):  # the point farthest from the node's centre comes next
                    middle = int(rows[int(np.argmax(away))])
                    distance = far(rows, middle)
            if few:
                rest = np.concatenate(few)
                add(rest, centre, far(rest, centre), True, begin)
        nodes[at][4] = len(nodes)

    everything = np.arange(len(points))
    if not len(points):
        empty = np.zeros(0, np.int64)
        return CoverTree(everything, empty, empty, empty, np.zeros(0), empty)
    add(everything, 0, far(everything, 0), False, 0)
    start, stop, centre, radius, after = (np.array(x) for x in zip(*nodes, strict=True))
    return CoverTree(np.concatenate(order), start, stop, centre, radius.astype(float), after)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of both."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a.dot(b.T)
    x, y = a.astype(float), b.astype(float)  # whole numbers below 2**53
    return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)).astype(np.int64)


def assign(v: np.ndarray, tree: CoverTree, centroids: np.ndarray, compared: list | None = None) -> np.ndarray:
    """The nearest centroid's number for every vector (in the order of ``v``), ties to the smaller.

    ``compared`` gets the number of exact comparisons of each leaf.
    """
    found = np.zeros(len(v), np.int64)
    points, middles = v.astype(float), centroids.astype(float)
    over = cover_tree(middles, 1)
    children = [np.array(over.children(c), np.int64) for c in range(len(over.start))]
    ends = np.array([not len(c) for c in children])
    todo = [(0, np.array([0]))] if len(v) else []
    while todo:
        node, against = todo.pop()
        while True:
            distance = np.sqrt(((middles[over.centre[against]] - points[tree.centre[node]]) ** 2).sum(axis=1))
            slack = SLACK * (distance.max() + tree.radius[node])
            least = distance - tree.radius[node] - over.radius[against]
            against = against[least <= (distance + tree.radius[node]).min() + slack]
            if ends[against].all() or tree.radius[node] > over.radius[against].max():
                break
            against = np.concatenate([[c] if ends[c] else children[c] for c in against])
        rows = tree.order[tree.start[node] : tree.stop[node]]
        numbers = np.sort(np.concatenate([over.order[over.start[c] : over.stop[c]] for c in against]))
        if len(numbers) == 1:
            found[rows] = numbers[0]
        elif tree.radius[node] == 0 or tree.is_leaf(node):
            some = rows[:1] if tree.radius[node] == 0 else rows
            found[rows] = numbers[np.argmin(_square(v[some], centroids[numbers]), axis=1)]
            if compared is not None:
                compared.append(len(some) * len(numbers))
        else:
            todo += [(c, against) for c in tree.children(node)]
    return found


_BLOCK = "n long, wide boolean, ids binary, v binary, tree binary, radius binary"


def _packed(keys: list, v: np.ndarray) -> dict:
    """A block of vectors and its tree as one row."""
    tree = cover_tree(v.astype(float), LEAF)
    wide = v.dtype == object
    ids = np.array([(0, 0) if x is None else (1, x) for x in keys], np.int64)
    kind = np.int64 if wide or abs(v).max(initial=0) >= 2**15 else np.int16
    numbers = np.concatenate([tree.order, tree.start, tree.stop, tree.centre, tree.after]).astype(np.int32)
    return {"n": len(v), "wide": kind is np.int64, "ids": ids.tobytes(), "v": v.astype(kind).tobytes(), "tree": numbers.tobytes(), "radius": tree.radius.tobytes()}


def _unpacked(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    """Ids (whether there is one, and which), vectors and tree of a block."""
    n, radius = row["n"], np.frombuffer(row["radius"])
    v = np.frombuffer(row["v"], np.int64 if row["wide"] else np.int16).reshape(n, d).astype(np.int64)
    numbers = np.frombuffer(row["tree"], np.int32)
    parts = [numbers[:n], *np.split(numbers[n:], 4)]
    return np.frombuffer(row["ids"], np.int64).reshape(n, 2), integer_rows(v), CoverTree(*parts[:4], radius, parts[4])


def blocks(rows: DataFrame, dimensions: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors ``(key, v)`` as blocks with their cover trees, cut as they are read, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], []

        def out() -> pa.RecordBatch:
            row = _packed(keys, integer_rows(held))
            return pa.RecordBatch.from_pydict({c: [x] for c, x in row.items()}, pa.schema([("n", pa.int64()), ("wide", pa.bool_()), *[(c, pa.binary()) for c in ("ids", "v", "tree", "radius")]]))

        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dimensions)
            for key, v in zip(batch.column("key").to_pylist(), flat, strict=True):
                keys.append(key)
                held.append(v)
                if len(keys) == block_rows:
                    yield out()
                    keys, held = [], []
        if keys:
            yield out()

    return rows.select(F.col("key").cast("long").alias("key"), "v").mapInArrow(run, _BLOCK)


def _sums(found: DataFrame, centroids: list[list[int]], d: int) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of each non-empty centroid's vectors."""
    middles = integer_rows(centroids) if max(map(abs, sum(centroids, [])), default=0) < 2**62 else np.array(centroids, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), d + 1), object)
        for batch in batches:
            for row in batch.to_pylist():
                _, v, tree = _unpacked(row, d)
                number = assign(v, tree, middles)
                for c in np.unique(number):
                    own = v[number == c]
                    total[c] += np.array([*own.sum(axis=0).tolist(), len(own)], object)
        c, at = np.divmod(np.arange(total.size), d + 1)
        given = np.repeat(total[:, d] > 0, d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c[given]), pa.array(at[given]), pa.array([str(x) for x in total.ravel()[given]])], ["cluster", "part", "total"])

    parts = found.mapInArrow(run, "cluster long, part long, total string")
    sums = parts.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (d + 1) rows at most
    out: dict[int, list[int]] = {}
    for r in sums:
        out.setdefault(r["cluster"], [0] * (d + 1))[r["part"]] = int(r["total"])
    return {c: (x[d], x[:d]) for c, x in out.items()}


def vectors(df: DataFrame, key: str, vector: str, dimensions: int = 64) -> DataFrame:
    """``key`` and ``v`` (``floor(256 * x)``) of the vectors that take part."""
    rows = df.select(df[key].alias("key"), F.when(F.size(df[vector]) == dimensions, floor_components(df[vector])).alias("v"))
    return rows.where("v is not null")


def cluster(rows: DataFrame, seed: F.Column, k: int = 40, rounds: int = 5, dimensions: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid`` for integer vectors ``(key, v)``.

    Centroids start as the ``k`` rows with the smallest ``seed``; rows whose seed is null are none of them.
    """
    spark = rows.sparkSession
    first = rows.withColumn("seed", seed).where("seed is not null").orderBy("seed", "v").limit(k).collect()  # k rows
    centroids = [list(r["v"]) for r in first]
    made = table(blocks(rows, dimensions, block_rows), "vector_blocks")
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _sums(made, centroids, dimensions).items():
            centroids[c] = [x // n for x in total]
    middles = integer_rows(centroids) if centroids else None

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v, tree = _unpacked(row, dimensions)
                keys = pa.array(ids[:, 1], mask=ids[:, 0] == 0)
                if middles is None:
                    none = pa.nulls(len(v), pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, none.cast(pa.int32()), none], ["key", "cluster", "distance"])
                    continue
                number = assign(v, tree, middles)
                distance = np.zeros(len(v), np.int64)
                for c in np.unique(number):
                    own = number == c
                    distance[own] = np.minimum(_square(v[own], middles[c][None])[:, 0], MOST)
                yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(distance)], ["key", "cluster", "distance"])

    found = table(made.mapInArrow(last, "key long, cluster int, distance long"), "assigned")
    within = found.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows at most
    total = min(MOST, sum(int(r["total"]) for r in within))
    about = [(r["cluster"], min(MOST, int(r["total"])), total, [int(x) for x in centroids[r["cluster"]]]) for r in within]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster", "left").select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
