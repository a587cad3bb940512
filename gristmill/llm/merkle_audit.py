"""Merkle fixity audit of two replicas of an archive.

Every record is written out as a WARC resource record and hashed.  Records are
ordered by (position, digest); nodes cover ranges of that order.  Above a position
each level joins 2**bits neighbouring ranges, up to one root.  Where some position has more than ``CROWD``
different records, levels below the positions group records by the first hexadecimal digits of their digests, two
digits a level and as many levels as make groups of about that size; else a position is the lowest node.  A node holds the hash of its
children's hashes and the bytes beneath it.  The audit compares roots and descends
only into nodes that differ; the bytes of the siblings before a node add up to the
offset of a damaged record in the ordered archive, so no global sort is needed.

A null position sorts before all others; null urls and bodies are written as
empty.  Records with equal bytes at one position are counted, not listed, and different ones are dealt to
groups, so no node has more than some hundred children.
Empty replicas are valid: a root of no records differs from any other.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BITS = 6
CROWD = 256
NULL_POSITION = -(2**63)


def warc_record(url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def hashed_records(df: DataFrame, position: str, url: str, body: str) -> DataFrame:
    """``pos``, ``digest``, ``bytes`` of one copy and the number ``n`` of copies."""
    record = warc_record(df[url], df[body])
    leaf = df.select(F.coalesce(df[position].cast("long"), F.lit(NULL_POSITION)).alias("pos"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("bytes"))
    return leaf.groupBy("pos", "digest", "bytes").agg(F.count("*").alias("n"))


def _parent(children: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """Nodes over ``children`` of both sides, hashed in order."""
    item = F.struct(*order, F.col("hash"), F.col("size"))
    return children.groupBy("side", *key).agg(
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order], x["hash"]))), 256).alias("hash"),
        F.sum("size").alias("size"),
    )


def _under(digits: int) -> Column:
    """The group of a record or of a lower group below its position."""
    return F.substring("sub", 1, digits) if digits else F.lit("")


def merkle_levels(records: DataFrame, bits: int = BITS, crowd: int = CROWD) -> tuple[list[tuple[DataFrame, Column]], int]:
    """Tables of nodes ``(node, sub)`` from the lowest level to the root, each with the column that names a node's parent; digits of the lowest ``sub``."""
    most = records.groupBy("side", "pos").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log(max(1, most) / crowd, 256)))
    leaves = records.select("side", F.col("pos").alias("node"), F.col("digest").alias("sub"), F.concat_ws("x", "digest", "n").alias("hash"), (F.col("bytes") * F.col("n")).alias("size"))
    levels, below, up = [], leaves, lambda node, sub: F.struct(node.alias("node"), sub.alias("sub"))
    for d in range(depth, -1, -1):
        below = table(_parent(below, [F.col("node"), _under(2 * d).alias("sub")], ["sub"]), f"merkle-{len(levels)}")
        levels.append((below, up(F.col("node"), _under(2 * d - 2)) if d else up(F.shiftright("node", bits), F.lit(""))))
    low, high = below.agg(F.min("node"), F.max("node")).first()
    while low is not None and low != high and not (low == -1 and high == 0):
        low, high = low >> bits, high >> bits
        below = table(_parent(below, [F.shiftright("node", bits).alias("node"), F.lit("").alias("sub")], ["node"]), f"merkle-{len(levels)}")
        levels.append((below, up(F.shiftright("node", bits), F.lit(""))))
    root = _parent(below.withColumn("child", F.col("node")), [F.lit(0).cast("long").alias("node"), F.lit("").alias("sub")], ["child"])
    levels[-1] = (below, up(F.lit(0).cast("long"), F.lit("")))
    return [*levels, (root, up(F.lit(0).cast("long"), F.lit("")))], 2 * depth


def _compare(nodes: DataFrame, key: list[str]) -> DataFrame:
    """One row for each node of either side: both hashes and sizes."""
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return nodes.groupBy(*key).agg(*[pick(s, c).alias(f"{c}_{s}") for s in ("a", "b") for c in ("hash", "size")])


def _descend(at: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """From differing nodes (``up``) to their differing children, with the offsets where those begin."""
    inside = _compare(nodes.join(at, "up"), ["up", "off_a", "off_b", *key])
    before = lambda s: f"off_{s} + coalesce(sum(size_{s}) over (partition by up order by {', '.join(key)} rows between unbounded preceding and 1 preceding), 0) as off_{s}"
    return inside.selectExpr("up", *key, "hash_a", "hash_b", before("a"), before("b")).where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(primary: DataFrame, replica: DataFrame, position: str = "page_id", url: str = "url", body: str = "html", bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """The records that one replica has more often than the other.

    Columns: the position, ``digest``, ``n_primary``, ``n_replica``, ``n_bytes`` of one copy, and
    ``byte_offset`` of the first copy in the replica that has more.  No row means that the roots agree.
    """
    sides = [hashed_records(d, position, url, body).withColumn("side", F.lit(s)) for d, s in ((primary, "a"), (replica, "b"))]
    records = table(sides[0].unionByName(sides[1]), "merkle-records")
    levels, digits = merkle_levels(records, bits, crowd)
    zero, key = F.lit(0).cast("long"), ["node", "sub"]
    differ = _compare(levels.pop()[0], key).where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    at = differ.select(F.struct(*key).alias("up"), zero.alias("off_a"), zero.alias("off_b"))
    while levels:
        nodes, up = levels.pop()
        at = _descend(at, nodes.withColumn("up", up), key).select(F.struct(*key).alias("up"), "off_a", "off_b")
    below = F.struct(F.col("pos").alias("node"), (F.substring("digest", 1, digits) if digits else F.lit("")).alias("sub"))
    leaves = records.select("side", below.alias("up"), "digest", "bytes", F.col("n").cast("string").alias("hash"), (F.col("bytes") * F.col("n")).alias("size"))
    n_primary, n_replica = (F.coalesce(F.col(f"hash_{s}").cast("long"), zero) for s in ("a", "b"))
    return _descend(at, leaves, ["digest", "bytes"]).select(
        F.when(F.col("up.node") != NULL_POSITION, F.col("up.node")).alias(position),
        "digest",
        n_primary.alias("n_primary"),
        n_replica.alias("n_replica"),
        F.col("bytes").alias("n_bytes"),
        F.when(n_primary > n_replica, F.col("off_a")).otherwise(F.col("off_b")).cast("long").alias("byte_offset"),
    )
