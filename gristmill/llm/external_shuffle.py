"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records by seeded hashes: the shard of a record is the one with
the highest hash of (seed, key, shard number), so the key and the number of shards
alone decide, and a further shard takes records only into itself.  Inside a shard
a second hash of the whole record and of the partition it was read from picks one
of several buckets of about ``bucket_bytes``; one exchange deals the buckets to as many tasks, up to ``MAX_TASKS``.
Pass two applies a Fisher-Yates shuffle (Spark's ``shuffle``) to each bucket, and buckets follow each other.

A task holds its buckets as arrays: one or a few where there are enough tasks, and never more than
128 at once, since Spark's aggregation falls back to sorting beyond that.  The places of a bucket come
from the sizes of the same grouped buckets (the exchange is reused).  A bucket is sorted by a seeded hash before it is permuted,
and the permutation depends on the seed and on the bucket's place among the tasks, which follows from the
number of buckets; a task that runs again after a lost executor gives the same order.  Equal records may hold any share of the
rows: their bucket also depends on the partition they were read from.  A null key is a key.
Texts may be null or empty.  An empty table gives no rows.  An input column that is called like
one of the two new columns is kept as ``input_shard`` or ``input_slot``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20_240
BUCKET_BYTES = 4 << 20
MAX_TASKS = 20_000


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """Highest-random-weight choice among ``n_shards``; null only if there is no shard."""
    weights = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(n_shards)]
    return F.array_max(F.array(*weights))["s"]


def shuffle_into_shards(
    df: DataFrame, key: str, record: list[str] | None = None, n_shards: int = 24, seed: int = SEED,
    record_bytes: Column | None = None, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``record`` columns (default: all) plus ``shard`` int and ``slot`` long, gapless from 0 in each shard.

    ``record_bytes`` is a record's size in memory, by which the number of buckets is set.
    """
    record = list(record or df.columns)
    total = df.agg(F.sum((record_bytes if record_bytes is not None else F.lit(64)).cast("long"))).first()[0] or 0
    per_shard = max(1, math.ceil(total / (n_shards * bucket_bytes)))
    names = [f"input_{c}" if c in ("shard", "slot") else c for c in record]
    n_buckets = n_shards * per_shard
    row = F.struct(*[df[c].alias(f"r{i}") for i, c in enumerate(record)])
    inside = F.pmod(F.xxhash64(F.lit(seed + 1), row, F.spark_partition_id()), F.lit(per_shard))
    scattered = df.select(
        (shard_of(df[key], n_shards, seed) * F.lit(per_shard).cast("long") + inside).alias("bucket"),
        F.struct(F.xxhash64(F.lit(seed + 2), row).alias("h"), row.alias("row")).alias("item"),
    ).repartition(min(n_buckets, MAX_TASKS), "bucket")
    grouped = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    sizes = grouped.select("bucket", F.expr(f"bucket div {per_shard}").alias("shard"), F.size("items").cast("long").alias("n"))
    before = sizes.selectExpr("bucket", "cast(shard as int) as shard", "coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0) as before")
    mixed = grouped.select("bucket", F.shuffle("items", seed).alias("items")).join(before, "bucket")
    slots = mixed.select("shard", "before", F.posexplode("items").alias("at", "item"))
    return slots.select(*[F.col(f"item.row.r{i}").alias(c) for i, c in enumerate(names)], "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write one folder for each shard, each task's rows in the order of their slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
