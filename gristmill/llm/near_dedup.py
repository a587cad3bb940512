"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set is its distinct shingles of ``WORDS`` words (ASCII letters lower-cased; a shorter text is one
shingle).  Documents with the same words in the same order (by SHA-256) are one class, represented by its smallest
id.  For each class a SuperMinHash signature is computed: every shingle visits the positions in its own random
order and offers its round plus a random fraction, so that later rounds cannot improve full signatures and stop
early.  Bands of rows become buckets.

Links inside a bucket are found without listing its pairs.  First every member is compared with the bucket's
hub, the member that shares most buckets with most documents (in a family of edited copies, the one they come
from); hubs with many members are dealt out in parts, and a part gets the hub's text once.  Members
are labelled by the least hub they reach over links to hubs.  Only buckets that still show several labels are searched
further, in blocks of bounded size: members with the hub's label on one side, all others on the
other.  A pair with different labels whose signatures agree enough is verified and joined in a
union-find of the block at once, so a block returns at most a forest; in the other buckets that the pair shares it is passed over.  Blocks
see signatures first; a text is sent only to the blocks where some signature agrees with its own.  What is
known of a bucket or a hub is written before its members are joined to it, so that Spark can split a large one over tasks; sides that
grow with the corpus are merged at every size and never broadcast.  Verified means
``100 * |A & B| >= percent * |A | B|`` on the full sets of the words themselves, no hashes.

With 26 bands of 5 rows a pair of similarity 0.85 misses all buckets with a probability of 3e-7;
at 84 of 130 equal positions the filter of a block misses it with about 1e-9.  For a similarity of 0.8, 32 bands
of 4 rows miss with 5e-8, and 75 of 128 equal positions with about 1e-9.

Null and empty texts, and texts without words, have the empty set and link with nothing.  Rows
without an id link with nothing and are kept.  Repeated rows are one class and get equal results.
Ids should be unique: where different texts share an id, links of that id are verified on one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, raw_texts, slices, table
from .components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 26, 5
AGREE = 84
BLOCK_SHINGLES = 300_000


def shingle_hashes(lists: list[list[bytes]], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each list of words, and where each list's begin."""
    words, bounds = hashed_words(lists)
    n, owner = np.diff(bounds), np.repeat(np.arange(len(lists)), np.diff(bounds))
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        h = mix(h + words[j : j + len(h)])
    whole = np.flatnonzero(owner[: len(h)] == owner[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    values, owners = [h[whole]], [owner[whole]]
    for i in np.flatnonzero((n > 0) & (n < size)):
        x = np.zeros(1, np.uint64)
        for w in words[bounds[i] : bounds[i + 1]]:
            x = mix(x + w)
        values.append(mix(x + n[i : i + 1].astype(np.uint64)))
        owners.append(np.array([i]))
    h, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(lists) + 1))


def shingle_set(words: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)}


def super_minhash(h: np.ndarray, bounds: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """A signature of ``m`` values for each set; round in the upper, random fraction in the lower 32 bits."""
    docs = len(bounds) - 1
    sign = np.full(docs * m, np.uint64(m) << np.uint64(32), np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    order: np.ndarray | None = None
    for j in range(m):
        if not len(owner):
            break
        x = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = (x & np.uint64(0xFFFFFFFF)) | (np.uint64(j) << np.uint64(32))
        k = (j + ((x >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if order is None:
            place = k
        else:
            rows = np.arange(len(h))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(sign, owner * m + place, value)
        open_ = sign.reshape(docs, m).max(axis=1) >= np.uint64(j + 1) << np.uint64(32)
        live = open_[owner]
        if order is None:
            h, owner, k = h[live], owner[live], k[live]
            order = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
            order[np.arange(len(h)), k] = 0
        elif live.mean() < 0.8:
            h, owner, order = h[live], owner[live], order[live]
    return sign.reshape(docs, m)


def _bands(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sign), bands)).copy()
    for r in range(rows):
        out = mix(out + sign[:, r : bands * rows : rows])
    return out.view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch], n_bands: int, n_rows: int) -> Iterator[pa.RecordBatch]:
    """Size of each document's set, digest of its words, buckets and one byte of each value of the signature."""
    for batch in slices(batches, "text"):
        lists = [t.lower().split() for t in raw_texts(batch.column("text"))]
        h, bounds = shingle_hashes(lists)
        sign = super_minhash(h, bounds, n_bands * n_rows)
        bands = _bands(sign, n_bands, n_rows)
        buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.ravel()))
        marks = (mix(sign) & np.uint64(255)).astype(np.uint8)
        names = [sha256(b" ".join(w)).digest() for w in lists]
        columns = [batch.column("key"), pa.array(np.diff(bounds), pa.int64()), pa.array(names, pa.binary()), buckets, pa.array([x.tobytes() for x in marks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n", "same", "bands", "marks"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, "text"):
        packed = [press.compress(b" ".join(t.lower().split())) for t in raw_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "packed"])


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    """Whether two sets are similar enough."""
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(percent: int):
    """Verified links of hubs with the members dealt to each of their parts."""

    def run(rows: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        text = lambda i: shingle_set(open_.decompress(rows.column("packed")[i].as_py()).split(b" "))
        u, part, node = (rows.column(c).to_numpy() for c in ("u", "part", "node"))
        us, vs, at, hub = [], [], None, set()
        for i in np.lexsort((node != u, part, u)).tolist():
            if (u[i], part[i]) != at:
                at, hub = (u[i], part[i]), text(i)
            elif linked(hub, text(i), percent):
                us.append(int(u[i]))
                vs.append(int(node[i]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _agreeing(rows: pa.Table, percent: int, agree: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of the lower block with the differently labelled ones it is to be compared with in this bucket, by their signatures."""
    label, part, n = (rows.column(c).to_numpy() for c in ("label", "part", "n"))
    marks = np.stack([np.frombuffer(x, np.uint8) for x in rows.column("marks").to_pylist()])
    bands, nth = np.array(rows.column("bands").to_pylist()), rows.column("nth")[0].as_py()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    for i in np.flatnonzero(part == low).tolist():
        far = (label != label[i]) & (part == high) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        far[: i + 1] &= low != high
        others = np.flatnonzero(far)
        others = others[(marks[others] == marks[i]).sum(axis=1) >= agree]
        # a pair that shares several buckets is verified in the first of them
        yield i, others[(bands[others] == bands[i]).argmax(axis=1) == nth]


def _met(percent: int, agree: int):
    """The members of one pair of blocks that have anything to be compared with there."""

    def run(rows: pa.Table) -> pa.Table:
        met = np.zeros(rows.num_rows, bool)
        for i, others in _agreeing(rows, percent, agree):
            met[others] = True
            met[i] |= len(others) > 0
        return rows.filter(pa.array(met))

    return run


def _block(percent: int, agree: int):
    """Verified links between differently labelled members of one pair of blocks of a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        node, label = (rows.column(c).to_numpy() for c in ("node", "label"))
        up = {x: x for x in label.tolist()}
        sets: dict[int, set] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def shingles(i: int) -> set:
            if i not in sets:
                sets[i] = shingle_set(open_.decompress(rows.column("packed")[i].as_py()).split(b" "))
            return sets[i]

        us, vs = [], []
        for i, others in _agreeing(rows, percent, agree):
            for j in others.tolist():
                a, b = root(int(label[i])), root(int(label[j]))
                if a != b and linked(shingles(i), shingles(j), percent):
                    up[a] = b
                    us.append(int(node[i]))
                    vs.append(int(node[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, agree: int = AGREE, bands: int = BANDS, rows_each: int = ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` of each document."""
    rows = df.select(df[key].cast("long").alias("key"), df[text].alias("text"))
    seen = table(rows.mapInArrow(lambda batches: _survey(batches, bands, rows_each), "key bigint, n bigint, same binary, bands array<bigint>, marks binary"), "survey")
    classes = table(seen.where("key is not null and n > 0").groupBy("same").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "classes")
    buckets = classes.select("node", "n", F.posexplode("bands").alias("nth", "band"))
    counts = table(buckets.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    shared = table(buckets.join(counts.hint("merge"), "band"), "shared")
    central = shared.join(shared.groupBy("node").agg(F.sum("m").alias("company")), "node")
    hubs = central.groupBy("band").agg(F.max(F.struct("company", F.bitwise_not("node").alias("not_node"), "n")).alias("h")).select("band", F.bitwise_not("h.not_node").alias("hub"), F.col("h.n").alias("hub_n"))
    members = table(shared.join(table(hubs, "hubs").hint("merge"), "band"), "members")

    pairs = members.where(f"node <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.col("hub").alias("u"), F.col("hub_n").alias("n"), F.col("node").alias("v"), "m")
    parts = F.ceil(F.max("m") * F.max("n") / block_shingles)
    stars = table(pairs.groupBy("u", "v").agg(F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"), F.max("n").alias("n")), "stars")
    size, count = stars.agg(F.sum("n"), F.count("*")).first()
    n_buckets = max(1, math.ceil((size or 0) / block_shingles), min(count, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    asked = stars.select("u", "part", F.col("v").alias("node")).unionByName(stars.select("u", "part", F.col("u").alias("node")).distinct())
    texts = rows.select(F.col("key").alias("node"), "text").where("node is not null").mapInArrow(_packed, "node bigint, packed binary")
    held = table(texts.join(members.select("node").distinct().hint("merge"), "node").groupBy("node").agg(F.min("packed").alias("packed")), "held")
    dealt = asked.join(held, "node").withColumn("bucket", F.pmod(F.xxhash64("u", "part"), F.lit(n_buckets)))
    links = table(dealt.groupBy("bucket").applyInArrow(_stars(percent), "u bigint, v bigint"), "links")

    first = links.groupBy("v").agg(F.min("u").alias("label"))
    met = links.join(first, "v").groupBy("u").agg(F.least("u", F.min("label")).alias("label"))
    met = table(met, "met")
    second = links.join(met, "u").groupBy("v").agg(F.min("label").alias("label"))
    labels = second.unionByName(met.withColumnRenamed("u", "v")).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("label"))
    labelled = table(members.where("m > 2").select("nth", "band", "node", "n", "hub").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    mixed = labelled.groupBy("nth", "band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("main"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")).alias("content"), F.count("*").alias("m"), F.sum("n").alias("all")).where("least <> most")
    once = mixed.groupBy("content", "m", "all").agg(F.min(F.struct("nth", "band", "main")).alias("b")).select("b.band", "b.main")
    apart = table(labelled.join(once, "band").withColumn("rest", F.col("label") != F.col("main")), "apart")
    sizes = apart.groupBy("band").agg(size(~F.col("rest")).alias("ours"), size(F.col("rest")).alias("others")).select("band", F.ceil(F.col("ours") / block_shingles).cast("int").alias("p"), F.ceil(F.col("others") / block_shingles).cast("int").alias("q"))
    own = apart.join(table(sizes, "sizes"), "band").withColumn("part", F.when(F.col("rest"), F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).otherwise(F.pmod(F.xxhash64("node"), F.col("p"))).cast("int"))
    other = F.explode(F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("p")), F.col("p") + F.col("q") - 1))
    blocks = own.withColumn("other", other).select("nth", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "label", "part", "n")
    seen_blocks = blocks.join(classes.select("node", "marks", "bands"), "node")
    met_blocks = seen_blocks.groupBy("band", "low", "high").applyInArrow(_met(percent, agree), seen_blocks.schema)
    more = table(met_blocks, "met-blocks").join(held, "node").groupBy("band", "low", "high").applyInArrow(_block(percent, agree), "u bigint, v bigint")
    joined = components(links.unionByName(more))

    named = classes.select("same", "node").join(joined, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    # written, so that the join deals both sides out anew and can split a large group of copies
    found = seen.select("key", "n", "same").join(table(named, "named").hint("merge"), "same", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, agree: int = AGREE, bands: int = BANDS, rows_each: int = ROWS) -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps: one of each group, and one of rows equal in all columns.

    Rows without an id all stay.
    """
    judged = near_duplicates(df, key, text, percent, agree, bands, rows_each).select(F.col(key).alias("id"), "kept")
    ids = judged.where("id is not null").groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).where("kept")
    rows = df.select(df[key].alias("id"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    kept = rows.join(ids, "id")
    again = kept.where("copies > 1").select("row").dropDuplicates()
    return kept.where("copies = 1").select("row").unionByName(again).unionByName(rows.where("id is null").select("row")).select("row.*")
