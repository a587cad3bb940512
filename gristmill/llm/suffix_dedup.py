"""Exact substring de-duplication with prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words.  Every window has an anchor: the first of its runs
of ``PREFIX`` words with the least hash, so equal windows have equal anchors at equal places.
Suffixes of the corpus are taken at anchors only, about one word in fourteen, and partitioned by
their prefix, which is the anchor.

1. Anchors are counted over the corpus, hashes only.  Texts with the same words (by SHA-256) are one text;
   if such a text occurs more than once, all its windows repeat.
2. For texts with repeated anchors, the words around each such anchor (a stretch) go to the anchor's group.
3. The suffixes of a group are sorted; the common prefixes of neighbours (LCP) give the internal
   nodes of the suffix tree to the right of the anchor, and likewise to the left.  A window
   repeats if two suffixes share a node of depth r to the right and one of depth ``WINDOW`` - r to
   the left: pairs of nodes whose depths add up to ``WINDOW`` are the deep nodes that hold repeats.
4. Where a prefix is too frequent for its group to fit in memory, equal stretches are first counted as one, and if still
   too many differ, prefixes are lengthened: the windows that begin ``a`` to ``b`` words before
   the anchor all hold the ``a`` words before it and ``WINDOW`` - ``b`` from it on, so an
   interval of ``WIDTHS`` begins makes a prefix of ``WINDOW`` + 1 - width words: 8, then 22, 29 and 35.  Groups of
   35 words are leaves and only counted.  Each group that fits gets its trees.
5. Repeated windows go back to their texts, whose covered words are removed.

Trees compare the words themselves; hashes only choose anchors and groups.  Windows never span documents and are judged on
the input.  Null texts have no words; texts with fewer words than a window keep them all.
Repeated rows and texts that differ in white space only are copies.  Rows with a null id are documents too.
Memory is bounded by a slice of documents and by a group's suffixes; nothing is capped.  What is found for a
frequent stretch or text goes back to its places in several tasks (``_looked_up``).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, raw_texts, slices, table

WINDOW = 35
PREFIX = 8
WIDTHS = (28, 14, 7, 1)
GROUP_ROWS = 2000
BUCKET_ROWS = 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (a power of two), of the whole array."""
    h, n, base = words, 1, _BASE | np.uint64(1)
    while n < size:
        with np.errstate(over="ignore"):
            h, base = h[:-n] * base + h[n:], base * base
        n *= 2
    return mix(h)


def _first_least(h: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` values, the place of its first least one."""
    at = np.arange(len(h))
    n = 1
    while n < span:
        step = min(n, span - n)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        n += step
    return at


def anchors(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside texts: ``(hash, place, text, first window, last window)``, by place."""
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    h = _runs(words, prefix)
    place = _first_least(h, window - prefix + 1)[:n]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])
    if not len(start):
        return none, none, none, none, none
    place = place[start]
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner[start], prepend=-1) != 0))
    last = np.append(new[1:], len(start)) - 1
    at = place[new]
    return h[at].view(np.int64), at, owner[at], start[new], start[last]


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's word count, digest of its words and distinct anchors with their numbers."""
    for batch in slices(batches, "text"):
        texts = [t.split() for t in raw_texts(batch.column("text"))]
        words, bounds = hashed_words(texts)
        h, _, owner, _, _ = anchors(words, bounds)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.flatnonzero((np.diff(h, prepend=0) != 0) | (np.diff(owner, prepend=-1) != 0))
        times = np.diff(np.append(new, len(h)))
        n = len(texts)
        columns = [batch.column("key"), pa.array([sha256(b" ".join(t)).digest() for t in texts], pa.binary()), pa.array(np.diff(bounds), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, _lists(h[new], owner[new], n, pa.int64()), _lists(times, owner[new], n, pa.int64())], ["key", "same", "n_words", "anchors", "times"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with the digest of its words."""
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([sha256(b" ".join(t.split())).digest() for t in raw_texts(batch.column("text"))], pa.binary())], ["row", "same"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, compressed words and their raw size of each text; a text that comes again in a task is left out."""
    press, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in slices(batches, "text"):
        new = {}
        for text in raw_texts(batch.column("text")):
            plain = b" ".join(text.split())
            if (same := sha256(plain).digest()) not in seen:
                seen.add(same)
                new[same] = press.compress(plain), len(plain)
        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([x for x, _ in new.values()], pa.binary()), pa.array([n for _, n in new.values()], pa.int64())], ["same", "packed", "size"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices by the size of the words as they are unpacked: repetitive texts are a hundred times smaller before."""
    open_ = zstandard.ZstdDecompressor()
    for batch in slices(batches, "size", 1 << 20):
        yield batch, [open_.decompress(x).split() for x in batch.column("packed").to_pylist()]


_STRETCH = "same binary, hot boolean, key bigint, id binary, left int, span binary, places array<bigint>"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around repeated anchors, by their anchor (``key``); ``left`` of them stand before it.

    A stretch of a frequent anchor that stands in a text many times is one row with its places.
    """
    for batch, texts in _unpacked(batches):
        words, bounds = hashed_words(texts)
        h, place, owner, first, last = anchors(words, bounds)
        rows: list[tuple] = []
        wanted = [{}] * len(texts)
        for i, (keys, hot) in enumerate(zip(batch.column("keys").to_pylist(), batch.column("hot").to_pylist(), strict=True)):
            wanted[i] = dict(zip(keys, hot, strict=True))
        same, held = batch.column("same").to_pylist(), {}
        for key, at, i, lo, hi in zip(h.tolist(), place.tolist(), owner.tolist(), first.tolist(), last.tolist(), strict=True):
            frequent = wanted[i].get(key)
            if frequent is None:
                continue
            start = int(bounds[i])
            span = b" ".join(texts[i][lo - start : hi + WINDOW - start])
            name = blake2b(b"%d %b" % (at - lo, span), digest_size=16).digest() if frequent else None
            if frequent and (i, name) in held:
                held[i, name].append(at - start)
                continue
            places = [at - start]
            if frequent:
                held[i, name] = places
            rows.append((same[i], frequent, key, name, at - lo, span, places))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        kinds = (pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["same", "hot", "key", "id", "left", "span", "places"])


def _lengthened(width: int, to: int):
    """Each stretch cut for intervals of ``to`` begins, with the lengthened prefix as its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "span"):
            rows = []
            for parent, at, left, span, n in zip(*(batch.column(c).to_pylist() for c in ("id", "at", "left", "span", "n")), strict=True):
                words = span.split(b" ")
                least = WINDOW - (len(words) - left)
                for a in range(at, at + width, to):
                    lo, hi = max(least, a), min(left, a + to - 1)
                    if lo <= hi:
                        cut, prefix = (b" ".join(words[left - x : left + WINDOW - y]) for x, y in ((hi, lo), (a, a + to - 1)))
                        key = int.from_bytes(blake2b(b"%d %b" % (a, prefix), digest_size=8).digest(), "little", signed=True)
                        rows.append((parent, blake2b(b"%d %d %b" % (a, hi, cut), digest_size=16).digest(), key, a, hi, cut, n))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["parent", "id", "key", "at", "left", "span", "n"])

    return run


class SuffixTree:
    """The internal nodes of a tree of suffixes, as their sorted order and the LCP of neighbours.

    ``suffixes`` is a matrix of words, zero after a suffix's end; ``group`` separates trees.
    """

    def __init__(self, group: np.ndarray, suffixes: np.ndarray) -> None:
        rows = np.concatenate([group.astype(np.uint32)[:, None], suffixes.astype(np.uint32)], axis=1).astype(">u4")
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 4}").ravel(), kind="stable")
        sorted_ = rows[self.order]
        differ = sorted_[1:] != sorted_[:-1]
        self.lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) - 1

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix, the number of the node (or leaf) of that depth above it."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum(self.lcp < depth)])
        return out


def repeats(anchor: np.ndarray, left: list[list[int]], right: list[list[int]], window: int = WINDOW) -> np.ndarray:
    """For each anchored stretch the least and the greatest words to the left of its anchor with which a repeated window begins; -1 for none.

    ``left`` holds the words (numbers from 1) before the anchor, nearest first; ``right`` those from the anchor on.
    """
    n = len(anchor)
    _, group = np.unique(anchor, return_inverse=True)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    trees = []
    for side, size in zip((left, right), sizes, strict=True):
        matrix = np.zeros((n, int(size.max(initial=0))), np.uint32)
        matrix[np.arange(matrix.shape[1]) < size[:, None]] = np.fromiter(chain.from_iterable(side), np.uint32, int(size.sum()))
        trees.append(SuffixTree(group, matrix))
    found = np.full((n, 2), -1, np.int64)
    for i in range(int(sizes[0].max(initial=0)) + 1):
        rows = np.flatnonzero((sizes[0] >= i) & (sizes[1] >= window - i))
        if len(rows) < 2:
            continue
        both = trees[1].nodes(window - i)[rows] * n + trees[0].nodes(i)[rows]
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        rows = rows[count[which] > 1]
        found[rows, 0] = np.where(found[rows, 0] < 0, i, found[rows, 0])
        found[rows, 1] = i
    return found


def _found(rows: pa.Table) -> np.ndarray:
    """``repeats`` of the stretches of some groups."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    spans = [list(map(number.__getitem__, x.split(b" "))) for x in rows.column("span").to_pylist()]
    cut = rows.column("left").to_pylist()
    return repeats(rows.column("key").to_numpy(), [s[:c][::-1] for s, c in zip(spans, cut, strict=True)], [s[c:] for s, c in zip(spans, cut, strict=True)])


def _group(rows: pa.Table) -> pa.Table:
    """The repeated windows of some anchors' groups, each stretch's as one span of words."""
    found = _found(rows)
    hit = np.flatnonzero(found[:, 0] >= 0)
    place = pc.list_flatten(rows.column("places")).to_numpy()[hit]  # one for each stretch
    return pa.table({"same": rows.column("same").take(pa.array(hit)), "start": place - found[hit, 1], "stop": place - found[hit, 0] + WINDOW})


def _frequent_group(rows: pa.Table) -> pa.Table:
    """For stretches of some groups, the least and the greatest begins of repeated windows."""
    found, n = _found(rows), rows.column("n").to_numpy()
    left, size = rows.column("left").to_numpy(), np.array([x.count(b" ") + 1 for x in rows.column("span").to_pylist()])
    often = n > 1
    found[often, 0], found[often, 1] = (WINDOW - size + left)[often], left[often]
    hit = np.flatnonzero(found[:, 0] >= 0)
    return pa.table({"id": rows.column("id").take(pa.array(hit)), "low": pa.array(found[hit, 0].astype(np.int32)), "high": pa.array(found[hit, 1].astype(np.int32))})


def _looked_up(rows: DataFrame, found: DataFrame, on: str, spread: list[str], most: int, each: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found`` (one row for each ``on``); a value that ``most`` rows have is dealt to parts of about ``each`` rows."""
    salts = math.ceil(most / max(1, each))
    if salts <= 1:
        return rows.join(found, on, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    return salted.join(salted.select(on, "salt").distinct().join(found, on), [on, "salt"], how).drop("salt")


def _bucketed(groups: DataFrame, bucket_rows: int, rows: int):
    """Groups dealt to buckets of about ``bucket_rows``, and to all tasks if there are few."""
    n = max(1, -(-rows // bucket_rows), min(rows, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return groups.groupBy(F.pmod("key", F.lit(n)).alias("bucket"))


def _frequent(hot: DataFrame, group_rows: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """``id``, ``low``, ``high`` of stretches of frequent anchors that hold repeats; how often the most frequent one stands."""
    nodes = table(hot.groupBy("id").agg(F.first("key").alias("key"), F.lit(0).alias("at"), F.first("left").alias("left"), F.first("span").alias("span"), F.sum(F.size("places")).alias("n")), "stretches-0")
    most = nodes.agg(F.max("n")).first()[0] or 0
    found, cuts = [], []
    for level, width in enumerate(WIDTHS):
        if width == 1:
            found.append(nodes.where("n > 1").select("id", F.col("at").alias("low"), F.col("at").alias("high")))
            break
        sizes = table(nodes.groupBy("key").agg(F.count("*").alias("m")), f"sizes-{level}")
        sized = table(_looked_up(nodes, sizes, "key", ["id"], sizes.agg(F.max("m")).first()[0] or 0, group_rows), f"sized-{level}")
        fit, more = sized.where(F.col("m") <= group_rows), sized.where(F.col("m") > group_rows)
        found.append(_bucketed(fit, bucket_rows, fit.count()).applyInArrow(_frequent_group, "id binary, low int, high int"))
        if more.isEmpty():
            break
        finer = table(more.select("id", "at", "left", "span", "n").mapInArrow(_lengthened(width, WIDTHS[level + 1]), "parent binary, id binary, key bigint, at int, left int, span binary, n bigint"), "lengthened")
        cuts.append(finer.select("parent", "id"))
        nodes = table(finer.groupBy("id").agg(*[F.first(c).alias(c) for c in ("key", "at", "left", "span")], F.sum("n").alias("n")), f"stretches-{level + 1}")
    out = found.pop()
    while cuts:
        up = _looked_up(cuts.pop(), table(out, "found"), "id", ["parent"], most, group_rows)
        out = up.select(F.col("parent").alias("id"), "low", "high").unionByName(found.pop()).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out, most


def repeated_text(df: DataFrame, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """All documents; each distinct text that holds repeats with its covered words; its compressed words; the most copies of a text.

    The first has ``key``, the digest ``same`` of its words and ``n_words``; the second ``same``, ``copied`` and
    ``cover``, an array of ``(start, stop)``; a ``copied`` text is covered as a whole.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()
    seen = table(rows.mapInArrow(_survey, f"key {kind}, same binary, n_words bigint, anchors array<bigint>, times array<bigint>"), "survey")
    once = table(seen.groupBy("same").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"), F.first("times").alias("times")), "texts")
    most_copies = once.agg(F.max("copies")).first()[0] or 0
    places = once.select("same", F.inline(F.arrays_zip("anchors", "times"))).withColumnRenamed("anchors", "anchor")
    again = table(places.groupBy("anchor").agg(F.count("*").alias("texts"), F.sum("times").alias("n")).where("n > 1").select("anchor", "texts", (F.col("n") > group_rows).alias("frequent")), "again")
    met = _looked_up(places.select("same", "anchor"), again.drop("texts"), "anchor", ["same"], again.agg(F.max("texts")).first()[0] or 0, group_rows)
    wanted = met.groupBy("same").agg(F.collect_list(F.struct("anchor", "frequent")).alias("w")).select("same", F.col("w.anchor").alias("keys"), F.col("w.frequent").alias("hot"))
    held = table(rows.mapInArrow(_packed, "same binary, packed binary, size bigint").join(wanted, "same").dropDuplicates(["same"]), "held")
    stretches = table(held.mapInArrow(_stretches, _STRETCH), "stretches")
    cool, hot = stretches.where("not hot"), stretches.where("hot")
    covers = _bucketed(cool, bucket_rows, cool.count()).applyInArrow(_group, "same binary, start bigint, stop bigint").select("same", F.array(F.struct("start", "stop")).alias("cover"))
    if not hot.isEmpty():
        judged, most = _frequent(hot, group_rows, bucket_rows)
        spans = F.transform("places", lambda p: F.struct((p - F.col("high")).alias("start"), (p - F.col("low") + WINDOW).alias("stop")))
        back = _looked_up(hot.select("id", "same", "places"), table(judged, "judged"), "id", ["same"], most, group_rows)
        covers = covers.unionByName(back.select("same", spans.alias("cover")))
    cover = covers.groupBy("same").agg(F.flatten(F.collect_list("cover")).alias("cover"))
    copied = once.where(f"copies > 1 and n_words >= {WINDOW}").select("same", F.lit(True).alias("copied"))
    both = table(cover.join(copied, "same", "full").select("same", F.coalesce("copied", F.lit(False)).alias("copied"), "cover"), "cover")
    return seen.select(F.col("key").alias(key), "same", "n_words"), both, held, most_copies


def _kept(words: list[bytes], cover: list[dict]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [c["start"] for c in cover], 1)
    np.add.at(edge, [c["stop"] for c in cover], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of each text is removed, and the digest of what is left."""
    for batch, texts in _unpacked(batches):
        kept = [_kept(words, cover) for words, cover in zip(texts, batch.column("cover").to_pylist(), strict=True)]
        n = [len(a) - len(b) for a, b in zip(texts, kept, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(n, pa.int64()), pa.array([sha256(b" ".join(k)).digest() for k in kept], pa.binary())], ["same", "n_removed", "kept"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what is left of their texts; a row of which nothing is left goes."""
    for batch in slices(batches, "text"):
        rows, new = [], []
        for i, (text, copied, cover) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copied").to_pylist(), batch.column("cover").to_pylist(), strict=True)):
            if copied:
                continue
            if cover:
                text = b" ".join(_kept(text.encode().split(), cover)).decode()
                if not text:
                    continue
            rows.append(i)
            new.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array(new, pa.string())], ["row", "new"])


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``df`` with repeated words removed from their texts.

    A text in which nothing repeats stays as it is; a row of which nothing is left goes.
    """
    _, cover, _, most = repeated_text(df, key, text, group_rows)
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    signed = rows.mapInArrow(_signed, f"row {kind}, same binary")
    judged = _looked_up(signed, cover, "same", ["row"], most, group_rows, "left")
    out = judged.select("row", F.col(f"row.`{text}`").alias("text"), "copied", "cover").mapInArrow(_edited, f"row {kind}, new string")
    return out.select(*[F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each document."""
    seen, cover, held, most = repeated_text(df, key, text, group_rows, bucket_rows)
    digests = held.select("same", "packed", "size").join(cover.where("not copied").select("same", "cover"), "same").mapInArrow(_digests, "same binary, n_removed bigint, kept binary")
    judged = table(digests.withColumn("copied", F.lit(False)).unionByName(cover.where("copied").select("same", "copied"), allowMissingColumns=True), "judged")
    every = _looked_up(seen, judged, "same", [key], most, group_rows, "left")
    return every.select(
        key,
        "n_words",
        F.expr("if(copied, n_words, coalesce(n_removed, 0))").cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "same")))).alias("kept_sha256"),
    )
