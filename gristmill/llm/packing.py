"""Best-two-fit packing of tokenized documents into sequences of fixed capacity.

A document is its ids under a word-level BPE vocabulary, closed by a separator id.
Only a document longer than the capacity is cut, into pieces of full capacity and
a rest.  Which pieces share a sequence depends on lengths alone, so the plan is made
on the histogram of lengths (one row for each length, whatever the corpus): a bin is
filled greedily from the longest piece down; then its smallest piece is replaced by the
two unpacked pieces that fit the expanded gap most tightly, if they fill it better.
While the lengths last, the same bin is repeated, so the plan has few entries.  Pieces
find their place by their rank among pieces of the same length; ranks are
counted in (length, input part) groups, so that a common length is dealt to many tasks.

Null and empty texts are documents of the separator alone.  Repeated rows are packed
as often as they occur.  An empty table gives no pieces.  Long texts are handled in
memory proportional to their own length.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
SEPARATOR = 0
CACHE = 100_000
PARTS = 8192

#: Characters that the vocabulary's normalizer only lower-cases, and whose white space is ASCII.
PLAIN = re.compile("[\t\n\r -~\xa1-ɏ]*").fullmatch


#: A character no plain text has, in place of the vocabulary's mark of a word's end.
END = "\x01"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as ranks of byte strings that end in ``END``; its ids are in the order of its merges."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = dict(zip(map(chr, printable), printable, strict=True)) | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {}
    for token, i in vocabulary.items():
        word = token.removesuffix("</w>")
        raw = bytes(byte[c] for c in word)
        if END.encode() not in raw or token == word and len(raw) == 1:
            ranks[raw + END.encode() * (token != word)] = i
    return ranks


class WordIds(dict):
    """Ids of words between white space, as little-endian 32-bit bytes, remembered up to a bound.

    The vocabulary splits a text at white space and matches no token across it, so
    the words of a plain text are independent; other texts, and those that hold one of the vocabulary's
    added tokens such as ``<|endoftext|>``, are encoded whole by the library with its defaults.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda text: None
        self.encoder = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=_ranks(path), special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.encode_ordinary(END.join([*PIECE.findall(word), ""]))
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE:
            self[word] = found
        return found

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        if not PLAIN(text) or self.added(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    """The vocabulary, once per process."""
    return WordIds(path)


def pieces_of(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (binary, little-endian)."""
    end, step = struct.pack("<I", separator), capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(vocabulary)
        for batch in slices(batches, "text"):
            rows, at = [], []
            for i, value in enumerate(batch.column("text").to_pylist()):
                ids = (words.of(value) if value else b"") + end
                for k, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    rows.append((k, start // 4, len(part) // 4, crc32(part), part if keep_ids else None))
                    at.append(i)
            piece, start, length, crc, ids = map(list, zip(*rows, strict=True))
            columns = [batch.column("key").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names)

    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(copies, lengths)`` of the bins that hold ``counts[length]`` pieces of each length.

    Bins are made from the longest remaining piece down; see the module's text.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    plan = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        below = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        bin_, gap, used = [], capacity, {}
        at = top
        while gap and at:
            at = int(below[min(gap, at)])
            while at and left[at] <= used.get(at, 0):
                at = int(below[at - 1])
            if not at:
                break
            n = min(gap // at, int(left[at]) - used.get(at, 0))
            used[at] = used.get(at, 0) + n
            bin_ += [at] * n
            gap -= at * n
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            used[small] -= 1
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            have = np.flatnonzero(free[: room + 1] > 0)
            have = have[have > 0]
            if len(have):
                largest = np.maximum.accumulate(np.where(free > 0, sizes, 0))
                other = largest[room - have]
                twin = (other == have) & (free[have] < 2)
                other[twin] = largest[np.maximum(have[twin] - 1, 0)]
                total = np.where(other > 0, have + other, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    pair = sorted((int(have[best]), int(other[best])), reverse=True)
                    bin_ = bin_[:-1] + pair
                    for length in pair:
                        used[length] = used.get(length, 0) + 1
                else:
                    used[small] += 1
            else:
                used[small] += 1
        copies = min(int(left[length]) // n for length, n in used.items() if n)
        for length, n in used.items():
            left[length] -= n * copies
        plan.append((copies, bin_))


def _entries(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, uses in a bin, first offset), sorted by length and rank."""
    rows, rank, base = [], {}, 0
    for copies, bin_ in plan:
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            uses = bin_.count(length)
            rows.append((length, rank.get(length, 0), base, uses, offset))
            rank[length] = rank.get(length, 0) + uses * copies
            offset += uses * length
        base += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; at most ``capacity`` ids in a sequence.

    ``pieces`` needs ``length``; its other columns are kept.
    """
    names = pieces.columns
    held = table(pieces.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), "pieces")
    groups = held.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most one row for each length up to the capacity
    entries = _entries(best_two_fit(counts, capacity))
    before = groups.selectExpr("length", "part", "coalesce(sum(count) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before")
    order = ", ".join(c for c in ("key", "piece") if c in names) or "length"
    ranked = held.selectExpr("*", f"row_number() over (partition by length, part order by {order}) - 1 as at").join(before, ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (entries[:, 0] << 44) + entries[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = entries[np.searchsorted(first, (length << 44) + rank, side="right") - 1]
            copy, nth = np.divmod(rank - row[:, 1], row[:, 3])
            columns = [batch.column(c) for c in names] + [pa.array(row[:, 2] + copy), pa.array(row[:, 4] + nth * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, (F.col("before") + F.col("at")).cast("long").alias("rank")).mapInArrow(place, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents; see ``pieces_of`` and ``pack``."""
    return pack(pieces_of(df, key, text, vocabulary, capacity, separator, keep_ids), capacity).withColumnRenamed("key", key)
