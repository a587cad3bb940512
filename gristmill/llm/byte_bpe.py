"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into leaves of a fixed number of characters.  Each leaf is encoded
alone; neighbours are then joined pairwise up a tree.  A join re-encodes a window
around the seam that grows on both sides until it reaches a character which is
not white space followed by a space or line feed.  No match of the splitting
pattern spans such a place, and no decision left of it looks past it, so tokens
outside the window are those of the joined text: the operation is associative
and the empty text is its unit.  Decoding concatenates the bytes of blocks of
ids up a tree of the same kind.

Null texts encode like empty ones (no ids).  Repeated rows give repeated results;
other columns of the input are ignored.  Every text is handled in one task with
memory proportional to its own length; there is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAF = 256
WINDOW = 32


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder for a rank file, once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _seam(text: str, at: int) -> bool:
    return text[at] in " \n" and not text[at - 1].isspace()


def _last_seam(text: str, lo: int, hi: int) -> int:
    """The last stable place in ``(lo, hi)``, else ``lo``; looks at growing windows from the right."""
    width, done = WINDOW, hi
    while done > lo + 1:
        start = max(lo + 1, hi - width)
        for at in range(done - 1, start - 1, -1):
            if _seam(text, at):
                return at
        width, done = width * 2, start
    return lo


def _first_seam(text: str, lo: int, hi: int) -> int:
    """The first stable place in ``(lo, hi)``, else ``hi``."""
    width, done = WINDOW, lo + 1
    while done < hi:
        end = min(hi, lo + 1 + width)
        for at in range(done, end):
            if _seam(text, at):
                return at
        width, done = width * 2, end
    return hi


def _count(encoder: tiktoken.Encoding, ids: list[int], size: int, step: int) -> int:
    """How many ids from one end make up ``size`` bytes."""
    n, at = 0, 0 if step > 0 else len(ids) - 1
    while size > 0:
        size -= len(encoder.decode_single_token_bytes(ids[at]))
        at, n = at + step, n + 1
    if size:
        raise AssertionError("a seam is not at the edge of a token")
    return n


def join(encoder: tiktoken.Encoding, text: str, left: tuple, right: tuple) -> tuple:
    """The monoid's operation on two neighbouring ``(start, end, ids)`` of one text."""
    (lo, mid, a), (_, hi, b) = left, right
    if lo == mid or mid == hi:
        return lo, hi, a or b
    start, end = _last_seam(text, lo, mid), _first_seam(text, mid, hi)
    if _seam(text, mid):
        start = end = mid
    keep = len(a) - _count(encoder, a, len(text[start:mid].encode()), -1)
    skip = _count(encoder, b, len(text[mid:end].encode()), 1)
    return lo, hi, a[:keep] + encoder.encode_ordinary(text[start:end]) + b[skip:]


def encode(encoder: tiktoken.Encoding, text: str, leaf: int = LEAF) -> list[int]:
    """The ids of a whole text."""
    if len(text) <= leaf:
        return encoder.encode_ordinary(text)
    nodes = [(i, min(i + leaf, len(text)), encoder.encode_ordinary(text[i : i + leaf])) for i in range(0, len(text), leaf)]
    while len(nodes) > 1:
        pairs = [join(encoder, text, nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0][2]


def decode(encoder: tiktoken.Encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    """The bytes of a list of ids."""
    nodes = [encoder.decode_bytes(ids[i : i + leaf]) for i in range(0, len(ids), leaf)] or [b""]
    while len(nodes) > 1:
        nodes = [b"".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF) -> DataFrame:
    """``key``, ``ids`` (array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks, pattern)
        for batch in slices(batches, "text"):
            ids = [encode(encoder, x or "", leaf) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF) -> DataFrame:
    """``key``, ``ids`` as given and ``decoded`` (binary) of each row; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [decode(encoder, x or [], leaf) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(found, pa.binary())], ["key", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnsRenamed({"key": key, "ids": ids})


def id_digests(decoded: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``n_tokens``, and SHA-256 of the ids (little-endian, 32 bits) and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            flat, offsets = column.values.to_numpy().astype("<u4"), column.offsets.to_numpy()
            sums = [sha256(flat[a:b].tobytes()).hexdigest() for a, b in pairwise(offsets)]
            plain = [sha256(x or b"").hexdigest() for x in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(sums), pa.array(plain)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = decoded.schema[key].dataType.simpleString()
    return decoded.select(decoded[key].alias("key"), decoded[ids].alias("ids"), "decoded").mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
