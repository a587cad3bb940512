"""Personal data: base patterns, extended by bootstrapped contextual extraction.

Base matches of four kinds (e-mail, IP address, payment card, phone) are found in every whole text.  They
are also seeds: the words and pairs of words next to them become lexical patterns.  A pattern
links to every instance it stands next to: seeds, and candidates that only look loosely like
an identifier of the kind.  Spark scores this graph in rounds.  A pattern's confidence
for a kind is the weight of trusted instances next to it, divided by all its occurrences in the corpus; only
patterns with enough different trusted instances and a high confidence count.  A candidate's score is the
chance that not all of its patterns are wrong.  Scores never fall, and rounds go on until all of them together rise by less than
``SETTLED``; the spans of the candidates above a level are added then.

A fifth kind, ``secret``, has no base pattern: quoted strings of 32 or more hexadecimal digits are its seeds, but such a seed
is added only where its context is trusted, because the shape alone may be a check sum.

Corpus counts of patterns are exact: documents are scanned once more, and a bitmap whose size follows the number of
patterns (at most ``1 << BITMAP_BITS`` bits) only says which grams need not be sent.  All joins are on
hashes; common patterns are pre-aggregated, and what an aggregation yields is written before rows are joined to it, so that Spark can
split a common pattern or instance over tasks.  Offsets are code points, ends exclusive.

The words next to a span are looked for within ``CONTEXT`` characters on each side; a longer word there is no
pattern.  A candidate is always a whole run of the characters of its shape.  All scans take time in proportion to a text's length.
Null texts count as empty and have no spans.  Repeated rows get equal results; an empty table
gives an empty result.  Input columns called ``base`` or ``added`` are carried as ``input_base`` and
``input_added``.  Memory is bounded by a slice of documents and a text's own matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, raw_texts, slices, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SECRET = 4
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.5
ACCEPT = 0.8
SETTLED = 1e-3
BITMAP_BITS = 27
CONTEXT = 200

# The base patterns.  Runs are cut so that no text is scanned twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Loose shapes of candidates, as whole runs of their characters.
_TOKEN = re.compile(r"\S+")
_AT = re.compile(r"@|\(at\)|\[at\]")
_GROUPS = re.compile(r"[0-9A-Fa-f.:]+")
_GROUPED = re.compile(r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}")
_LONG = re.compile(r"[0-9](?:[ ./-]?[0-9])*")
_DIALLED = re.compile(r"[+0-9 ()./-]+")
_HEX = re.compile(r"[\"'][0-9a-fA-F]{32,}[\"']")
_CODE = re.compile(r"[A-Za-z0-9_+/=-]{12,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost e-mail addresses; the local part is the run of its characters before an at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost groups of four numbers joined by dots, whatever the numbers are."""
    for m in _NUMBERS.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, numbers = m.start(), m.group().split(".")
        for i in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base matches, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for a, b in _addresses(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text[a:b].split(".")):
                found.append((a, 1, b))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def secrets(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the seeds of secrets: quoted strings of hexadecimal digits, both letters and numbers."""
    if '"' not in text and "'" not in text:
        return []
    return [(m.start() + 1, SECRET, m.end() - 1) for m in _HEX.finditer(text) if _DIGIT.search(m.group()) and re.search("[A-Fa-f]", m.group())]


def _runs(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, kind, end)`` of what loosely looks like an identifier."""
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _TOKEN.finditer(text):
            word = m.group().rstrip(".,;:!?")
            if (at := _AT.search(word)) and at.start() > 1 and len(word) - at.end() > 1:
                yield m.start(), 0, m.start() + len(word)
    if not _DIGIT.search(text):
        return
    for m in _GROUPS.finditer(text):
        word = m.group().strip(".:")
        if len(_digits(word)) >= 4 and _GROUPED.fullmatch(word):
            start = m.start() + m.group().index(word)
            yield start, 1, start + len(word)
    for m in _LONG.finditer(text):
        if 8 <= len(_digits(m.group())) <= 32:
            yield m.start(), 2, m.end()
    for m in _DIALLED.finditer(text):
        run = m.group()
        start, end = len(run) - len(run.lstrip(" )./-")), len(run.rstrip(" ()./+-"))
        if start < end and 7 <= len(_digits(run[start:end])) <= 20:
            yield m.start() + start, 3, m.start() + end
    for m in _CODE.finditer(text):
        if _DIGIT.search(m.group()) and re.search("[A-Za-z]", m.group()):
            yield m.start(), SECRET, m.end()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of loose matches that touch no base match."""
    busy, out, at = sorted((a, b) for a, _, b in base), [], {}
    for start, kind, end in _runs(text):
        i = at.get(kind, 0)
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        at[kind] = i
        if i == len(busy) or busy[i][0] >= end:
            out.append((start, kind, end))
    return out


def _grams(before: list[bytes], after: list[bytes]) -> list[tuple[bytes, int]]:
    """The words and pairs next to a span, with the side they stand on."""
    out = [(b" ".join(before[-k:]), 0) for k in (1, 2) if len(before) >= k]
    return out + [(b" ".join(after[:k]), 1) for k in (1, 2) if len(after) >= k]


def _around(text: str, start: int, end: int) -> tuple[list[bytes], list[bytes]]:
    """Whole words before and after the token that holds a span, within ``CONTEXT`` characters of it."""
    lo, hi, first, last = start, end, max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while lo > first and not text[lo - 1].isspace():
        lo -= 1
    while hi < last and not text[hi].isspace():
        hi += 1
    before, after = text[first:lo].encode().lower().split(), text[hi:last].encode().lower().split()
    return before[1:] if first and not text[first - 1].isspace() else before, after[:-1] if last < len(text) and not text[last].isspace() else after


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _gram_hashes(grams: list[bytes]) -> np.ndarray:
    """Hashes of words, or of pairs of words, as the scan of the corpus makes them."""
    h, bounds = hashed_words([g.split() for g in grams])
    first, n = bounds[:-1], np.diff(bounds)
    second = np.minimum(first + 1, max(0, len(h) - 1))
    return np.where(n == 1, h[first], mix(h[first] * np.uint64(0x9E3779B97F4A7C15) + h[second])) if len(grams) else h


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_EDGES = pa.list_(pa.struct([("gram", pa.int64()), ("side", pa.int32()), ("instance", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text, and the edges between its instances and their contexts."""
    for batch in slices(batches, "text"):
        spans, flat, grams, names = [], [], [], []
        for i, value in enumerate(batch.column("text").to_pylist()):
            text = value or ""
            base = base_spans(text)
            spans.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
            sure = base + secrets(text)
            for seed, found in ((True, sure), (False, candidates(text, sure))):
                for start, kind, end in found:
                    for gram, side in _grams(*_around(text, start, end)):
                        flat.append((i, side, kind, seed, start, end))
                        grams.append(gram)
                        names.append((str(kind) + text[start:end].lower()).encode().replace(b" ", b"_") or b"_")
        g, name = _gram_hashes(grams).view(np.int64), _gram_hashes([b"_".join(n.split()) for n in names]).view(np.int64)
        edges: list[list[dict]] = [[] for _ in spans]
        for (i, side, kind, seed, start, end), x, y in zip(flat, g.tolist(), name.tolist(), strict=True):
            edges[i].append({"gram": x, "side": side, "instance": y, "kind": kind, "seed": seed, "start": start, "end": end})
        yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(spans, _SPANS), pa.array(edges, _EDGES)], ["carried", "base", "edges"])


def _counter(bitmap: np.ndarray, bits: int):
    """Counts of the words and pairs whose hash is in the bitmap; one task adds up until it holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, bounds = hashed_words([x.lower().split() for x in raw_texts(batch.column("text"))])
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            pairs = _pairs(h)[owner[:-1] == owner[1:]] if len(h) > 1 else h[:0]
            grams = np.concatenate([h, pairs])
            place = (grams & np.uint64((1 << bits) - 1)).astype(np.int64)
            grams = grams[(bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
            found, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return run


def _bitmap(patterns: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the grams' lowest bits, some 16 for each of ``n`` patterns, from pieces that Spark aggregates."""
    bits = min(BITMAP_BITS, max(15, math.ceil(math.log2(16 * n))))
    place = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = patterns.groupBy(F.bitmap_bucket_number(place + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for r in pieces.collect():  # at most (1 << BITMAP_BITS) / 32768 pieces of 4 KB
        bitmap[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bitmap, bits


def _gram_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences in the corpus of every gram of ``patterns``."""
    grams = patterns.select("gram").distinct()
    bitmap, bits = _bitmap(grams, grams.count())
    held = texts.sparkSession.sparkContext.broadcast(bitmap)  # 16 MB at most
    counts = texts.mapInArrow(lambda batches: _counter(held.value, bits)(batches), "gram bigint, n bigint")
    return counts.join(grams, "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("total"))


def trusted_instances(edges: DataFrame, texts: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, accept: float = ACCEPT, settled: float = SETTLED) -> DataFrame | None:
    """``kind`` and ``instance`` of candidates that the scored graph trusts; None if no pattern has enough seeds."""
    links = table(edges.groupBy("gram", "side", "kind", "instance", "seed").agg(F.count("*").alias("n")), "links")
    able = links.groupBy("gram", "side", "kind").agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others")).where(F.col("seeds") >= min_seeds).where((F.col("others") > 0) | (F.col("kind") == SECRET))
    patterns = table(able.select("gram", "side", "kind"), "patterns")
    if patterns.isEmpty():
        return None
    totals = table(_gram_totals(texts, patterns), "totals")
    graph = table(links.join(patterns, ["gram", "side", "kind"]).join(totals, "gram"), "graph")
    scores = table(graph.select("kind", "instance", F.col("seed").cast("double").alias("score")).distinct(), "scores")
    total = 0
    while True:
        weighed = graph.join(scores.select("kind", "instance", "score"), ["kind", "instance"])
        confidence = weighed.groupBy("gram", "side", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence"), F.count_if(F.col("score") >= accept).alias("support"))
        good = table(confidence.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_seeds)).select("gram", "side", "kind", "confidence"), "good")
        joint = graph.join(good, ["gram", "side", "kind"], "left").groupBy("kind", "instance", "seed").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))).alias("merit"))
        scores = table(joint.select("kind", "instance", "seed", "merit", F.when(F.col("seed"), 1.0).otherwise(F.col("merit")).alias("score")), "scores")
        before, total = total, scores.agg(F.sum(F.col("score").cast("decimal(20,9)"))).first()[0] or 0
        if total - before < settled:
            return scores.where((~F.col("seed") | (F.col("kind") == SECRET)) & (F.col("merit") >= accept)).select("kind", "instance")


def find_spans(df: DataFrame, text: str = "text", carry: list[str] | None = None, **options: float) -> DataFrame:
    """The ``carry`` columns (default: all) of each row, ``base`` and ``added``: arrays of (start, kind, end), sorted."""
    carry = list(carry or df.columns)
    rows = df.select(F.struct(*[df[c].alias(f"input_{c}" if c in ("base", "added") else c) for c in carry]).alias("carried"), df[text].alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()
    span = "array<struct<start: int, kind: int, end: int>>"
    edge = "array<struct<gram: bigint, side: int, instance: bigint, kind: int, seed: boolean, start: int, end: int>>"
    scanned = table(rows.mapInArrow(_scan, f"carried {kind}, base {span}, edges {edge}").withColumn("row", F.monotonically_increasing_id()), "scanned")
    edges = scanned.select("row", F.inline("edges"))
    trusted = trusted_instances(edges.drop("row", "start", "end"), rows.select("text"), **options)
    if trusted is None:
        out = scanned.withColumn("added", F.expr("cast(array() as " + span + ")"))
    else:
        new = edges.where(f"not seed or kind = {SECRET}").join(trusted, ["kind", "instance"]).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
        out = scanned.join(new, "row", "left").withColumn("added", F.expr(f"coalesce(added, cast(array() as {span}))"))
    return out.select("carried.*", "base", "added")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans are replaced once."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in ALL_KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))).alias("out"),
        F.greatest(s["end"], a["at"]).alias("at"),
    )
    done = F.aggregate(F.array_sort(spans), start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
