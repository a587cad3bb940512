"""Responses judged while they are still being written.

``replay`` applies the schedule of checks to finished texts, as plain expressions.  ``spans_to_judge`` applies it
to a stream of chunks with keyed state and emits the spans that are due; ``judge`` scores spans with the
same built-in detectors as everywhere else, so state holds text and counters only.  ``guard_stream`` puts a second
keyed stage behind them that remembers which responses have fired: chunks pass until then, and nothing is reported after it.

State is written in proportion to what arrives: text is appended to a list, the counters and the last window are
the only values written anew.  Queries need the RocksDB state store; ``run_to_table`` starts them with it.

Rows, calls and messages are what the keyed stages cost: each row is taken apart value by value in Python, each call gives back a batch of its own, and
each look at the state is a message to the JVM.  So chunks of a response that come together are packed into one row, the first stage is called for a bucket
of responses and reads their state at once where most of it is wanted, and in the second only responses with a window that may fail have a call of their own.

The schedule: a first check at ``warmup`` characters, then one whenever ``check_every`` more have come, at most one
a chunk; each reads the last ``window`` characters.  With early document checks, the first 8000 characters are also
read for script and prompt echo, from 600 characters on and each time the length has doubled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.text import let, stage, trim
from ..operators.check import CODES, PRESETS, VERDICT, CheckOptions, DegenerateOutputError, check_output, measures, verdict_of
from ..operators.verdicts import merge_early, preamble_options
from .sure import doubtful, surely_pass

# The schedule.
WARMUP, CHECK_EVERY, WINDOW = 240, 400, 2000
DOCUMENT_FROM, DOCUMENT_CERTAINTY, DOCUMENT_SAMPLE = 600, 0.9, 8000

SPAN = "response_id string, at_chars bigint, kind string, span string, finish_reason string"
_PACKED = "deltas array<string>, ends array<bigint>"
EVENT = f"response_id string, seq bigint, kind string, at_chars bigint, delta string, span string, head string, finish_reason string, {_PACKED}"
_names = lambda schema: [part.split()[0] for part in schema.split(", ")]
_EVENT_NAMES = _names(EVENT)
#: The same in fewer values: the chunks of a row as one text with ``_MARK`` between them, their ends as one text with commas, and the ``lane`` they may share.
ROW = "lane bigint, response_id string, seq bigint, kind string, at_chars bigint, delta string, span string, head string, finish_reason string, ends string"
_MARK, _ESCAPE = "\x1e", "\x1f"
#: Buckets of responses, a call of the first stage for each.  A task holds what one micro-batch brings for a bucket; checkpoints depend on the number.
BUCKETS = 4096
_COUNTERS = "n bigint, since bigint, checks bigint, document_at bigint, settled boolean, next_seq bigint, waiting bigint, finish_reason string, tool boolean, timer bigint, recent string, doubted boolean, again boolean, listed bigint"
_FINISHED = "at bigint, next_seq bigint, more array<bigint>, over boolean"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Schedule:
    """When to check, and how much of the text."""

    warmup: int = WARMUP
    check_every: int = CHECK_EVERY
    window: int = WINDOW
    early_document: bool = False


def window_options(o: CheckOptions) -> CheckOptions:
    """What a window can be judged by: signs that hold before the end."""
    return o.but(min_length=0, max_truncation=None, expect_json=False, expect_lang=None, finish_reason=None, expect_script=None, prompt=None, max_compressibility=None)


def document_options(o: CheckOptions) -> CheckOptions:
    """What the document so far can be judged by: script and prompt echo, near certainty only."""
    return o.but(
        min_length=0, max_repetition=None, max_tail_loop=None, max_char_tail_loop=None, max_compressibility=None, max_truncation=None, expect_json=False, expect_lang=None, finish_reason=None,
        max_script_mismatch=DOCUMENT_CERTAINTY, max_prompt_echo=DOCUMENT_CERTAINTY,
    )


def _resolved(options: CheckOptions | str) -> CheckOptions:
    return PRESETS[options] if isinstance(options, str) else options


def check_positions(length: Column, chunk: int, s: Schedule = Schedule()) -> Column:
    """Where checks fall in a text of some length that comes in chunks of one size."""
    up = lambda n: -(-n // chunk) * chunk
    first, step = F.least(F.lit(up(s.warmup)), length), up(s.check_every)
    more = F.when(length - first < s.check_every, F.lit(0)).otherwise(F.floor((length - first - s.check_every) / step) + 1)
    places = F.transform(F.sequence(F.lit(0), more.cast("int")), lambda i: F.least(first + i * step, length).cast("long"))
    return F.when(length < s.warmup, F.expr("cast(array() as array<bigint>)")).otherwise(places)


def document_positions(positions: Column) -> Column:
    """The check positions at which the document so far is read as well."""
    start = F.struct(F.lit(DOCUMENT_FROM).cast("long").alias("due"), F.expr("cast(array() as array<bigint>)").alias("at"))

    def step(a: Column, p: Column) -> Column:
        settled = F.coalesce(F.array_max(a["at"]) >= DOCUMENT_SAMPLE, F.lit(False))
        return F.when((p >= a["due"]) & ~settled, F.struct((p * 2).alias("due"), F.concat(a["at"], F.array(p)).alias("at"))).otherwise(a)

    return F.aggregate(positions, start, step)["at"]


def replay(df: DataFrame, key: list[str], text: str, options: CheckOptions | str, chunk: int, s: Schedule = Schedule()) -> DataFrame:
    """``key``, ``n_chars``, ``checks``, ``caught_at`` (characters come by the first failing check) and its ``reasons``; a row for each row of ``df``."""
    o = _resolved(options)
    early = s.early_document and (o.expect_script is not None or o.prompt is not None)
    # the length and the places once for each row: a length costs as much as the text is long
    rows = stage(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), {"_n": F.length("_text").cast("long")})
    rows = stage(rows, {"_at": check_positions(F.col("_n"), chunk, s)})
    # windows that surely pass are checks, but only the others are measured
    rows = stage(rows, {"_doubtful": doubtful(F.col("_text"), F.col("_at"), s.window, window_options(o))})
    rows = stage(rows, {"_documents": document_positions(F.col("_at"))}) if early else rows
    places = F.array_union("_doubtful", "_documents") if early else F.col("_doubtful")
    # a number for each row: repeated keys stay apart, and a key with most rows isn't one group
    due = rows.withColumns({"_row": F.monotonically_increasing_id(), "_checks": F.size("_at").cast("long")}).select("*", F.explode_outer(places).alias("_p"))
    span = F.when(F.array_contains("_doubtful", F.col("_p")), F.substring(F.col("_text"), F.greatest(F.lit(1), F.col("_p") - s.window + 1).cast("int"), F.least(F.col("_p"), F.lit(s.window)).cast("int")))
    head = F.when(F.array_contains("_documents", F.col("_p")), F.substring(F.col("_text"), F.lit(1), F.least(F.col("_p"), F.lit(DOCUMENT_SAMPLE)).cast("int"))) if early else F.lit(None).cast("string")
    # past this, rows hold what is judged at one place, not the whole text
    judged = check_output(due.select(*key, "_row", "_n", "_checks", "_p", span.alias("_span"), head.alias("_head")), "_span", window_options(o), "_window")
    codes = F.when(F.col("_span").isNotNull(), _code_bits(F.col("_window"))).otherwise(0)
    if early:
        judged = check_output(judged, "_head", document_options(o), "_document")
        codes = codes + F.when(F.col("_head").isNotNull(), _code_bits(F.col("_document")) * (1 << len(CODES))).otherwise(0)
    # place and codes as one number: the least is the first failure, and groups are hashed without sorting rows
    unit = 1 << 2 * len(CODES)
    judged = judged.select(*key, "_row", "_n", "_checks", "_p", F.when(F.col("_p").isNotNull(), codes).alias("_codes"))
    failed = F.when(F.col("_codes") > 0, F.col("_p") * unit + F.col("_codes"))
    found = judged.groupBy(*key, "_row").agg(F.max("_n").alias("n_chars"), F.max("_checks").alias("checks"), F.min(failed).alias("_first"))
    reasons = F.array_compact(F.array(*[F.when(F.col("_first").bitwiseAND(1 << i) > 0, code) for i, code in enumerate(2 * CODES)]))
    return found.select(*key, "n_chars", "checks", F.floor(F.col("_first") / unit).alias("caught_at"), F.when(F.col("_first").isNotNull(), reasons).alias("reasons"))


def _code_bits(verdict: Column) -> Column:
    """The codes of a verdict's reasons, which come in the order of ``CODES``, as bits."""
    found = F.transform(verdict["reasons"], lambda r: r["code"])
    return sum((F.when(F.array_contains(found, code), 1 << i).otherwise(0) for i, code in enumerate(CODES)), F.lit(0)).cast("long")


@dataclass
class _Counters:
    """What is known of a response besides its whole text, in the order of ``_COUNTERS``."""

    n: int = 0
    since: int = 0
    checks: int = 0
    document_at: int = DOCUMENT_FROM
    settled: bool = False
    next_seq: int = 0
    waiting: int = 0
    finish_reason: str | None = None
    tool: bool = False
    timer: int = 0
    recent: str = ""
    doubted: bool = False
    again: bool = False
    listed: int = 0

    def values(self) -> tuple:
        return tuple(self.__dict__.values())

    def take(self, length: int, s: Schedule) -> tuple[bool, bool]:
        """A chunk of some length: whether a window is due now, and whether the document so far is read with it."""
        self.n, self.since = self.n + length, self.since + length
        if not length or not (self.n >= s.warmup if self.checks == 0 else self.since >= s.check_every):
            return False, False
        self.since, self.checks = 0, self.checks + 1
        head = s.early_document and not self.settled and self.n >= self.document_at
        if head:
            self.document_at, self.settled = 2 * self.n, self.n >= DOCUMENT_SAMPLE
        return True, head


class Chunk(NamedTuple):
    """A chunk as the first stage takes it."""

    seq: int
    delta: str | None
    finish_reason: str | None
    is_end: bool
    tool_call: bool
    event_ms: int = 0


_PACK = "response_id string, seqs binary, lengths binary, text string, named array<struct<i: int, finish_reason: string, is_end: boolean, tool_call: boolean>>, times binary"


def _groups(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of each group of values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The chunks of each response as one row: their texts joined, with numbers and lengths as bytes, and what else is set for few of them by place."""
    if any(batch.column(name).null_count for name in batch.schema.names if name not in ("response_id", "delta", "finish_reason", "is_end", "tool_call")):
        raise ValueError("a chunk has no seq or no time")
    order = batch.column("response_id").dictionary_encode("encode").indices.to_numpy()
    if (np.diff(order) < 0).any():
        batch = batch.take(pa.array(np.argsort(order, kind="stable")))
        order = np.sort(order, kind="stable")
    starts = np.flatnonzero(np.diff(order, prepend=-1))
    offsets = np.append(starts, len(order))
    seq, delta = batch.column("seq").to_numpy(), pc.fill_null(batch.column("delta"), "")
    finish, ends, tool = batch.column("finish_reason"), pc.fill_null(batch.column("is_end"), False), pc.fill_null(batch.column("tool_call"), False)
    at = np.flatnonzero(pc.or_(pc.or_(ends, tool), finish.is_valid()).to_numpy(zero_copy_only=False))
    place = pa.array(at)
    few = pa.StructArray.from_arrays([pa.array((at - starts[np.searchsorted(starts, at, "right") - 1]).astype("<i4")), finish.take(place), ends.take(place), tool.take(place)], ["i", "finish_reason", "is_end", "tool_call"])
    timed = "event_ms" in batch.schema.names
    columns = {
        "response_id": batch.column("response_id").take(pa.array(starts)), "seqs": _groups(seq.astype("<i8"), offsets), "lengths": _groups(pc.utf8_length(delta).to_numpy().astype("<i4"), offsets),
        "text": pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype("<i4")), delta), ""), "named": pa.ListArray.from_arrays(pa.array(np.searchsorted(at, offsets).astype("<i4")), few),
        "times": _groups(batch.column("event_ms").to_numpy().astype("<i8"), offsets) if timed else pa.nulls(len(starts), pa.binary()),
    }
    for name in batch.schema.names[7:]:  # the event time: of a row it is that of its newest chunk
        newest = np.maximum.reduceat(batch.column(name).cast(pa.int64()).to_numpy(), starts)
        columns[name] = pa.array(newest, pa.int64()).cast(batch.column(name).type)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def packed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with those of a response that stand in one batch as one row; ``Chunk`` names their columns, an event time may follow."""
    more = [f", {f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields[7:]]
    return chunks.mapInArrow(lambda batches: (pack(b) for b in batches if b.num_rows), _PACK + "".join(more))


def unpacked(seqs: bytes, lengths: bytes, text: str, named: list, times: bytes | None) -> list[Chunk]:
    """The chunks of a packed row."""
    seqs, ends = np.frombuffer(seqs, "<i8").tolist(), np.cumsum(np.frombuffer(lengths, "<i4")).tolist()
    at = np.frombuffer(times, "<i8").tolist() if times is not None else [0] * len(seqs)
    found = [Chunk(seq, text[low:high], None, False, False, ms) for seq, low, high, ms in zip(seqs, [0, *ends], ends, at)]
    for x in named:
        found[x["i"]] = found[x["i"]]._replace(finish_reason=x["finish_reason"], is_end=x["is_end"], tool_call=x["tool_call"])
    return found


def one_text(deltas: list[str]) -> str:
    """Texts as one with marks between them."""
    text = "".join(deltas)
    if _MARK in text or _ESCAPE in text:
        deltas = [d.replace(_ESCAPE, _ESCAPE + "e").replace(_MARK, _ESCAPE + "m") for d in deltas]
    return _MARK.join(deltas)


def each_of(deltas: str, ends: str) -> Column:
    """The array of ``deltas`` and ``ends`` that stand in two columns as one text each."""
    whole = lambda d: F.when(d.contains(_ESCAPE), F.replace(F.replace(d, F.lit(_ESCAPE + "m"), F.lit(_MARK)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))).otherwise(d)
    parts, places = F.split(deltas, _MARK), F.split(ends, ",").cast("array<bigint>")
    return F.arrays_zip(F.when(F.col(deltas).contains(_ESCAPE), F.transform(parts, whole)).otherwise(parts).alias("deltas"), places.alias("ends"))


class Spans(StatefulProcessor):
    """Applies chunks in order and says which spans are due.

    State: counters with the last window as one value, the first characters as a value while they still grow, the text of responses longer than a window
    as a list with one entry for each call, chunks that wait for earlier ones as a map, and a mark for finished responses.  Each look at the state is a message
    to the JVM, so none is asked for what the counters tell.

    In event time chunks that are replayed count once: those before the next one have been applied, and the mark of a finished response keeps what has come, for
    ``remembered_ms`` after its newest chunk even if silence is shorter.
    """

    def __init__(self, schedule: Schedule, silence_ms: int | None, event_time: bool, pass_chunks: bool, report_late: bool, passing: CheckOptions | None = None, windows: bool = True, remembered_ms: int = 0):
        self.s, self.silence_ms, self.event_time, self.pass_chunks, self.report_late = schedule, silence_ms, event_time, pass_chunks, report_late
        self.passing, self.windows, self.remembered_ms = passing, windows, remembered_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.front = handle.getValueState("front", "text string") if self.s.early_document else None
        self.parts = handle.getListState("parts", "text string")
        self.waiting = handle.getMapState("waiting", "seq bigint", "delta string, finish_reason string, is_end boolean, tool_call boolean")
        # in processing time the mark expires by itself; in event time a timer removes it
        ttl = {"ttlDurationMs": self.silence_ms} if self.silence_ms and not self.event_time else {}
        self.finished = handle.getValueState("finished", _FINISHED, **ttl) if self.silence_ms else None

    def close(self) -> None:
        pass

    def _remind(self, c: _Counters, timer_values, newest: int) -> None:
        """Move the timer of silence to after what has just come."""
        if not self.silence_ms:
            return
        now = newest if self.event_time else timer_values.getCurrentProcessingTimeInMs()
        at = max(now + self.silence_ms, c.timer)
        if at != c.timer:
            if c.timer:
                self.handle.deleteTimer(c.timer)
            self.handle.registerTimer(at)
            c.timer = at

    def _clear(self, stored: bool, listed: int, waiting: int) -> None:
        held = (self.counters, self.front, self.parts if listed else None, self.waiting if waiting else None)
        for state in held if stored else ():
            if state is not None:
                state.clear()

    def _stored(self) -> tuple | None:
        return self.counters.get() if self.counters.exists() else None

    def _end(self, key: tuple, c: _Counters, known: str | None, more: str) -> tuple:
        """A turn with tool calls ends as a ``preamble``: its text may be short, unfinished or absent.  Without ``known``, what came before is in the list."""
        if known is None:
            known = "".join(part[0] for part in self._parts(c))
        text = known + more
        return key[0], c.next_seq - 1, "preamble" if c.tool else "end", c.n, None, text, None, c.finish_reason, None, None

    def _parts(self, c: _Counters) -> Iterator[tuple]:
        return self.parts.get()

    def _append(self, c: _Counters, text: str) -> None:
        self.parts.appendValue((text,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = [r for df in rows for r in df.astype(object).where(df.notna(), None).itertuples(index=False)]
        yield pd.DataFrame(self._told(key, come, timerValues)[1], columns=_EVENT_NAMES)

    def _told(self, key: tuple, come: list, timer_values) -> tuple[bool, list[tuple]]:
        """What there is to tell, and whether a window of the response may have failed."""
        found = self._stored()  # a response that comes and ends at once costs no other look at the state
        stored, c = found is not None, _Counters(*found or ())
        if self.finished is not None and (c.again or not stored) and self.finished.exists():
            at, next_seq, more, over = self.finished.get()
            if self.event_time:
                known = set(more or ())
                come = list({int(r.seq): r for r in reversed(come) if r.seq >= next_seq and r.seq not in known}.values())[::-1]
            if not over:
                if self.event_time and come:
                    self.finished.update((at, next_seq, [*(more or ()), *(int(r.seq) for r in come)], False))
                return False, [(key[0], r.seq, "late", None, r.delta, None, None, None, None, None) for r in come] if self.report_late else []
            c.again = True
        out = self._apply(key, come, timer_values, c, stored)
        return c.doubted, out

    def _finish(self, at: int, next_seq: int, more: list[int], over: bool) -> None:
        """Mark a response as finished; what is known of an earlier one of its name stays known."""
        if self.finished.exists():
            _, before, known, _ = self.finished.get()
            next_seq, more = max(before, next_seq), sorted({*more, *(known or ())})
        self.finished.update((at, next_seq, more, over))

    def _held(self, c: _Counters) -> list[int]:
        """Chunks that wait for earlier ones, where it matters that they have come."""
        return [int(k[0]) for k in self.waiting.keys()] if c.waiting and self.event_time else []

    def _apply(self, key: tuple, come: list, timer_values, c: _Counters, stored: bool) -> list[tuple]:
        out: list[tuple] = []
        # a window holds all of a text that is no longer; only longer ones are listed
        was, held, first, s, newest = c.n, c.waiting, c.next_seq, self.s, 0
        front = self.front.get()[0] if self.front is not None and c.n else ""
        fronted, fresh, done, before, came, due = len(front), [], False, c.recent, len(c.recent), []
        at_hand: dict[int, tuple] = {}
        ends: list[int] = []
        for r in come:
            if r.seq >= c.next_seq and r.seq not in at_hand and not (self.event_time and c.waiting and self.waiting.containsKey((int(r.seq),))):
                at_hand[int(r.seq)] = (r.delta, r.finish_reason, bool(r.is_end), bool(r.tool_call))
                newest = max(newest, int(r.event_ms))
        if self.event_time and not at_hand:
            return out
        while not done:
            chunk = at_hand.pop(c.next_seq, None)
            if c.waiting and self.waiting.containsKey((c.next_seq,)):
                chunk = tuple(self.waiting.getValue((c.next_seq,))) if chunk is None else chunk
                self.waiting.removeKey((c.next_seq,))
                c.waiting -= 1
            if chunk is None:
                break
            delta, finish, done, tool = chunk[0] or "", *chunk[1:]
            seq, c.next_seq = c.next_seq, c.next_seq + 1
            c.finish_reason, c.tool = finish or c.finish_reason, c.tool or tool
            fresh.append(delta)
            came += len(delta)
            checked, early = c.take(len(delta), s)
            if s.early_document and len(front) < DOCUMENT_SAMPLE:
                front = (front + delta)[:DOCUMENT_SAMPLE]
            ends.append(c.n)
            if checked and self.windows:
                due.append((seq, c.n, came, front if early else None))
        text = "".join(fresh)
        whole = before + text
        measured = [came for *_, came, head in due if head is None] if self.passing is not None else []
        passes = dict(zip(measured, surely_pass(whole, measured, s.window, self.passing))) if measured else {}
        out = [(key[0], seq, "window", n, None, whole[max(0, came - s.window) : came], head, None, None, None) for seq, n, came, head in due if head is not None or not passes.get(came)]
        c.doubted = c.doubted or bool(out)
        if done:
            out.append(self._end(key, c, None if was > s.window else before, text))
        if self.pass_chunks and ends:
            out.append((key[0], first, "chunks", None, None, None, None, None, fresh, ends))
        if done:
            timer, again = c.timer, c.again
            waiting = [*at_hand, *self._held(c)] if self.event_time else []
            self._clear(stored, c.listed, held)
            if self.finished is not None:
                c.timer = timer
                self._remind(c, timer_values, newest)
                self._finish(c.timer, c.next_seq, waiting, False) if again else self.finished.update((c.timer, c.next_seq, waiting, False))
            return out
        for seq, chunk in at_hand.items():
            if not (c.waiting and self.waiting.containsKey((seq,))):
                self.waiting.updateValue((seq,), chunk)
                c.waiting += 1
        if text:
            if c.n > s.window:
                self._append(c, text if was > s.window else whole)
                c.listed += 1
            c.recent = whole[-s.window :]
            if self.front is not None and len(front) > fronted:
                self.front.update((front,))
        self._remind(c, timer_values, newest)
        self.counters.update(c.values())
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._silent(key, expiredTimerInfo)[1], columns=_EVENT_NAMES)

    def _silent(self, key: tuple, expired) -> tuple[bool, list[tuple]]:
        """What there is to tell when a timer expires, and whether a window of the response may have failed."""
        now = expired.getExpiryTimeInMs() if expired is not None else None
        found = self._stored()
        c = None if found is None else _Counters(*found)
        if c is not None and now in (None, c.timer):  # silent for too long: it ends with what has come in order
            out, waiting = [self._end(key, c, None if c.listed else c.recent, "")], self._held(c)
            self._clear(True, c.listed, c.waiting)
            if self.remembered_ms > self.silence_ms:
                self._remember(c.timer, c.next_seq, waiting)
            return c.doubted, out
        if self.finished is not None and self.finished.exists():
            at, next_seq, more, over = self.finished.get()
            if now in (None, at):
                self.finished.clear()
                if not over and self.remembered_ms > self.silence_ms:
                    self._remember(at, next_seq, more or [])
        return False, []

    def _remember(self, at: int, next_seq: int, more: list[int]) -> None:
        """Keep what has come of a response that is over, after its time of silence."""
        at += self.remembered_ms - self.silence_ms
        self.handle.registerTimer(at)
        self._finish(at, next_seq, more, True)


class _Kept:
    """A value for each response of a bucket, handed to ``Spans`` as that of the response at hand.

    With a count of what the bucket keeps, all of it is read at once where much of it is wanted, nothing where there is none, and all of it is cleared at once where nothing stays.
    """

    def __init__(self, state, counted: bool):
        self.state, self.counted, self.name, self.n, self.known, self.all, self.gone = state, counted, None, 0, {}, False, set()

    def open(self, n: int, wanted: int) -> None:
        self.n, self.gone, self.all = n, set(), self.counted and 4 * wanted >= n
        self.known = {k[0]: v for k, v in self.state.iterator()} if n and self.all else {}

    def get(self) -> tuple | None:
        if not self.counted:
            return self.state.getValue((self.name,))
        if not self.all and self.name not in self.known:
            self.known[self.name] = self.state.getValue((self.name,))
        return self.known.get(self.name)

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple) -> None:
        if self.counted:
            self.n += not self.exists() and self.name not in self.gone
            self.gone.discard(self.name)
            self.known[self.name] = value
        self.state.updateValue((self.name,), value)

    def clear(self) -> None:
        if not self.counted:
            self.state.removeKey((self.name,))
        elif self.exists():
            self.gone.add(self.name)
            self.known[self.name] = None

    def close(self) -> int:
        """Let go of what was cleared, and say how much there is."""
        if self.gone and len(self.gone) == self.n:
            self.state.clear()
        else:
            for name in self.gone:
                self.state.removeKey((name,))
        return self.n - len(self.gone)


class _Waiting:
    """The chunks that wait, of the response at hand."""

    def __init__(self, state):
        self.state, self.name = state, None
        for method in ("containsKey", "getValue", "removeKey"):
            setattr(self, method, lambda key, of=getattr(state, method): of((self.name, *key)))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.state.updateValue((self.name, *key), value)

    def keys(self) -> list[tuple]:
        return [key[1:] for key in self.state.keys() if key[0] == self.name]

    def clear(self) -> None:
        for key in self.keys():
            self.removeKey(key)


class _Timers:
    """The timers of a bucket's responses: a timer of the bucket for each time, and whose it is."""

    def __init__(self, handle, state):
        self.handle, self.state, self.name, self.moved = handle, state, None, {}

    def registerTimer(self, at: int) -> None:
        self.moved.setdefault(at, {})[self.name] = True

    def deleteTimer(self, at: int) -> None:
        self.moved.setdefault(at, {})[self.name] = False

    def close(self, expired: int | None = None) -> None:
        for at, whose in self.moved.items():
            found = self.state.getValue((at,))
            before = set(found[0]) if found is not None else set()
            names = before - set(whose) | {name for name, on in whose.items() if on}
            if names and names != before:
                self.state.updateValue((at,), (sorted(names, key=lambda name: name or ""),))
            elif before and not names:
                self.state.removeKey((at,))
            if names and not before:
                self.handle.registerTimer(at)
            elif before and not names and at != expired:
                self.handle.deleteTimer(at)
        self.moved = {}


class SpansOfRows(Spans):
    """The same on rows of packed chunks, for a bucket of responses at once.

    Rows of a response whose windows have all passed need no memory of firing behind this stage, so they share the bucket's ``lane``.
    """

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "live bigint, finished bigint")
        kept = lambda name, schema, counted=True, **ttl: _Kept(handle.getMapState(name, "response_id string", schema, **ttl), counted)
        self.counters, self.texts = kept("counters", _COUNTERS), handle.getMapState("parts", "response_id string, i bigint", "text string")
        self.front = kept("front", "text string", False) if self.s.early_document else None
        self.waiting = _Waiting(handle.getMapState("waiting", "response_id string, seq bigint", "delta string, finish_reason string, is_end boolean, tool_call boolean"))
        # in processing time the mark expires by itself; in event time a timer removes it
        ttl = {"ttlDurationMs": self.silence_ms} if self.silence_ms and not self.event_time else {}
        self.finished = kept("finished", _FINISHED, not ttl, **ttl) if self.silence_ms else None
        # each variable costs a task time to set up
        self.handle = _Timers(handle, handle.getMapState("due", "at bigint", "names array<string>") if self.silence_ms else None)
        self.parts = self  # what is listed is cleared by ``clear``
        self.name, self.many = None, 0

    def _stored(self) -> tuple | None:
        found = self.counters.get()
        self.many = 0 if found is None else found[-1]
        return found

    def _parts(self, c: _Counters) -> Iterator[tuple]:
        return (self.texts.getValue((self.name, i)) for i in range(c.listed))

    def _append(self, c: _Counters, text: str) -> None:
        self.texts.updateValue((self.name, c.listed), (text,))

    def clear(self) -> None:
        for i in range(self.many):
            self.texts.removeKey((self.name, i))

    def _of_each(self, names, told, expired: int | None = None) -> Iterator[tuple]:
        """What is told of each response, with the bucket's state at hand."""
        live, marked = self.held.get() or (0, 0)
        self.counters.open(live, len(names))
        if self.finished is not None:
            self.finished.open(marked, len(names))
        for name in names:
            for state in (self, self.counters, self.front, self.waiting, self.finished, self.handle):
                if state is not None:
                    state.name = name
            yield told(name)
        after = self.counters.close(), self.finished.close() if self.finished is not None and self.finished.counted else 0
        self.handle.close(expired)
        if after != (live, marked):
            self.held.update(after) if any(after) else self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        come: dict[str | None, list[Chunk]] = {}
        watermark = timerValues.getCurrentWatermarkInMs() if self.event_time else 0
        for r in rows:
            chunks = unpacked(*(r[name] for name in _PACKED_NAMES))
            come.setdefault(r["response_id"], []).extend(c for c in chunks if c.event_ms > watermark or watermark <= 0)
        yield from self._rows(key, self._of_each(come, lambda name: self._told((name,), come[name], timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        found = self.handle.state.getValue((at,))
        names = list(found[0]) if found is not None else []

        def told(name: str | None) -> tuple[bool, list[tuple]]:
            self.handle.deleteTimer(at)
            return self._silent((name,), expiredTimerInfo)

        yield from self._rows(key, self._of_each(names, told, at))

    def _rows(self, key: tuple, each: Iterator[tuple[bool, list[tuple]]]) -> Iterator[Row]:
        for doubted, told in each:
            for response_id, seq, kind, at, delta, span, head, finish, deltas, ends in told:
                chunks = (one_text(deltas), ",".join(map(str, ends))) if deltas else (delta, None)
                yield _ROW(None if doubted else key[0], response_id, seq, kind, at, chunks[0], span, head, finish, chunks[1])


_PACKED_NAMES = ("seqs", "lengths", "text", "named", "times")


_ROW = Row(*_names(ROW))


_REPORT = "response_id string, seq bigint, kind string, at_chars bigint, delta string, verdict string, ends string"
_REPORTED = Row(*_names(_REPORT))
ALONE = -1


class Firing(StatefulProcessor):
    """Lets chunks pass until a check fails, reports that check, and remembers the response as fired until its end.

    Rows in a lane are of responses of which no check has failed so far; they pass as they are.
    """

    def __init__(self, on_degenerate: str):
        self.on_degenerate = on_degenerate

    def init(self, handle) -> None:
        self.fired = handle.getValueState("fired", "at bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] == ALONE:
            yield from (_REPORTED(*r) for r in self._of_one(key[1], rows))
            return
        for _, _, response_id, seq, kind, at, delta, _, verdict, ends in rows:
            if kind in ("chunks", "late") or verdict is not None:
                yield _REPORTED(response_id, seq, kind, at, delta, verdict, ends)

    def _of_one(self, name: str | None, rows) -> list[tuple]:
        come = sorted(rows, key=lambda r: (r.seq, ("chunks", "window", "preamble", "end", "late").index(r.kind)))
        # a response that has just begun cannot have fired
        was = fired = not any(r.kind == "chunks" and r.seq == 0 for r in come) and self.fired.exists()
        ended, out, at, last, packed = False, [], 0, None, []
        for r in come:
            row = (name, r.seq, r.kind, r.at_chars, r.delta)
            if r.kind == "chunks":
                packed.append(r)
            elif r.kind == "late":
                out.append((*row, None, None))
            elif r.kind == "window":
                if not fired and not r.ok:
                    if self.on_degenerate == "throw":
                        raise DegenerateOutputError({"reasons": [{"message": f"response {name} degenerates at character {r.at_chars}: {r.verdict}"}]})
                    fired, at, last = True, int(r.at_chars), int(r.seq)
                    out.append((name, r.seq, "fired", r.at_chars, None, r.verdict, None))
            else:
                if not fired and r.verdict is not None:
                    out.append((*row, r.verdict, None))
                ended = True
        for r in packed:
            ends = r.ends.split(",")
            keep = len(ends) if self.on_degenerate == "ignore" or not fired else 0 if was else max(0, last - r.seq + 1)
            if keep:
                out.append((name, r.seq, "chunks", None, _MARK.join(r.delta.split(_MARK)[:keep]), None, ",".join(ends[:keep])))
        if ended and was:
            self.fired.clear()
        elif fired and not was and not ended:
            self.fired.update((at,))
        return out


def spans_to_judge(chunks: DataFrame, s: Schedule = Schedule(), silence_ms: int | None = None, event_time: str | None = None, delay: str = "10 minutes", pass_chunks: bool = False, report_late: bool = False, passing: CheckOptions | None = None, windows: bool = True) -> DataFrame:
    """Spans due for judgement in a stream ``(response_id, seq, delta, finish_reason, is_end)``, perhaps with ``tool_call``.

    Chunks are applied in the order of ``seq`` from 0, whatever batches they come in; gaps wait, and of chunks with one number the first
    counts.  A response ends once; with early document checks a window carries the ``head`` of its document when that is due.  The last stop reason that a
    chunk names holds.  With ``silence_ms`` a response that stays silent for so long is ended with what has come in order, and a
    finished response is remembered for that time: chunks after its end are passed over, or become rows of kind ``late`` with ``report_late``.
    Without it, state goes with the end, so ids must not be used again.

    ``event_time`` names a column of timestamps: silence is then measured on it, chunks that are replayed within ``delay`` count
    once, and what comes later than that is dropped.  ``pass_chunks`` adds a row of kind ``chunks`` for those that are applied together: ``deltas``
    with their ``ends`` in the text, the first at ``seq``, both as one text (``each_of`` takes them apart).  A row for each chunk would cost more than the chunk on its way through Python and a shuffle.
    Windows that surely pass under the options ``passing`` are left out, and without ``windows`` all of them are, for readers of ends only.
    """
    tool = F.coalesce("tool_call", F.lit(False)) if "tool_call" in chunks.columns else F.lit(False)
    mode, remembered = "EventTime" if event_time and silence_ms else "ProcessingTime" if silence_ms else "None", 0
    if event_time and silence_ms:
        # the first stage knows the chunks it has applied; a state for each chunk would cost more than all of the others
        remembered = chunks.sparkSession.sql("select unix_millis(timestamp_seconds(0) + cast(? as interval))", args=[delay]).first()[0]
    elif event_time:
        chunks = chunks.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["response_id", "seq"])
    times = [F.unix_millis(event_time).alias("event_ms"), event_time] if remembered else []
    rows = packed(chunks.select("response_id", "seq", "delta", "finish_reason", "is_end", tool.alias("tool_call"), *times))
    rows = (rows.withWatermark(event_time, delay) if remembered else rows).withColumn("bucket", F.pmod(F.xxhash64("response_id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithState(SpansOfRows(s, silence_ms, mode == "EventTime", pass_chunks, report_late, passing, windows, remembered), ROW, "Append", mode)


def guard_stream(chunks: DataFrame, options: CheckOptions | str, s: Schedule = Schedule(), on_degenerate: str = "abort", silence_ms: int | None = None, event_time: str | None = None, delay: str = "10 minutes", report_late: bool = False) -> DataFrame:
    """``response_id``, ``seq``, ``kind``, ``at_chars``, ``delta``, ``verdict`` and ``streaming`` (true) of a guarded stream of chunks.

    ``chunk`` rows are the chunks that reach the reader.  The first check that fails gives a row ``fired``: under ``abort`` no
    chunk follows the one it fell on, under ``ignore`` chunks go on, under ``throw`` the query fails.  A response that has not fired ends with a row
    ``end`` or ``preamble``; one that has fired is judged no further.  A response's stage of firing is remembered until its end.
    """
    # a window that passes tells the second stage nothing
    judged = judge(spans_to_judge(chunks, s, silence_ms, event_time, delay, True, report_late, window_options(_resolved(options))), options, ("seq", "delta", "ends", "lane"), True)
    alone = F.when(F.col("lane").isNull(), F.col("response_id")).otherwise("")
    rows = judged.select(
        F.coalesce("lane", F.lit(ALONE)).alias("lane"), alone.alias("alone"), "response_id", "seq", "kind", "at_chars", "delta", F.col("verdict.ok").alias("ok"), F.to_json("verdict").alias("verdict"), "ends"
    )
    found = rows.groupBy("lane", "alone").transformWithState(Firing(on_degenerate), _REPORT, "Append", "None")
    several = F.col("kind") == "chunks"
    # packed chunks don't go with each of their rows
    each = found.select("response_id", "seq", "kind", "at_chars", F.when(~several, F.col("delta")).alias("delta"), "verdict", F.posexplode_outer(F.when(several, each_of("delta", "ends"))).alias("i", "chunk"))
    of = lambda name, other: F.when(several, F.col("chunk")[name]).otherwise(F.col(other)).alias(other)
    rows = each.select(
        "response_id", (F.col("seq") + F.coalesce("i", F.lit(0))).alias("seq"), F.when(several, "chunk").otherwise(F.col("kind")).alias("kind"), of("ends", "at_chars"), of("deltas", "delta"),
        F.from_json("verdict", VERDICT).alias("verdict"),
    )
    return rows.withColumn("streaming", F.lit(True)).select("response_id", "seq", "kind", "at_chars", "delta", "verdict", "streaming")


def judge(spans: DataFrame, options: CheckOptions | str, carry: tuple[str, ...] = (), keep_blank: bool = False) -> DataFrame:
    """``spans`` without their text, with the ``verdict`` that suits their kind: window, document, preamble or end.

    A window that comes with the ``head`` of its document gets one verdict on both.  A blank preamble is not judged: it has no row, or
    with ``keep_blank`` a row without verdict, as other kinds have.
    """
    o = _resolved(options)
    blank = (F.col("kind") == "preamble") & (trim(F.col("span")) == "")
    spans = spans.withColumn("span", F.when(~blank, F.col("span"))) if keep_blank else spans.where(~blank)
    early = "head" in spans.columns and (o.expect_script is not None or o.prompt is not None)
    document = F.when(F.col("kind") == "document", F.col("span"))
    names = [*spans.columns, "_document"]
    spans = check_output(spans.withColumn("_text", F.coalesce(document, F.col("head")) if early else document), "_text", document_options(o), "_document").select(*names)
    # the other kinds are measured once, each row by the detectors of its kind, and differ in what counts
    ended = F.col("kind") == "end"
    text, finished = F.when(F.col("kind").isin("window", "preamble", "end"), F.col("span")), o.but(finish_reason=F.col("finish_reason"))
    measured, found = measures(spans, text, finished, "_j_", {"whole": F.col("kind") != "window", "ended": ended})
    of = lambda codes: verdict_of({c: found[c] for c in found if c in codes}, F.col("_j_INVALID_JSON")["value"] if o.expect_json and "INVALID_JSON" in codes else F.lit(None).cast("string"), F.col("_j_text").isNull())
    signs = ("EMPTY", "REPETITION", "TAIL_LOOP")
    verdicts = {"window": of(signs), "document": F.col("_document"), "preamble": of((*signs, "LOW_ENTROPY", "SCRIPT_MISMATCH", "PROMPT_ECHO", "LANG_MISMATCH")), "end": of(CODES)}
    if early:
        verdicts["window"] = merge_early(verdicts["window"], F.when(F.col("head").isNotNull(), F.col("_document")))
    spans = measured
    verdict = F.coalesce(*[F.when((F.col("kind") == kind) & F.col("span").isNotNull(), v) for kind, v in verdicts.items()])
    return spans.select("response_id", "at_chars", "kind", *carry, verdict.alias("verdict"))


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_ROCKS[0]) if before is None else spark.conf.set(_ROCKS[0], before)


def report_to_table(report: DataFrame, path: str) -> DataFrame:
    """Run ``guard_stream`` until its input is used up; ``path`` gets its rows and the checkpoint, from which a later call goes on."""
    spark = report.sparkSession
    with rocks_db(spark):
        query = report.writeStream.format("parquet").option("path", f"{path}/report").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(report.schema).parquet(f"{path}/report")


def chunked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Texts as the chunks ``(response_id, seq, delta, finish_reason, is_end)`` they might have come in."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # one pass over a text: a substring for each chunk would begin at the text's start each time
    parts = F.when(whole == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    each = let(parts, lambda p: F.transform(p, lambda d, i: F.struct(i.cast("long").alias("seq"), d.alias("delta"), F.lit(None).cast("string").alias("finish_reason"), (i == F.size(p) - 1).alias("is_end"))))
    return df.select(F.col(key).cast("string").alias("response_id"), F.inline(each))


def run_to_table(spans: DataFrame, options: CheckOptions | str, path: str) -> DataFrame:
    """Judge a stream of spans until its input is used up; ``path`` gets the verdicts and the checkpoint.

    Each micro-batch has a folder of its own, so that one that runs again replaces what it wrote.
    """
    spark = spans.sparkSession
    write = lambda batch, number: judge(batch, options).write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
    with rocks_db(spark):
        query = spans.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/verdicts").drop("batch")


def first_failures(judged: DataFrame) -> DataFrame:
    """One row for each response that fails: where it first does, and why.  For batches and ``foreachBatch``."""
    rows = judged.where(~F.col("verdict.ok"))
    order = F.struct("at_chars", F.when(F.col("kind") == "window", 0).when(F.col("kind") == "document", 1).otherwise(2))
    return rows.groupBy("response_id").agg(F.min("at_chars").alias("caught_at"), F.min_by(F.transform("verdict.reasons", lambda r: r["code"]), order).alias("reasons"), F.min_by("kind", order).alias("kind"))


def pass_through(chunks: DataFrame, failures: DataFrame, on_degenerate: str = "abort") -> DataFrame:
    """Chunks that reach the reader under a policy: ``abort`` ends a response with the failing chunk, ``ignore`` keeps all, ``throw`` fails the job."""
    if on_degenerate == "ignore":
        return chunks
    joined = chunks.join(failures.select("response_id", "caught_at"), "response_id", "left")
    before = joined.selectExpr("*", "coalesce(sum(length(delta)) over (partition by response_id order by seq rows between unbounded preceding and 1 preceding), 0) as _before")
    if on_degenerate == "throw":
        stop = F.when(F.col("caught_at").isNotNull(), F.raise_error(F.concat(F.lit("degenerate output: "), "response_id")).cast("boolean")).otherwise(F.lit(True))
        return before.where(stop).select(*chunks.columns)
    return before.where(F.col("caught_at").isNull() | (F.col("_before") < F.col("caught_at"))).select(*chunks.columns)
