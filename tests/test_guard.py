"""The stream guard's two stages against a stand-in for Spark's state, and whole streams."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F

from gristmill.operators.check import PRESETS, check_output
from gristmill.streaming import guard, sure
from tests.test_detectors import PROSE


class Handle:
    """State as Spark hands it to a processor, for one key; counts the characters that are written."""

    def __init__(self):
        self.states, self.timers, self.written = {}, set(), 0

    def _state(self, name):
        return self.states.setdefault(name, State(self))

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self._state(name)

    getListState = getValueState

    def getMapState(self, name, key_schema, schema, ttlDurationMs=None):
        return self._state(name)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    def __init__(self, handle):
        self.handle, self.value, self.items, self.map = handle, None, [], {}

    def _count(self, value):
        self.handle.written += len(repr(value))

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(self.items)

    def update(self, value):
        self._count(value)
        self.value = value

    def appendValue(self, value):
        self._count(value)
        self.items.append(value)

    def clear(self):
        self.value, self.items, self.map = None, [], {}

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self._count(value)
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


class Now:
    def __init__(self, ms=0):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


class Fed:
    """A processor that is handed chunks, and what it gives back."""

    def __init__(self, silence_ms=None, event_time=False, schedule=guard.Schedule(), report_late=False):
        self.handle, self.of = Handle(), guard.Spans(schedule, silence_ms, event_time, False, report_late)
        self.of.init(self.handle)

    def __call__(self, *chunks, at=0):
        rows = pd.DataFrame(chunks, columns=["seq", "delta", "finish_reason", "is_end", "tool_call"]).assign(event_ms=at)
        return self._told(self.of.handleInputRows(("a",), iter([rows]), Now(at)))

    def silent(self, at):
        self.handle.timers.discard(at)
        return self._told(self.of.handleExpiredTimer(("a",), Now(at), None))

    def _told(self, found):
        return [(r.at_chars, r.kind, r.span, r.finish_reason) for out in found for r in out.itertuples(index=False)]

    def holds(self):
        return {name for name, s in self.handle.states.items() if s.value is not None or s.items or s.map}


def test_a_finished_response_ends_once():
    fed = Fed(1000)
    assert fed((0, "A fine answer.", None, False, False), (1, "", "stop", True, False)) == [(14, "end", "A fine answer.", "stop")]
    assert fed.holds() == {"finished"}
    assert fed((2, "more", None, True, False)) == [] and fed.holds() == {"finished"}


def test_late_chunks_are_reported_if_asked_for():
    fed = Fed(1000, event_time=True, report_late=True)
    fed((0, "x", None, True, False), at=50)
    assert fed((1, "more", None, False, False), at=60) == [(None, "late", None, None)]
    assert fed.silent(1050) == [] and fed.holds() == set()


def test_state_goes_with_the_end_or_with_silence():
    fed = Fed()
    fed((0, "x", None, True, False))
    assert fed.holds() == set()
    fed = Fed(50)
    assert fed((0, "half an ans", None, False, False), at=100) == [] and fed.handle.timers == {150}
    assert fed((2, "lost", None, False, False), at=120) == [] and fed.handle.timers == {170}
    assert fed.silent(170) == [(11, "end", "half an ans", None)] and fed.holds() == set()


def test_a_tool_call_makes_a_preamble_and_the_last_reason_holds():
    fed = Fed()
    assert fed((2, "", "tool_calls", True, False), (0, "Let me look", None, False, False)) == []
    assert fed((1, "", "length", False, True)) == [(11, "preamble", "Let me look", "tool_calls")]


def test_chunks_that_come_again_count_once():
    fed = Fed()
    fed((0, "one ", None, False, False), (2, "three", None, False, False))
    fed((0, "one ", None, False, False), (2, "three", None, False, False), (1, "two ", None, False, False), (2, "other", None, False, False))
    assert fed((3, "", None, True, False)) == [(13, "end", "one two three", None)]


def test_windows_come_on_schedule_with_the_head_of_the_document():
    fed = Fed(schedule=guard.Schedule(early_document=True))
    found = [(n, kind, len(span)) for i in range(30) for n, kind, span, _ in fed((i, "x" * 100, None, i == 29, False))]
    assert found == [(n, "window", min(n, 2000)) for n in range(300, 3001, 400)] + [(3000, "end", 3000)]


def test_what_is_written_grows_in_proportion():
    def written(n):
        fed = Fed()
        for i in range(n):
            fed((i, "word " * 20, None, False, False))
        return fed.handle.written

    # beside each chunk, one window and the counters are written anew
    assert written(400) < 2.2 * written(200) and written(400) < 400 * 2600


def report_of(spark, stages, tmp_path, options="chat", **more):
    """Rows of a guarded stream whose input comes in stages, each run from the last one's checkpoint."""
    for i, rows in enumerate(stages):
        schema = "response_id string, seq bigint, delta string, finish_reason string, is_end boolean"
        df = spark.createDataFrame([(*r[:3], None, r[3]) for r in rows], schema)
        if "event_time" in more:
            df = df.withColumn("sent", F.timestamp_seconds(F.lit(10**9) + F.col("seq")))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/chunks")
        found = guard.report_to_table(guard.guard_stream(stream, options, **more), f"{tmp_path}/run")
    return [(r["response_id"], r["seq"], r["kind"], [x["code"] for x in r["verdict"]["reasons"]] if r["verdict"] else None) for r in found.orderBy("response_id", "seq", F.expr("kind <> 'chunk'")).collect()]


LOOP = ("again and again " * 20)[:300]


def test_nothing_passes_or_is_judged_after_firing_across_restarts(spark, tmp_path):
    loop = [("a", i, LOOP, i == 5) for i in range(6)]
    fine = [("b", i, PROSE[i * 200 : i * 200 + 200], i == 2) for i in range(3)]
    found = report_of(spark, [loop[:1] + fine[:1], loop[1:3] + fine[1:2], loop[3:] + fine[2:]], tmp_path)
    assert found == [("a", 0, "chunk", None), ("a", 0, "fired", ["REPETITION"])] + [("b", i, "chunk", None) for i in range(3)] + [("b", 2, "end", [])]


def test_ignore_lets_chunks_pass_but_reports_once(spark, tmp_path):
    found = report_of(spark, [[("a", i, LOOP, i == 3) for i in range(4)]], tmp_path, on_degenerate="ignore")
    assert [x[2] for x in found] == ["chunk", "fired", "chunk", "chunk", "chunk"]


def test_throw_fails_the_query(spark, tmp_path):
    with pytest.raises(StreamingQueryException, match="degenerates at character 300"):
        report_of(spark, [[("a", i, LOOP, i == 3) for i in range(4)]], tmp_path, on_degenerate="throw")


def test_replayed_and_late_chunks_change_nothing(spark, tmp_path):
    chunks = [("b", i, PROSE[i * 200 : i * 200 + 200], i == 2) for i in range(3)]
    stages = [chunks[:2], chunks, chunks[1:] + [("b", 3, LOOP, False), ("b", 4, LOOP, True)]]
    found = report_of(spark, stages, tmp_path, event_time="sent", delay="1 hour", silence_ms=3_600_000, report_late=True)
    assert found == [("b", i, "chunk", None) for i in range(3)] + [("b", 2, "end", []), ("b", 3, "late", None), ("b", 4, "late", None)]


def test_settings_of_the_session_are_put_back(spark):
    before = spark.conf.get(guard._ROCKS[0], None)
    with guard.rocks_db(spark):
        assert spark.conf.get(guard._ROCKS[0]) == guard._ROCKS[1]
    assert spark.conf.get(guard._ROCKS[0], None) == before


def test_replay_keeps_rows_of_one_key_apart(spark):
    rows = spark.createDataFrame([(1, LOOP * 2), (1, PROSE)], "id int, text string")
    found = guard.replay(rows, ["id"], "text", "chat", 100).orderBy("n_chars").collect()
    assert sorted((r["n_chars"], r["caught_at"]) for r in found) == sorted([(600, 300), (len(PROSE), None)], key=lambda x: x[0])


def test_preambles_are_judged_as_such(spark):
    spans = spark.createDataFrame([("a", 3, "preamble", "Hm,", "length"), ("b", 3, "end", "Hm,", "length"), ("c", 0, "preamble", " ", None), ("d", 0, "end", "", None)], guard.SPAN)
    found = {r["response_id"]: [x["code"] for x in r["verdict"]["reasons"]] for r in guard.judge(spans, PRESETS["chat"].but(max_truncation=0.75)).collect()}
    assert found == {"a": [], "b": ["TOO_SHORT", "TRUNCATED"], "d": ["EMPTY"]}


def test_policies(spark):
    chunks = guard.chunked(spark.createDataFrame([("a", "x" * 30), ("b", "y" * 30)], "id string, text string"), "id", "text", 10)
    failures = spark.createDataFrame([("a", 20)], "response_id string, caught_at long")
    size = lambda policy: {r[0]: r[1] for r in guard.pass_through(chunks, failures, policy).groupBy("response_id").agg(F.sum(F.length("delta"))).collect()}
    assert size("abort") == {"a": 20, "b": 30} and size("ignore") == {"a": 30, "b": 30}
    try:
        size("throw")
    except Exception as e:
        assert "degenerate output" in str(e)
    else:
        raise AssertionError("the policy throw did not fail")


def test_replay_groups_small_rows_without_sorting_them(spark):
    rows = spark.createDataFrame([("a", LOOP), ("b", PROSE)], "id string, text string")
    for early, options in ((False, PRESETS["chat"]), (True, PRESETS["chat"].but(expect_script=("cyrillic",)))):
        plan = guard.replay(rows, ["id"], "text", options, 100, guard.Schedule(early_document=early))._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
        assert not any("_text" in line for line in plan.split("\n") if "Aggregate" in line or "Exchange" in line)


def test_replay_names_the_codes_of_windows_and_heads_in_order(spark):
    rows = spark.createDataFrame([("a", "loop " * 160), ("b", " " * 700), ("c", "x")], "id string, text string")
    found = guard.replay(rows, ["id"], "text", PRESETS["chat"].but(expect_script=("cyrillic",)), 700, guard.Schedule(early_document=True))
    assert {r["id"]: (r["n_chars"], r["checks"], r["caught_at"], r["reasons"]) for r in found.collect()} == {
        "a": (800, 1, 700, ["REPETITION", "TAIL_LOOP", "SCRIPT_MISMATCH"]), "b": (700, 1, 700, ["EMPTY", "EMPTY"]), "c": (1, 0, None, None),
    }


def test_spans_are_measured_once_whatever_their_kind(spark):
    spans = spark.createDataFrame([("a", 3, "end", "Hm,", "length")], guard.SPAN)
    plan = guard.judge(spans, PRESETS["chat"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") <= 4 and plan.count("_lz_ratio_below(") <= 2


def test_a_response_that_comes_whole_asks_state_once(monkeypatch):
    asked = []
    for name in ("exists", "get", "clear", "update", "appendValue", "containsKey"):
        monkeypatch.setattr(State, name, lambda self, *a, was=getattr(State, name), name=name: (asked.append(name), was(self, *a))[1])
    assert Fed()((0, "A fine ", None, False, False), (1, "answer.", "stop", True, False)) == [(14, "end", "A fine answer.", "stop")]
    assert asked == ["exists"]


def test_a_policy_that_keeps_all_needs_no_failures(spark):
    chunks = guard.chunked(spark.createDataFrame([("a", "x" * 30)], "id string, text string"), "id", "text", 10)
    failures = spark.createDataFrame([("a", 20)], "response_id string, caught_at long")
    assert "Join" not in guard.pass_through(chunks, failures, "ignore")._jdf.queryExecution().executedPlan().toString()


def test_a_window_that_surely_passes_passes(spark):
    draw = random.Random(1)
    parts = ["a", "b", "A b", " ", "é", "'", "_", "-", "a a a ", "x y ", "\n", "ß", "İ", "Σ", "`", "日本", "²", "İ", "\u0130", "!", ". "]
    texts = ["".join(draw.choices(parts[: draw.choice((11, 16, len(parts)))], k=draw.randrange(1, 120))) for _ in range(400)] + [PROSE, LOOP, "_ '", "- ! ."]
    rows = []
    for t in texts:
        places, window = sorted(draw.randrange(1, len(t) + 1) for _ in range(3)), draw.choice((5, 20, 50, 2000))
        rows += [(t[max(0, p - window) : p], passes, o) for o in ("chat", "longForm", "lenient") for p, passes in zip(places, sure.surely_pass(t, places, window, guard.window_options(PRESETS[o])))]
    for o in ("chat", "longForm", "lenient"):
        some = spark.createDataFrame([(t, passes) for t, passes, x in rows if x == o], "text string, sure boolean")
        judged = check_output(some, "text", guard.window_options(PRESETS[o]))
        assert judged.where("sure").count() > 100 and judged.where("sure and not verdict.ok").count() == 0
    assert sure.surely_pass(PROSE, [len(PROSE)], 2000, PRESETS["chat"]) == [True] and sure.surely_pass(LOOP, [len(LOOP)], 2000, PRESETS["chat"]) == [False]


def test_replay_takes_the_length_of_a_text_once(spark):
    rows = spark.createDataFrame([("a", LOOP), ("b", PROSE)], "id string, text string")
    plan = guard.replay(rows, ["id"], "text", "chat", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" in plan and plan.count("length(_text") == 1 and "length(coalesce(text" not in plan


def test_only_windows_that_may_fail_are_handed_on():
    good, chunks = " ".join(f"w{i} x{i * 7}" for i in range(400)), lambda t: [(i, t[i * 100 : i * 100 + 100], None, (i + 1) * 100 >= len(t), False) for i in range(-(-len(t) // 100))]
    both = good[:1000] + " loop" * 200
    for text, at_once in ((good, True), (good, False), (both, True), (both, False)):
        found = []
        for passing, windows in ((None, True), (guard.window_options(PRESETS["chat"]), True), (None, False)):
            fed = Fed()
            fed.of = guard.Spans(guard.Schedule(), None, False, False, False, passing, windows)
            fed.of.init(fed.handle)
            found.append(fed(*chunks(text)) if at_once else [x for c in chunks(text) for x in fed(c)])
        every, doubtful, ends = found
        assert ends == every[-1:] and len(every) > 4 and [x for x in every if x in doubtful] == doubtful
        # the bounds are coarse where a window cuts a word, but what fails is kept
        assert doubtful == ends if text is good else every[-2] in doubtful and len(doubtful) < len(every)


def test_chunks_that_are_applied_together_are_one_row():
    of = guard.Spans(guard.Schedule(), None, False, True, False, guard.window_options(PRESETS["chat"]))
    of.init(Handle())
    give = lambda *chunks: [r for out in of.handleInputRows(("a",), iter([pd.DataFrame(chunks, columns=["seq", "delta", "finish_reason", "is_end", "tool_call"]).assign(event_ms=0)]), Now()) for r in out.itertuples(index=False)]
    first = give((1, "two ", None, False, False), (0, "one ", None, False, False), (3, "four", None, True, False))
    assert [(r.kind, r.seq, r.deltas, r.ends) for r in first] == [("chunks", 0, ["one ", "two "], [4, 8])]
    assert [(r.kind, r.seq, r.deltas, r.ends, r.span) for r in give((2, "three ", None, False, False))] == [("end", 3, None, None, "one two three four"), ("chunks", 2, ["three ", "four"], [14, 18], None)]


def test_short_responses_ask_little_of_state(monkeypatch):
    asked = []
    for name in ("exists", "get", "clear", "update", "appendValue", "containsKey"):
        monkeypatch.setattr(State, name, lambda self, *a, was=getattr(State, name), name=name: (asked.append(name), was(self, *a))[1])
    fed = Fed()
    assert fed((0, "A fine ", None, False, False)) == [] and asked == ["exists", "update"]
    assert fed((1, "answer.", "stop", True, False)) == [(14, "end", "A fine answer.", "stop")] and asked[2:] == ["exists", "get", "clear"] and fed.holds() == set()


@pytest.mark.parametrize("size", (700, 1999, 2001, 900))
def test_text_is_whole_whether_or_not_it_outgrows_a_window(size):
    text, fed = "".join(chr(97 + i % 23) for i in range(4 * size)), Fed()
    for i in range(4):
        found = fed((i, text[i * size : i * size + size], None, i == 3, False))
    assert found[-1] == (4 * size, "end", text, None) and fed.holds() == set()


def test_chunks_are_cut_in_one_pass_over_a_text(spark):
    texts = ["", None, "a", "x" * 10, "é\n日\U0001f600" * 7, "ab\r\n\u2028" * 5]
    chunks = guard.chunked(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", 10)
    found = {}
    for r in chunks.orderBy("response_id", "seq").collect():
        found.setdefault(int(r["response_id"]), []).append((r["seq"], r["delta"], r["is_end"]))
    cut = lambda t: [t[i : i + 10] for i in range(0, len(t), 10)] or [""]
    assert found == {i: [(k, d, k == len(cut(t or "")) - 1) for k, d in enumerate(cut(t or ""))] for i, t in enumerate(texts)}
    assert "substring" not in chunks._jdf.queryExecution().optimizedPlan().toString()


class Buckets(Handle):
    """State for one bucket; counts the messages."""

    def __init__(self):
        super().__init__()
        self.asked = []

    def _state(self, name):
        return self.states.setdefault(name, Entries(self, name))

    getValueState = getListState = lambda self, name, schema, **ttl: self._state(name)


class Entries(State):
    """State as Spark hands it out: nothing is there for an unknown key."""

    def __init__(self, handle, name):
        super().__init__(handle)
        for method in ("exists", "get", "update", "clear", "containsKey", "getValue", "updateValue", "removeKey", "keys", "iterator"):
            setattr(self, method, lambda *a, of=getattr(self, method), method=method: (handle.asked.append((name, method)), of(*a))[1])

    def get(self):
        return self.value

    def getValue(self, key):
        return self.map.get(key)

    def removeKey(self, key):
        self.map.pop(key, None)

    def keys(self):
        return iter(list(self.map))

    def iterator(self):
        return iter(list(self.map.items()))


class Bucket:
    """The first stage as streams run it, on packed rows of one bucket."""

    def __init__(self, silence_ms=None, event_time=False, remembered_ms=0, passing=guard.window_options(PRESETS["chat"])):
        self.handle, self.of, self.watermark = Buckets(), guard.SpansOfRows(guard.Schedule(), silence_ms, event_time, True, True, passing, True, remembered_ms), 0
        self.of.init(self.handle)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getCurrentProcessingTimeInMs(self):
        return self.at

    def getExpiryTimeInMs(self):
        return self.at

    def __call__(self, *chunks, at=1):
        self.at = at
        columns = dict(zip(("response_id", "seq", "delta", "finish_reason", "is_end", "tool_call"), zip(*((c[0], c[1], c[2], None, c[3], False) for c in chunks)))) | {"event_ms": [at] * len(chunks)}
        schema = pa.schema([("response_id", pa.string()), ("seq", pa.int64()), ("delta", pa.string()), ("finish_reason", pa.string()), ("is_end", pa.bool_()), ("tool_call", pa.bool_()), ("event_ms", pa.int64())])
        rows = guard.pack(pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()}, schema)).to_pylist()
        return [(r.response_id, r.seq, r.kind, r.lane) for r in self.of.handleInputRows((7,), iter([Row(**r) for r in rows]), self)]

    def silent(self, at):
        self.at = at
        self.handle.timers.discard(at)
        return [(r.response_id, r.kind, r.span) for r in self.of.handleExpiredTimer((7,), self, self)]

    def holds(self):
        return {name for name, s in self.handle.states.items() if s.value is not None or s.map}


def test_packed_chunks_are_the_chunks():
    rows = [("a", 0, "x\x1e", None, False, False), ("b", 3, None, "stop", True, False), ("a", 1, "", None, None, True), (None, 0, "\U0001f600é", None, False, None), ("b", 2, "zz", "", False, False)]
    schema = pa.schema([("response_id", pa.string()), ("seq", pa.int64()), ("delta", pa.string()), ("finish_reason", pa.string()), ("is_end", pa.bool_()), ("tool_call", pa.bool_())])
    packed = guard.pack(pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema)).to_pylist()
    found = [(r["response_id"], *c[:5]) for r in packed for c in guard.unpacked(*(r[n] for n in ("seqs", "lengths", "text", "named", "times")))]
    assert len(packed) == 3 and found == [(r[0], r[1], r[2] or "", r[3], bool(r[4]), bool(r[5])) for r in (rows[0], rows[2], rows[1], rows[4], rows[3])]
    with pytest.raises(ValueError, match="no seq"):
        guard.pack(pa.RecordBatch.from_pydict(dict(zip(schema.names, [["a"], [None], ["x"], [None], [True], [False]])), schema))


def test_texts_with_marks_come_apart_again(spark):
    deltas = [["a", ""], [""], ["\x1e", "\x1f\x1fm", "\x1fe", "x"], ["é", "日本"]]
    rows = spark.createDataFrame([(guard.one_text(d), ",".join(str(i) for i in range(len(d)))) for d in deltas], "d string, e string")
    assert [[(x["deltas"], x["ends"]) for x in r[0]] for r in rows.select(guard.each_of("d", "e")).collect()] == [[(x, i) for i, x in enumerate(d)] for d in deltas]


def test_a_bucket_is_read_and_cleared_at_once():
    fed, names = Bucket(), [f"r{i}" for i in range(50)]
    assert {r[2:] for r in fed(*((n, 0, f"A fine start, {n}.", False) for n in names))} == {("chunks", 7)}
    first = len(fed.handle.asked)
    found = fed(*((n, 1, " And a fine end.", True) for n in names))
    # a message for each response that is kept, none for those that are read or go
    assert first < 55 and len(fed.handle.asked) - first < 6 and fed.holds() == set()
    assert found == [(n, 1, kind, 7) for n in names for kind in ("end", "chunks")]


def test_few_responses_of_a_bucket_are_read_one_by_one():
    fed = Bucket()
    fed(*((f"r{i}", 0, "A fine start.", False) for i in range(50)))
    before = len(fed.handle.asked)
    assert fed(("r7", 1, "", True)) == [("r7", 1, "end", 7), ("r7", 1, "chunks", 7)]
    assert ("counters", "iterator") not in fed.handle.asked[before:] and len(fed.handle.states["counters"].map) == 49 and fed.handle.states["held"].value == (49, 0)


def test_only_responses_that_may_fail_have_a_lane_of_their_own():
    fed = Bucket()
    found = fed(("a", 0, LOOP, False), ("b", 0, PROSE[:300], False))
    assert [(r[0], r[2], r[3]) for r in found] == [("a", "window", None), ("a", "chunks", None), ("b", "chunks", 7)]
    # and keep it
    assert {r[:1] + r[3:] for r in fed(("a", 1, " fine", False), ("b", 1, " fine", False))} == {("a", None), ("b", 7)}


def test_long_texts_of_a_bucket_are_whole():
    fed, text = Bucket(), {"a": "".join(chr(97 + i % 23) for i in range(9000)), "b": PROSE * 9}
    for i in range(0, 6000, 1500):
        fed(*((n, i // 1500, t[i : i + 1500], False) for n, t in text.items()))
    found = list(fed.of.handleInputRows((7,), iter([Row(**r) for r in guard.pack(pa.RecordBatch.from_pydict(
        {"response_id": ["b", "a"], "seq": [4, 4], "delta": [text["b"][6000:], text["a"][6000:]], "finish_reason": pa.nulls(2, pa.string()), "is_end": [True, True], "tool_call": [False, False]})).to_pylist()]), fed))
    assert {r.response_id: r.span for r in found if r.kind == "end"} == text and fed.holds() == set()


def test_replays_count_once_without_a_state_for_each_chunk(spark):
    fed = Bucket(50, True, 500)
    fed(("a", 0, "x", False), ("a", 2, "late", False), ("a", 1, "y", True), at=10)
    # what was applied, what waited at the end and what was told as late are known
    assert fed(("a", 0, "x", False), ("a", 1, "y", True), ("a", 2, "late", False), at=20) == []
    assert fed(("a", 3, "z", False), ("a", 3, "z", False), at=20) == [("a", 3, "late", 7)] and fed(("a", 3, "z", False), at=20) == []
    # for as long as chunks may be replayed, even if silence is shorter
    assert fed.silent(60) == [] and fed.handle.timers == {510} and fed(("a", 0, "x", False), ("a", 3, "z", False), at=70) == [] and fed.holds() == {"finished", "held", "due"}
    assert fed.silent(510) == [] and fed.holds() == set()
    # silence ends a response, which is known as well
    fed(("b", 0, "half", False), at=600)
    assert fed.silent(650) == [("b", "end", "half")] and fed(("b", 0, "half", False), at=660) == [] and fed.handle.timers == {1100}
    assert fed.silent(1100) == [] and fed.holds() == set()
    fed.watermark = 2000
    assert fed(("c", 0, "too late", True), at=1999) == []
    chunks = spark.readStream.format("rate").load().selectExpr("'a' as response_id", "value as seq", "'x' as delta", "cast(null as string) as finish_reason", "false as is_end", "timestamp as sent")
    plan = guard.guard_stream(chunks, "chat", silence_ms=1000, event_time="sent")._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" not in plan and "MapInArrow" in plan
    assert "Deduplicate" in guard.spans_to_judge(chunks, event_time="sent")._jdf.queryExecution().analyzed().toString()


def test_responses_of_a_bucket_share_a_timer():
    fed = Bucket(50)
    fed(("a", 0, "one", False), ("b", 0, "two", False), at=100)
    fed(("b", 1, " and", False), at=120)
    assert fed.handle.timers == {150, 170}
    assert fed.silent(150) == [("a", "end", "one")] and fed.silent(170) == [("b", "end", "two and")] and fed.holds() == set()


def test_signs_of_a_cut_are_sought_only_where_a_reason_says_so(spark):
    rows = spark.createDataFrame([("a", 3, "end", "An unfinished", None), ("b", 3, "end", "An unfinished", ""), ("c", 3, "end", "An unfinished", "length"), ("d", 3, "end", "An unfinished", "stop")], guard.SPAN)
    judged = guard.judge(rows, "chat")
    assert {r["response_id"]: r["verdict"]["scores"].get("TRUNCATED") for r in judged.collect()} == {"a": None, "b": None, "c": 1.0, "d": 0.55}
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "_is_json(CASE WHEN RLIKE(trim(CASE WHEN NOT (finish_reason" in plan
