"""Scans, envelopes, calibration, streaming, sinks and the command line."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from gristmill import cli
from gristmill.operators import calibrate as c
from gristmill.operators.check import PRESETS, check_output
from gristmill.sources import envelopes as e
from gristmill.sources import scans, sinks
from gristmill.streaming import guard
from tests.test_detectors import LOOP, PROSE

O = PRESETS["chat"].but(max_compressibility=None)  # noqa: E741


def test_extract_text_and_scores(spark):
    lines = [
        '"plain"', '{"text": "", "output": "o"}', '{"choices": [{"message": {"content": "a"}}, {"message": {"content": "b"}}]}', '{"content": [{"type": "text", "text": "t"}, {"type": "x", "text": "no"}]}',
        '{"level": 1, "payload": {"deep": [{"answer": "n"}]}}', '{"choices": 5, "content": {}}', "null", "42", "not-json", '{"choices": [{"message": {"content": null}}]}', '["a", "b"]',
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    assert [r[0] for r in rows.orderBy("i").select(scans.extract_text(F.col("line"))).collect()] == ["plain", "o", "ab", "t", "n", None, None, None, None, None, None]
    logs = ['{"REPETITION": 0.03, "TAIL_LOOP": 0}', '{"verdict": {"scores": {"TAIL_LOOP": 0.2}, "modes": {"TAIL_LOOP": "char", "EMPTY": "odd"}}}', '{"scores": {"TAIL_LOOP": 1}, "modes": {"TAIL_LOOP": "word"}}', '{"REPETITION": true, "x": 1}', "[]"]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, line string").orderBy("i").select(scans.extract_scores(F.col("line")).alias("f")).collect()
    assert [(r["f"]["scores"], r["f"]["modes"]) for r in found] == [({"REPETITION": 0.03, "TAIL_LOOP": 0.0}, None), ({"TAIL_LOOP": 0.2}, {"TAIL_LOOP": "char"}), ({"TAIL_LOOP": 1.0}, {"TAIL_LOOP": "word"}), (None, None), (None, None)]


def test_line_numbers_count_blank_lines_across_splits(spark, tmp_path):
    lines = [json.dumps({"text": f"answer {i}"}) if i % 3 else "" for i in range(1, 200)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = {r["label"].rsplit(":", 1)[1]: r["text"] for r in scans.read_responses(spark, str(tmp_path / "log.jsonl")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {str(i): f"answer {i}" for i in range(1, 200) if i % 3}
    assert scans.read_texts(spark, str(tmp_path)).first()["text"] == "\n".join(lines)


def test_fixture_loader(spark, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / "b.json").write_text(json.dumps({"id": "b", "note": "", "text": "x", "options": {"expectScript": ["han", "kana"]}, "expect": ["EMPTY"]}))
    (folder / "a.json").write_text(json.dumps({"id": "a", "note": "", "text": "y", "options": {"expectScript": "latin", "minLength": 3}}))
    rows = scans.read_fixtures(spark, str(folder)).collect()
    assert [(r["id"], r["label"], r["options"]["expectScript"]) for r in rows] == [("a", "bad", ["latin"]), ("b", "bad", ["han", "kana"])]


def envelope(spark, surface, response, request=None):
    rows = spark.createDataFrame([(json.dumps(response), json.dumps(request))], "response string, request string")
    return e.read_envelopes(rows, surface, request="request").first().asDict()


def test_chat_envelope(spark):
    message = {"content": "[1] hi", "tool_calls": [{"function": {"arguments": '{"a":1}'}}], "function_call": {"arguments": {"b": 2}}}
    request = {"messages": [{"role": "system", "content": "S"}, {"role": "assistant", "content": "no"}, {"content": [{"type": "text", "text": "U"}, "V", {"type": "image"}]}, {"role": "tool", "content": "no"}]}
    found = envelope(spark, "openai_chat", {"choices": [{"message": message, "finish_reason": None}, {"message": {"content": None}, "finish_reason": "length"}]}, request)
    assert (found["text"], found["has_tool_calls"], found["finish_reason"], found["arguments"], found["prompt"]) == ("[1] hi", True, "length", ['{"a":1}', '{"b":2}'], "S\n\nU\nV")
    empty = envelope(spark, "openai_chat", {})
    assert (empty["text"], empty["has_tool_calls"], empty["finish_reason"], empty["arguments"], empty["prompt"]) == ("", False, None, [], None)


def test_other_envelopes(spark):
    output = [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "refusal", "text": "no"}]}, {"type": "function_call", "arguments": "{}"}]
    found = envelope(spark, "openai_responses", {"output": output, "output_text": "x", "incomplete_details": {"reason": "max_output_tokens"}}, {"instructions": " I ", "input": "Q"})
    assert (found["text"], found["has_tool_calls"], found["finish_reason"], found["arguments"], found["prompt"]) == ("a", True, "max_output_tokens", ["{}"], "I\n\nQ")
    assert envelope(spark, "openai_responses", {"output_text": "x"})["text"] == "x"
    content = [{"type": "thinking", "text": "no"}, {"type": "text", "text": "b"}, {"type": "tool_use", "input": {"q": "w"}}]
    found = envelope(spark, "anthropic", {"content": content, "stop_reason": "model_context_window_exceeded"}, {"system": [{"type": "text", "text": "S"}], "messages": [{"role": "user", "content": "U"}]})
    assert (found["text"], found["has_tool_calls"], found["finish_reason"], found["arguments"], found["prompt"]) == ("b", True, "max_tokens", ['{"q":"w"}'], "S\n\nU")
    parts = [{"type": "text", "text": "c"}, {"type": "tool-call", "args": {"z": 1}}, {"type": "tool-result", "input": "no"}]
    found = envelope(spark, "ai_sdk", {"content": parts, "finishReason": {"unified": "length"}})
    assert (found["text"], found["has_tool_calls"], found["finish_reason"], found["arguments"]) == ("c", True, "length", ['{"z":1}'])


def test_stream_events(spark):
    cases = {
        "openai_chat": [({"choices": [{"delta": {"content": "a"}}]}, "a", False, None), ({"choices": [{"delta": {"tool_calls": [{}]}, "finish_reason": "stop"}]}, "", True, "stop")],
        "openai_responses": [({"type": "response.output_text.delta", "delta": "b"}, "b", False, None), ({"type": "response.output_item.added", "item": {"type": "function_call"}}, "", True, None)],
        "anthropic": [({"type": "content_block_delta", "delta": {"type": "text_delta", "text": "c"}}, "c", False, None), ({"type": "message_delta", "delta": {"stop_reason": "end_turn"}}, "", False, "end_turn"), ({"type": "content_block_start", "content_block": {"type": "tool_use"}}, "", True, None)],
        "ai_sdk": [({"type": "text-delta", "delta": "d"}, "d", False, None), ({"type": "tool-input-start"}, "", True, None), ({"type": "finish", "finishReason": "length"}, "", False, "length")],
    }
    for surface, events in cases.items():
        rows = spark.createDataFrame([(i, json.dumps(x[0])) for i, x in enumerate(events)], "i int, event string")
        found = e.read_stream_events(rows, surface).orderBy("i").collect()
        assert [(r["delta"], r["tool_call"], r["finish_reason"]) for r in found] == [x[1:] for x in events]


def test_score_envelopes_routes_tool_turns(spark):
    loop = json.dumps({"q": "again and again " * 40})
    rows = spark.createDataFrame(
        [
            (0, json.dumps({"choices": [{"message": {"content": PROSE}, "finish_reason": "stop"}]}), "{}"),
            (1, json.dumps({"choices": [{"message": {"content": PROSE}, "finish_reason": "length"}]}), "{}"),
            (2, json.dumps({"choices": [{"message": {"content": None, "tool_calls": [{"function": {"arguments": loop}}]}}]}), "{}"),
            (3, json.dumps({"choices": [{"message": {"content": "", "tool_calls": [{"function": {"arguments": "{}"}}]}}]}), "{}"),
            (4, json.dumps({"choices": [{"message": {"content": PROSE}}]}), json.dumps({"messages": [{"role": "user", "content": PROSE}]})),
        ],
        "id int, response string, request string",
    )
    found = {r["id"]: r["verdict"] for r in e.score_envelopes(rows, ["id"], "openai_chat", O, request="request", check_tool_arguments=True, check_prompt_echo=True).collect()}
    reasons = lambda i: [r["code"] for r in found[i]["reasons"]]
    assert reasons(0) == [] and reasons(1) == ["TRUNCATED"] and "REPETITION" in reasons(2) and found[3] is None and reasons(4) == ["PROMPT_ECHO"]


def test_envelopes_of_one_key_keep_their_own_verdicts(spark):
    call = lambda text: json.dumps({"choices": [{"message": {"content": None, "tool_calls": [{"function": {"arguments": json.dumps({"q": text})}}]}}]})
    rows = spark.createDataFrame([("k", call("again and again " * 40)), ("k", call("plain words"))], "id string, response string")
    found = e.score_envelopes(rows, ["id"], "openai_chat", "chat", check_tool_arguments=True)
    assert sorted(r["verdict"]["ok"] for r in found.collect()) == [False, True]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_line_numbers_of_split_and_packed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(1, 5001)))
    (tmp_path / "b.txt").write_text("x\ny")
    (tmp_path / "none.txt").write_text("")
    with gzip.open(tmp_path / "c.txt.gz", "wt") as out:
        out.write("".join(f"line {i}\n" for i in range(1, 2001)))
    before = {n: spark.conf.get(f"spark.sql.files.{n}") for n in ("maxPartitionBytes", "openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        lines = scans.read_lines(spark, str(tmp_path))
        rows = lines.collect()
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in before.items():
            spark.conf.set(f"spark.sql.files.{n}", value)
    assert len(rows) == 7002 and all(r["line"] == f"line {r['line_no']}" if r["line"] else r["line_no"] % 7 == 0 for r in rows if "b.txt" not in r["path"])
    assert sorted((r["line_no"], r["line"]) for r in rows if "b.txt" in r["path"]) == [(1, "x"), (2, "y")]
    assert all("line#" not in part.split("+-")[0] for part in plan.split("Exchange hashpartitioning")[1:])


@pytest.mark.parametrize(("bins", "few"), [(1024, 1024), (4, 3), (2, 1)])
def test_percentiles_by_refined_bins(spark, bins, few):
    values = [("A", "word", x / 7) for x in range(200) for _ in range(1 + x % 3)] + [("A", None, x) for x in (5.0, 5.0, 1.0)] + [("B", None, 0.5**x) for x in range(60)] + [("C", None, 1e308), ("C", None, -1e308)]
    counted = spark.createDataFrame(values, "code string, mode string, score double").groupBy("code", "mode", "score").agg(F.count("*").alias("n"))
    at = [0.5, 0.9, 0.99, 0.999, 0.37]
    wanted = {(r["code"], r["mode"]): r["p"] for r in counted.groupBy("code", "mode").agg(F.percentile("score", at, F.col("n")).alias("p")).collect()}
    assert c.exact_percentiles(counted, at, bins, few) == wanted
    assert c.exact_percentiles(counted.where("false"), at) == {}


def test_counts_are_observed_while_lines_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", PROSE), ("b", "again and again " * 40), ("c", None)], "label string, text string")
    counts = sinks.write_verdicts(check_output(rows, "text", "chat"), str(tmp_path / "out"))
    assert counts.asDict() == {"checked": 2, "degenerate": 1, "unrecognised": 1, "exit_code": 1}
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    none = sinks.write_verdicts(check_output(rows.where("label = 'c'"), "text", "chat"), str(tmp_path / "none"))
    assert none["exit_code"] == 2


def summaries(spark, values, rate=0.001):
    rows = spark.createDataFrame([("REPETITION", None, float(x)) for x in values], "code string, mode string, score double")
    return c.calibrate_long(rows, rate).first()


def test_calibration(spark):
    healthy = [(i % 100) / 100 * 0.08 for i in range(2000)]
    found = summaries(spark, healthy + [0.85] * 8)
    assert found["gap"]["count"] == 8 and found["gap"]["above"] == 0.85 and found["suggested"] == pytest.approx(0.465, abs=1e-3) and found["option"] == "max_repetition"
    found = summaries(spark, healthy)
    assert found["gap"] is None and any("show no gap" in x for x in found["caveats"])
    assert any("that decides" in x for x in summaries(spark, [0.1, 0.2])["caveats"])
    assert any("every score is 0" in x for x in summaries(spark, [0.0] * 50)["caveats"])
    assert summaries(spark, [i / 100 for i in range(101)])["p90"] == pytest.approx(0.9)
    # the first of equally wide gaps
    assert summaries(spark, [0.0] * 20 + [0.25, 0.5])["gap"]["below"] == 0


def test_calibrate_segments_by_mode_and_skips_absent_scores(spark):
    rows = spark.createDataFrame(
        [({"TAIL_LOOP": 0.1, "EMPTY": 0.0}, {"TAIL_LOOP": "word"}), ({"TAIL_LOOP": 0.9}, {"TAIL_LOOP": "char"}), ({"TAIL_LOOP": 0.5}, None), ({"TAIL_LOOP": float("nan"), "OTHER": 1.0}, None)],
        "scores map<string, double>, modes map<string, string>",
    )
    found = {(r["code"], r["mode"]): r["n"] for r in c.calibrate(rows).collect()}
    assert found == {("TAIL_LOOP", "word"): 1, ("TAIL_LOOP", "char"): 1, ("TAIL_LOOP", None): 1, ("EMPTY", None): 1}


def push_loop(text, chunk):
    """The schedule of checks, one chunk after another."""
    at, n, since, checks = [], 0, 0, 0
    while n < len(text):
        step = len(text[n : n + chunk])
        n, since = n + step, since + step
        if (n >= 240) if not checks else (since >= 400):
            at.append(n)
            since, checks = 0, checks + 1
    return at


def test_check_positions_equal_the_push_loop(spark):
    cases = [(n, k) for n in (0, 1, 239, 240, 399, 640, 641, 1999, 5000, 8123) for k in (1, 10, 16, 50, 100, 400, 999)]
    for chunk in sorted({k for _, k in cases}):
        rows = spark.createDataFrame([(n,) for n, k in cases if k == chunk], "n int").select("n", guard.check_positions(F.col("n"), chunk).alias("p"))
        for r in rows.collect():
            assert r["p"] == push_loop("x" * r["n"], chunk), (r["n"], chunk)


def test_stream_equals_replay_whatever_the_order(spark, tmp_path):
    texts = [(1, LOOP), (2, " ".join(f"On day {i} the keeper saw {i * 7} boats, {i + 3} gulls and a bird named b{i}." for i in range(30))), (3, PROSE + " " + "and so on it went " * 60), (4, ""), (5, "short")]
    rows = spark.createDataFrame(texts, "id int, text string")
    replayed = {r["id"]: r["caught_at"] for r in guard.replay(rows, ["id"], "text", O, 16).collect()}
    assert replayed[1] == 240 and replayed[2] is None and replayed[3] is not None and replayed[4] is None
    chunks = guard.chunked(rows, "id", "text", 16)
    chunks.repartition(6, F.rand(3)).write.parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "chunks"))
    judged = guard.run_to_table(guard.spans_to_judge(stream), O, str(tmp_path / "out"))
    caught = {int(r["response_id"]): r["caught_at"] for r in guard.first_failures(judged.where("kind = 'window'")).collect()}
    assert caught == {k: x for k, x in replayed.items() if x is not None}
    ends = {int(r["response_id"]): [x["code"] for x in r["verdict"]["reasons"]] for r in judged.where("kind = 'end'").collect()}
    assert ends[2] == [] and ends[4] == ["EMPTY"] and ends[5] == ["TOO_SHORT"] and len(ends) == 5
    kept = guard.pass_through(chunks, guard.first_failures(judged)).where("response_id = '1'").agg(F.sum(F.length("delta"))).first()[0]
    assert kept == 240 and guard.pass_through(chunks, guard.first_failures(judged), "ignore").count() == chunks.count()


def test_early_document_checks(spark):
    foreign = "Это ответ на русском языке, и он длинный. Слова здесь разные, а смысл простой: порт, лодки, дождь, лампа. "
    rows = spark.createDataFrame([(1, foreign * 1 + "".join(f"{foreign}{i} " for i in range(30))), (2, "".join(f"{PROSE} {i} " for i in range(8)))], "id int, text string")
    o = O.but(expect_script=("latin",), max_repetition=None, max_tail_loop=None, max_char_tail_loop=None)
    found = {r["id"]: r for r in guard.replay(rows, ["id"], "text", o, 100, guard.Schedule(early_document=True)).collect()}
    assert found[1]["caught_at"] == 700 and found[1]["reasons"] == ["SCRIPT_MISMATCH"] and found[2]["caught_at"] is None
    assert all(r["caught_at"] is None for r in guard.replay(rows, ["id"], "text", o, 100).collect())
    places = spark.range(1).select(guard.document_positions(F.sequence(F.lit(300), F.lit(24_000), F.lit(400)).cast("array<bigint>")).alias("p")).first()["p"]
    assert places == [700, 1500, 3100, 6300, 12700]


def test_sinks(spark):
    rows = check_output(spark.createDataFrame([("a", PROSE), ("b", ""), ("c", None)], "label string, text string"), "text", O)
    lines = [json.loads(r["value"]) for r in sinks.verdict_lines(rows).collect()]
    assert lines[0]["label"] == "a" and lines[0]["ok"] and "json" not in lines[0] and lines[1]["reasons"][0]["code"] == "EMPTY"
    counts = sinks.footer(rows).first()
    assert (counts["checked"], counts["degenerate"], counts["unrecognised"]) == (2, 1, 1) and sinks.exit_code(counts) == 1


def test_command_line(spark, tmp_path, capsys):
    good, bad, log = tmp_path / "good.txt", tmp_path / "bad.txt", tmp_path / "log.jsonl"
    good.write_text(PROSE)
    bad.write_text("")
    log.write_text("\n".join(json.dumps({"text": PROSE + f" {i}"}) for i in range(60)) + "\nnot json\n")
    assert cli.main(["check", str(good)], spark) == 0
    assert cli.main(["check", str(good), str(bad)], spark) == 1 and "1 degenerate" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "none.txt")], spark) == 2
    assert cli.main(["check", "--preset", "odd", str(good)], spark) == 2
    assert cli.main([], spark) == 1 and cli.main(["--help"], spark) == 0
    capsys.readouterr()
    assert cli.main(["check", "--jsonl", "--json", str(log)], spark) == 0
    scored = tmp_path / "scores.jsonl"
    scored.write_text(capsys.readouterr().out)
    assert cli.main(["calibrate", "--fpr", "0.01", str(scored)], spark) == 0 and "60 verdicts" in capsys.readouterr().out
    assert cli.main(["--json", str(scored)], spark) == 0 and json.loads(capsys.readouterr().out)["n"] == 60
    assert cli.main(["calibrate", "--fpr", "2", str(scored)], spark) == 1 and cli.main(["calibrate", str(good)], spark) == 1
