"""Verdicts, presets, tool calls and JSON contracts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import json as j
from gristmill.functions.json import is_json, json_result
from gristmill.operators import detectors as d
from gristmill.operators import plain
from gristmill.operators import verdicts as v
from gristmill.operators.check import PRESETS, CheckOptions, assert_output, check_output, flat_scores, measures
from tests.test_detectors import LOOP, PROSE


def verdicts(spark, texts, options):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    return [r["verdict"] for r in sorted(check_output(rows, "text", options).collect(), key=lambda r: r["i"])]


def codes(verdict):
    return [r["code"] for r in verdict["reasons"]]


# Degenerate texts with the code that must fire, and healthy texts under which none may.
BAD = [
    ("", "EMPTY"), ("   \n", "EMPTY"), ("```json\n```", "EMPTY"), ("{}", "EMPTY"), ("Nope", "TOO_SHORT"), (LOOP, "REPETITION"), (LOOP, "TAIL_LOOP"),
    (PROSE + " " + "and so on it went " * 60, "TAIL_LOOP"), ("=" * 20 + "a" * 900, "LOW_ENTROPY"), ("我在这里等你回来。" * 30, "TAIL_LOOP"), ("ありがとうございます" * 40, "TAIL_LOOP"),
]
GOOD = [
    PROSE, "| city | people |\n|---|---|\n| Oslo | 700k |\n| Bergen | 290k |\n| Trondheim | 210k |", '[{"id": 1, "name": "Ann"}, {"id": 2, "name": "Bo"}, {"id": 3, "name": "Cy"}]',
    "```python\nfor i in range(3):\n    print(i)\n```\nThis prints three numbers.", "用户要求写一段关于离别的短诗，下面是我的尝试。站台的灯一盏一盏亮起来，行李比来时更重。",
]


def test_degenerate_texts_fire_and_healthy_ones_do_not(spark):
    for (text, code), verdict in zip(BAD, verdicts(spark, [b[0] for b in BAD], "chat"), strict=True):
        assert not verdict["ok"] and code in codes(verdict), (text[:40], codes(verdict))
    for text, verdict in zip(GOOD, verdicts(spark, GOOD, "chat"), strict=True):
        assert verdict["ok"], (text[:40], verdict)


def test_empty_and_null_short_circuit(spark):
    blank, null = verdicts(spark, [" ", None], "chat")
    for verdict in (blank, null):
        assert codes(verdict) == ["EMPTY"] and verdict["scores"] == {"EMPTY": 1.0} and verdict["modes"] is None
    assert "null" in null["reasons"][0]["message"]


def test_absent_is_not_zero_and_thresholds_are_strict(spark):
    (verdict,) = verdicts(spark, [PROSE], PRESETS["chat"].but(max_repetition=None, max_char_tail_loop=None, max_tail_loop=None, max_compressibility=None))
    assert set(verdict["scores"]) == {"EMPTY", "TOO_SHORT"}
    (verdict,) = verdicts(spark, ["我在这里等你回来。" * 30], PRESETS["chat"].but(max_char_tail_loop=None))
    assert "TAIL_LOOP" not in verdict["scores"]
    (verdict,) = verdicts(spark, ["abc"], CheckOptions(min_length=4, max_compressibility=None))
    assert codes(verdict) == ["TOO_SHORT"] and verdict["scores"]["TOO_SHORT"] == 0.25


def test_finish_reason_switches_truncation_on(spark):
    rows = spark.createDataFrame([(0, PROSE, "length"), (1, PROSE, None), (2, PROSE, "stop")], "i int, text string, stop string")
    found = {r["i"]: r["verdict"] for r in check_output(rows, "text", PRESETS["chat"].but(finish_reason=F.col("stop"))).collect()}
    assert codes(found[0]) == ["TRUNCATED"] and "TRUNCATED" not in found[1]["scores"] and found[2]["scores"]["TRUNCATED"] == 0


def test_json_contract(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1, "b": 2}\n```', "[1]", '{"a": 1} x', '{"a": NaN}', '{"a": 1, "a": 2, "b": 0}']
    o = CheckOptions(expect_json=True, required_keys=("a", "b"), max_compressibility=None)
    found = verdicts(spark, texts, o)
    assert [x["scores"]["INVALID_JSON"] for x in found] == [1, 0, 1, 1, 1, 0]
    assert "required keys: b" in found[0]["reasons"][0]["message"] and found[5]["json"] == '{"a": 2, "b": 0}'

    def schema(value):
        if not isinstance(value.get("a"), int):
            raise ValueError([{"path": ["a", 0], "message": "expected int"}])
        return value | {"seen": True}

    good, bad = verdicts(spark, ['{"a": 1}', '{"a": "x"}'], CheckOptions(expect_json=True, schema=schema))
    assert '"seen": true' in good["json"] and "a.0: expected int" in bad["reasons"][0]["message"]

    async def later(value):
        return value

    with pytest.raises(TypeError):
        j.json_result(F.lit("{}"), schema=later)


def test_json_values_scope_ignores_structure(spark):
    records = "[" + ", ".join('{"status": "ready", "kind": "order", "place": "Oslo"}' for _ in range(30)) + "]"
    one_loop = '[{"a": "fine text here"}, {"a": "' + "again and again " * 40 + '"}]'
    whole = verdicts(spark, [records], PRESETS["chat"].but(max_compressibility=None))[0]
    scoped = verdicts(spark, [records, one_loop, "[1, 2, 3]", "not json " * 30], PRESETS["chat"].but(redundancy_scope="jsonValues", max_compressibility=None))
    assert not whole["ok"] and scoped[0]["ok"]
    assert codes(scoped[1]) == ["REPETITION", "TAIL_LOOP"] and scoped[2]["scores"]["REPETITION"] == 0 and not scoped[3]["ok"]


def test_assert_output(spark):
    rows = spark.createDataFrame([(PROSE,)], "text string")
    assert assert_output(rows, "text", "chat").count() == 1
    with pytest.raises(Exception, match="degenerate output: EMPTY"):
        assert_output(spark.createDataFrame([("",)], "text string"), "text", "chat").collect()


def test_flat_scores_and_clashing_names(spark):
    rows = spark.createDataFrame([(PROSE, "x", 1)], "text string, words string, ok int").withColumnRenamed("ok", "n")
    found = flat_scores(check_output(rows, "text", "chat")).first()
    assert found["ok"] and found["score_repetition"] == 0 and found["score_invalid_json"] is None and found["words"] == "x"


def test_tool_calls(spark):
    rows = spark.createDataFrame(
        [(0, "", ['{"q": "' + "again and again " * 40 + '"}', '{"q": "fine words about boats"}']), (1, LOOP, ['{"n": 7}']), (2, " ", ["{}"]), (3, "ok", ['{"q": "plain"}'])],
        "id int, text string, calls array<string>",
    )
    preamble = v.check_preamble(rows, "text", "chat")
    arguments = v.check_arguments(preamble, "calls", "chat")
    assert {r["id"] for r in arguments.where("arguments_verdict is not null").collect()} == {0, 3}
    merged = arguments.select("id", v.merge_verdicts(F.col("preamble"), F.col("arguments_verdict")).alias("m"))
    found = {r["id"]: r["m"] for r in merged.collect()}
    assert not found[0]["ok"] and found[0]["reasons"][0]["message"].startswith("In a tool call argument: ")
    assert not found[1]["ok"] and found[2] is None and found[3]["ok"] and "TOO_SHORT" not in found[3]["scores"]


def test_the_worst_of_several_arguments_and_none(spark):
    loop, worse = '{"q": "' + "again and again " * 40 + '"}', '{"q": "' + "x " * 300 + '"}'
    rows = spark.createDataFrame([(0, ["not json at all", loop, worse, worse]), (1, [None, "{}"]), (2, []), (3, None), (4, ["", '["fine words", ""]'])], "id int, calls array<string>")
    found = {r["id"]: r["w"] for r in v.check_arguments(rows, "calls", "chat", "w").collect()}
    assert found[1] is None and found[2] is None and found[3] is None and found[4]["ok"] and set(found[4]["scores"]) == {"EMPTY", "REPETITION", "TAIL_LOOP"}
    assert not found[0]["ok"] and 0.9 < found[0]["scores"]["REPETITION"] < 0.99  # all three end in a loop of score 1, and the first of them counts


def test_contracts_of_spark_types_find_what_a_function_finds(spark):
    contract = T.StructType.fromDDL("id long not null, note string, `a'b.c` boolean, when date, items array<struct<n: int not null, x: double>>, tags map<string, string> not null")

    def judged(v, kind, nullable, path):
        said = lambda m: [f"{path}: {m}" if path else m]
        if v is None:
            return [] if nullable else said("must not be null")
        whole = isinstance(v, int | float) and not isinstance(v, bool) and v == int(v)
        if isinstance(kind, T.StructType):
            if not isinstance(v, dict):
                return said("expected an object")
            return [i for f in kind.fields for i in ((judged(v[f.name], f.dataType, f.nullable, f"{path}.{f.name}".lstrip(".")) if f.name in v else [] if f.nullable else [f"{path}.{f.name}: required".lstrip(".")]))]
        if isinstance(kind, T.ArrayType):
            return [i for n, x in enumerate(v) for i in judged(x, kind.elementType, True, f"{path}.{n}")] if isinstance(v, list) else said("expected an array")
        if isinstance(kind, T.MapType):
            return [i for k in sorted(v) for i in judged(v[k], kind.valueType, True, f"{path}.{k}")] if isinstance(v, dict) else said("expected an object")
        fits = {
            T.LongType: (whole and abs(v) < 2**63 if whole else False, "an integer"), T.IntegerType: (whole and abs(v) < 2**31 if whole else False, "an integer"),
            T.DoubleType: (isinstance(v, int | float) and not isinstance(v, bool), "a number"), T.StringType: (isinstance(v, str), "a string"),
            T.BooleanType: (isinstance(v, bool), "a boolean"), T.DateType: (isinstance(v, str) and bool(re.fullmatch(r"\d{4}-\d\d-\d\d", v)), "a date"),
        }[type(kind)]
        return [] if fits[0] else said(f"expected {fits[1]}")

    r = random.Random(4)
    odd = [None, 1, -2.5, 1.0, 3_000_000_000, True, "x", "2024-02-03", [], {}, [1], {"n": 1}, [{"n": 2, "x": 0.5}, {"n": "y"}, {"x": 1}], {"k": "v", "l": 3}]
    values = [{k: r.choice(odd) for k in ("id", "note", "a'b.c", "when", "items", "tags", "more") if r.random() < 0.9} for _ in range(10_000)] + odd
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    df = rows.select("i", json_result(F.col("t"), schema=contract).alias("r"))
    found = {x["i"]: x["r"] for x in df.collect()}
    for i, v in enumerate(values):
        assert (found[i]["issues"] or []) == judged(v, contract, False, ""), json.dumps(v)
        assert found[i]["score"] == (1.0 if found[i]["issues"] else 0.0)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_contracts_of_broken_payloads(spark):
    texts = ['{"a": 1} x', "1 2", "1],[2", '1,"x"', "", None, "nul", '{"a": 1, "a": 2}', '```json\n{"a": 1}\n```', '{"b": 1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r["r"] for r in rows.select("i", json_result(F.col("t"), required_keys=["a"], schema=T.StructType.fromDDL("a int")).alias("r")).orderBy("i").collect()]
    assert [r["reason"] for r in found] == ["unparseable"] * 8 + [None, "missing-keys"] and found[9]["missing_keys"] == ["a"] and found[8]["value"] == '{"a":1}'
    assert [r["v"] for r in rows.select("i", is_json(F.col("t")).alias("v")).orderBy("i").collect()] == [False, False, False, False, False, None, False, True, False, True]


def test_strict_json_functions(spark):
    texts = ['{"a":[{"b":"x"},"y"],"c":"z"}', "[1,]", "01", '"s"', "NaN", "[1] x", "", None, "[" * 5000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", j.is_json(F.col("t")).alias("ok"), j.string_leaves(F.col("t")).alias("leaves"))
    found = sorted(rows.collect(), key=lambda r: r["i"])
    assert [r["ok"] for r in found] == [True, False, False, True, False, False, False, None, False]
    assert found[0]["leaves"] == ["x", "y", "z"] and found[3]["leaves"] == ["s"] and found[1]["leaves"] is None


def test_assert_output_believes_a_verdict_that_is_there(spark):
    rows = check_output(spark.createDataFrame([("A calm answer about boats and rain.",), ("go " * 90,)], "text string"), "text", "chat")
    good = assert_output(rows.where("verdict.ok"), "text", "chat", "verdict")
    assert [r["text"] for r in good.collect()] == ["A calm answer about boats and rain."] and good.columns == ["text", "verdict"]
    assert good._jdf.queryExecution().executedPlan().toString().count("_lz_ratio_below(") <= 2
    with pytest.raises(Exception, match="degenerate output: "):
        assert_output(rows, "text", "chat", "verdict").collect()


def test_plain_texts_are_counted_as_the_detectors_would(spark, monkeypatch):
    draw = random.Random(5)
    parts = ["a", "b ", "the and of ", "Der Die ", " ", "é", "'", "-", "x y ", "\n", "ß", "Σ", "`", "日本", "²", "İ", "µ", "Жы ", "https://e.org ", "word ", "ʼ", "ǅ", "٣"]
    texts = [None, "", "ab", PROSE, "loop " * 50, "x y z " * 2000, PROSE * 12] + ["".join(draw.choices(parts[: draw.choice((6, 12, len(parts)))], k=draw.randrange(1, 150))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, ("en", "de", "xx", None)[i % 4]) for i, t in enumerate(texts)], "id int, text string, lang string")
    options = PRESETS["chat"].but(expect_lang=F.col("lang"), expect_script=("latin", "klingon"), max_repetition=0.1)
    told = {r["id"]: r["verdict"] for r in check_output(rows, "text", options).collect()}
    monkeypatch.setattr(plain, "counts", lambda text, *more: (None,) * 6)
    assert told == {r["id"]: r["verdict"] for r in check_output(rows, "text", options).collect()}
    # every text of plain letters is told, with or without a loop
    monkeypatch.undo()
    assert plain.counts("loop " * 50, 3, False, ("latin",)) == (1 - 1 / 48, False, 50, None, 200, 200) and plain.counts("日本", 3, False, ()) == (None,) * 6


def test_words_of_plain_texts_are_not_taken_apart_again(spark):
    rows = spark.createDataFrame([(PROSE,)], "text string")
    staged, _ = measures(rows, F.col("text"), PRESETS["chat"])
    assert [r["_m_words"] for r in staged.collect()] == [None]


def test_the_entropy_of_plain_texts_is_told_with_their_counts(spark):
    # one pass in Python over each text: a second UDF for the ratio got the texts again
    r = random.Random(9)
    texts = ["".join(r.choice("ab cdé.") for _ in range(n)) for n in (0, 63, 64, 900, 5000)] + ["loop " * 300, "   " + "x" * 63 + "   ", "日本" * 90, "a\U0001f600" * 60, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    checked = check_output(rows, "text", "chat")
    plan = checked.select("i", "verdict")._jdf.queryExecution().executedPlan().toString()
    assert "_lz_ratio_below(" not in plan and plan.count("ArrowEvalPython [") == 1
    found = {x["i"]: x["s"] for x in checked.select("i", F.col("verdict.scores")["LOW_ENTROPY"].alias("s")).collect()}
    alone = {x["i"]: x["s"] for x in rows.select("i", d.compressibility_score(F.col("text")).alias("s")).collect()}
    assert all(found[i] == alone[i] for i, x in enumerate(texts) if x)


def test_lowered_texts_are_those_of_the_detectors():
    every = "".join(sorted(plain.KNOWN))
    assert plain.lowered(every) == plain.spaced(every, set(every))
    assert all((plain.lowered(c) is None) == (c not in plain.KNOWN) for c in map(chr, [*range(0xD800), 0x1F600]))
