"""The registered queries of the text-quality engine, over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json as j
from ..functions import sql as names
from ..functions import text as t
from ..functions import variant as var
from ..operators import calibrate as c
from ..operators import check as k
from ..operators import detectors as d
from ..operators import verdicts as v
from ..sources import envelopes as e
from ..sources import logs as growing
from ..sources import scans, sinks
from ..streaming import guard

#: The presets without LOW_ENTROPY, the one detector that runs in Python.
NO_ENTROPY = {name: o.but(max_compressibility=None) for name, o in k.PRESETS.items()}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out, since a file may be a single row group."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _of_documents(**columns):
    """A query that evaluates columns over all documents."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).select("doc_id", *[make().alias(name) for name, make in columns.items()])

    return query


def r6(x: Column) -> Column:
    return F.round(x, 6)


def _text() -> Column:
    return F.col("text")


def finish_reason() -> Column:
    """A stop reason made up from the id, for tables that hold none."""
    return F.element_at(F.array(*[F.lit(x) for x in ("stop", "length", "MAX_TOKENS", "content_filter", "token_limit")]), (F.col("doc_id") % 5 + 1).cast("int"))


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", d.language_profile(_text()).alias("p"))
    return rows.select("doc_id", *[r6(F.col("p")[name]).alias(f"share_{name}") for name in d.SUPPORTED_LANGUAGES])


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", d.script_profile(_text()).alias("p"))
    return rows.select("doc_id", *[r6(F.col("p")[name]).alias(f"share_{name}") for name in ("latin", "han", "cyrillic", "greek", "other")])


def _tail(mode: str | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _documents(spark, sf_dir).select("doc_id", d.tail_loop_detail(_text(), mode=mode).alias("s"))
        return rows.select("doc_id", r6(F.col("s.score")).alias("score"), F.col("s.mode").alias("mode"))

    return query


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, some of them broken or fenced, by id."""
    props, n = F.col("props"), F.col("event_id") % 6
    fenced = F.concat(F.lit("```json\n"), props, F.lit("\n```"))
    broken = F.when(n == 1, F.concat(props, F.lit(" x"))).when(n == 2, F.substring(props, F.lit(1), F.length(props) - 1)).when(n == 3, F.replace(props, F.lit('"'), F.lit("'"))).when(n == 4, fenced).otherwise(props)
    return read(spark, sf_dir, "events").select("event_id", "event_type", broken.alias("payload"))


def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _props(spark, sf_dir).select("event_id", j.is_json(F.col("payload")).alias("valid"), j.strip_fence(F.col("payload")).alias("candidate"))


def json_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _props(spark, sf_dir).select("event_id", j.json_result(F.col("payload"), required_keys=["k", "absent"]).alias("r"))
    return rows.select("event_id", F.col("r.score").alias("score"), F.col("r.reason").alias("reason"), F.array_join("r.missing_keys", ",").alias("missing"))


def json_string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    nested = F.to_json(F.struct(F.col("role").alias("a"), F.struct(F.col("text").alias("b"), F.array(F.struct(F.col("role").alias("c")), F.struct(F.col("text").alias("c"))).alias("d")).alias("e"), F.col("turn").alias("n")))
    leaves = j.string_leaves(nested)
    return turns.select("conv_id", "turn", leaves.alias("x")).select("conv_id", "turn", F.size("x").cast("long").alias("n_leaves"), F.array_join("x", "|").alias("leaves"))


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def even(value):
        if not isinstance(value, dict) or not isinstance(value.get("k"), int):
            raise ValueError([{"path": ["k"], "message": "expected an integer"}])
        return value | {"even": value["k"] % 2 == 0}

    rows = _props(spark, sf_dir).select("event_id", j.json_result(F.col("payload"), schema=even).alias("r"))
    return rows.select("event_id", F.col("r.score").alias("score"), F.get_json_object("r.value", "$.even").alias("even"), F.array_join("r.issues", ";").alias("issues"))


#: A contract for answers that list turns.
ANSWER = "id long not null, note string, turns array<struct<role: string not null, n: int not null>>"


def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of conversation turns against a contract that is a Spark type, some of them with parts missing or of another type."""
    turns, n = read(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % 5
    number = F.when(n == 1, F.to_json(F.struct(F.col("role").alias("x"))).substr(F.lit(6), F.length("role") + 2)).when(n == 2, F.lit("1.5")).otherwise(F.col("turn").cast("string"))
    listed = F.concat(F.lit('[{"role": "a", "n": 1}, {'), F.when(n == 3, F.lit("")).otherwise(F.lit('"role": "b", ')), F.lit('"n": '), number, F.lit("}]"))
    payload = F.concat(F.lit('{"id": '), F.when(n == 4, F.lit("null")).otherwise(F.col("conv_id").cast("string")), F.lit(', "more": true, "turns": '), listed, F.lit("}"))
    found = turns.select("conv_id", "turn", j.json_result(payload, schema=T.StructType.fromDDL(ANSWER)).alias("r"))
    return found.select("conv_id", "turn", F.col("r.score").alias("score"), F.col("r.reason").alias("reason"), F.array_join("r.issues", "; ").alias("issues"))


def _turns_with_prompt(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Assistant turns with what the model was given before: system and user turns, joined by blank lines.

    With ``most``, turns that begin beyond that many characters are left out, so that a long conversation
    meets a bounded prompt.
    """
    turns = read(spark, sf_dir, "conversations")
    given = turns.where(F.col("role").isin(*e.INPUT_ROLES) & (t.trim(F.col("text")) != "")).selectExpr(
        "conv_id", "turn", "text", "coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as start"
    )
    if most is not None:
        given = given.where(F.col("start") < most)
    said = turns.where("role = 'assistant'")
    before = said.alias("s").join(given.alias("g"), (F.col("s.conv_id") == F.col("g.conv_id")) & (F.col("g.turn") < F.col("s.turn")), "left")
    return before.groupBy(F.col("s.conv_id").alias("conv_id"), F.col("s.turn").alias("turn"), F.col("s.text").alias("text")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("g.turn").isNotNull(), F.struct("g.turn", "g.text")))), lambda x: x["text"]), "\n\n").alias("prompt")
    )


def prompt_echo_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns_with_prompt(spark, sf_dir, 8000)
    return rows.select("conv_id", "turn", r6(d.prompt_echo_score(F.col("text"), F.col("prompt"), min_tokens=8, mode="word")).alias("score"))


def benchmark_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's five-word runs, whole texts, that stand in some benchmark item; a semi join on runs."""
    runs = lambda df: t.runs(t.words(df["text"]), 5)
    documents, items = _documents(spark, sf_dir), read(spark, sf_dir, "benchmark")
    out = documents.select("doc_id", F.explode(runs(documents)).alias("run"))
    known = items.select(F.explode(runs(items)).alias("run")).distinct()
    hits = out.join(known, "run", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))
    n = documents.select("doc_id", F.greatest(F.size(t.words(documents["text"])) - 4, F.lit(0)).cast("long").alias("n_runs")).where("n_runs > 0")
    return n.join(hits, "doc_id", "left").select("doc_id", "n_runs", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), r6(F.coalesce("hits", F.lit(0)) / F.col("n_runs")).alias("score"))


def _verdicts(preset: str, entropy: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = k.PRESETS[preset] if entropy else NO_ENTROPY[preset]
        rows = k.flat_scores(k.check_output(_documents(spark, sf_dir), "text", o))
        codes = [x for x in k.CODES if entropy or x != "LOW_ENTROPY"]
        shown = [x for x in codes if x not in ("INVALID_JSON", "SCRIPT_MISMATCH", "PROMPT_ECHO", "LANG_MISMATCH") and (x != "TRUNCATED" or o.max_truncation is not None)]
        return rows.select("doc_id", "ok", F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",").alias("reasons"), *[r6(F.col(f"score_{x.lower()}")).alias(f"score_{x.lower()}") for x in shown])

    return query


def verdict_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector at once: language, script, truncation and JSON expectations."""
    o = k.PRESETS["chat"].but(max_truncation=0.75, finish_reason=finish_reason(), expect_lang=F.col("lang"), expect_script=("latin",), expect_json=True)
    rows = k.flat_scores(k.check_output(_documents(spark, sf_dir), "text", o))
    return rows.select("doc_id", "ok", F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",").alias("reasons"), *[r6(F.col(f"score_{x.lower()}")).alias(f"score_{x.lower()}") for x in k.CODES if x != "PROMPT_ECHO"])


def verdict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset with some of its options replaced; the others stay."""
    o = k.PRESETS["chat"].but(min_length=80, max_repetition=0.2, max_char_tail_loop=0.6)
    rows = k.flat_scores(k.check_output(_documents(spark, sf_dir), "text", o))
    return rows.select("doc_id", "ok", F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",").alias("reasons"), *[r6(F.col(f"score_{x}")).alias(f"score_{x}") for x in ("empty", "too_short", "repetition", "tail_loop", "low_entropy")])


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["chat"])
    return rows.select(F.explode("verdict.reasons").alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.count("*").alias("n"), r6(F.max("r.score")).alias("worst"))


def check_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.footer(k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["chat"]))


def verdict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["chat"]).withColumn("label", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return sinks.verdict_lines(rows)


def verdict_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``verdict_lines``, read back as a log of scores is read."""
    line = F.col("value")
    found = scans.extract_scores(line)
    rows = verdict_lines(spark, sf_dir).select(F.get_json_object(line, "$.label").alias("label"), F.from_json(line, "ok boolean, reasons array<struct<code: string>>").alias("v"), found.alias("f"))
    return rows.select(
        F.replace("label", F.lit("doc:"), F.lit("")).cast("long").alias("doc_id"), "label", F.col("v.ok").alias("ok"), F.array_join("v.reasons.code", ",").alias("reasons"),
        r6(F.col("f.scores")["REPETITION"]).alias("repetition"), F.col("f.modes")["TAIL_LOOP"].alias("mode"),
    )


def assert_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass, asserted to pass."""
    o = k.PRESETS["chat"]
    good = k.check_output(_documents(spark, sf_dir), "text", o).where("verdict.ok")
    return k.assert_output(good, "text", o, "verdict").select("doc_id")


def _score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents as ``(doc_id, code, mode, score)``."""
    rows = _documents(spark, sf_dir).select("doc_id", d.repetition_score(_text()).alias("rep"), d.tail_loop_detail(_text()).alias("tail"), d.shortness_score(_text(), 400).alias("short"))
    none = F.lit(None).cast("string")
    each = F.array(
        F.struct(F.lit("REPETITION").alias("code"), none.alias("mode"), r6(F.col("rep")).alias("score")),
        F.struct(F.lit("TAIL_LOOP").alias("code"), F.col("tail.mode").alias("mode"), r6(F.col("tail.score")).alias("score")),
        F.struct(F.lit("TOO_SHORT").alias("code"), none.alias("mode"), r6(F.col("short")).alias("score")),
    )
    return rows.select("doc_id", F.inline(each))


def calibrate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.calibrate_long(_score_rows(spark, sf_dir).drop("doc_id"), 0.01)
    g = F.col("gap")
    return found.select(
        "code", "mode", "n", "non_zero", *[r6(F.col(x)).alias(x) for x in ("min", "max", "p50", "p90", "p99", "p999")],
        r6(g["below"]).alias("gap_below"), r6(g["above"]).alias("gap_above"), F.coalesce(g["count"], F.lit(0)).cast("long").alias("gap_count"), r6(g["share"]).alias("gap_share"),
        F.col("suggested"), F.size("caveats").cast("long").alias("n_caveats"), "option", "rate_only",
    )


def calibrate_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration straight from verdicts' maps of scores and modes."""
    rows = k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["chat"]).select(F.col("verdict.scores").alias("scores"), F.col("verdict.modes").alias("modes"))
    return c.calibrate(rows).select("code", "mode", "n", "non_zero", r6(F.col("max")).alias("max"), r6(F.col("p99")).alias("p99"))


def label_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    found = c.margins(_score_rows(spark, sf_dir).join(labels, "doc_id"))
    return found.select("code", "mode", r6(F.col("healthy_max")).alias("healthy_max"), r6(F.col("degenerate_min")).alias("degenerate_min"), r6(F.col("margin")).alias("margin"), "safe")


def _logged() -> Column:
    """A conversation turn as some provider would have logged it, by id."""
    text = F.col("text")
    shapes = (
        F.to_json(F.struct(text.alias("text"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"))).alias("choices"))),
        F.to_json(F.struct(F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")), F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))),
        F.to_json(F.struct(F.lit("info").alias("level"), F.struct(text.alias("answer")).alias("payload"))),
        F.lit('{"unrelated": 1}'),
        F.lit("not json"),
    )
    return F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))


def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", scans.extract_text(_logged()).alias("text"))


def extract_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _score_rows(spark, sf_dir).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "score")))).alias("scores"), F.max("mode").alias("mode"))
    inner = F.struct(F.col("scores"), F.struct(F.col("mode").alias("TAIL_LOOP")).alias("modes"))
    line = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.col("scores"))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.lit("reply").alias("msg"), inner.alias("verdict")))).otherwise('{"other": true}')
    found = rows.select("doc_id", scans.extract_scores(line).alias("f"))
    return found.select("doc_id", r6(F.col("f.scores")["REPETITION"]).alias("repetition"), r6(F.col("f.scores")["TAIL_LOOP"]).alias("tail_loop"), F.col("f.modes")["TAIL_LOOP"].alias("mode"))


def _responses(surface: str, prompt: bool = True):
    """Envelopes of one provider around the assistant turns, with the request before them if a prompt is wanted."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _turns_with_prompt(spark, sf_dir) if prompt else read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", F.lit("").alias("prompt"))
        text, odd = F.col("text"), F.col("conv_id") % 3 == 0
        loop = F.repeat(F.lit("again and again "), 30)
        arguments = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(loop.alias("query")))).otherwise(F.lit('{"id": 7}'))
        stop = F.when(F.col("turn") % 4 == 1, F.lit("length")).otherwise(F.lit("stop"))
        message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("before").alias("content")))
        if surface == "openai_chat":
            calls = F.when(odd, F.array(F.struct(F.lit("c1").alias("id"), F.struct(F.lit("f").alias("name"), arguments.alias("arguments")).alias("function"))))
            response = F.struct(F.array(F.struct(F.struct(text.alias("content"), calls.alias("tool_calls")).alias("message"), stop.alias("finish_reason"))).alias("choices"))
            request = F.struct(message.alias("messages"))
        elif surface == "openai_responses":
            part = F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text")), F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text")))
            items = F.array(F.struct(F.lit("message").alias("type"), part.alias("content"), F.lit(None).cast("string").alias("arguments")), F.when(odd, F.struct(F.lit("function_call").alias("type"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"), arguments.alias("arguments"))))
            response = F.struct(F.array_compact(items).alias("output"), F.struct(F.when(stop == "length", "max_output_tokens").alias("reason")).alias("incomplete_details"))
            request = F.struct(F.lit("Be brief.").alias("instructions"), F.col("prompt").alias("input"))
        elif surface == "anthropic":
            use = F.when(odd, F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.from_json(arguments, "query string, id int").alias("input")))
            blocks = F.array_compact(F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text"), F.lit(None).cast("struct<query:string,id:int>").alias("input")), F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<query:string,id:int>").alias("input")), use))
            response = F.struct(blocks.alias("content"), F.when(stop == "length", "model_context_window_exceeded").otherwise("end_turn").alias("stop_reason"))
            request = F.struct(F.lit("Be brief.").alias("system"), message.alias("messages"))
        else:
            use = F.when(odd, F.struct(F.lit("tool-call").alias("type"), F.lit(None).cast("string").alias("text"), arguments.alias("input")))
            parts = F.array_compact(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("input")), use))
            response = F.struct(parts.alias("content"), F.struct(stop.alias("unified")).alias("finishReason"))
            request = F.struct(message.alias("prompt"))
        return rows.select("conv_id", "turn", F.to_json(response).alias("response"), F.to_json(request).alias("request"))

    return make


def _envelope(surface: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = e.read_envelopes(_responses(surface)(spark, sf_dir), surface, request="request")
        return rows.select("conv_id", "turn", "text", "has_tool_calls", "finish_reason", F.array_join("arguments", "|").alias("arguments"), F.coalesce("prompt", F.lit("")).alias("prompt"))

    return query


#: A provider that the library does not know, described by accessors.
REPLIES = e.Surface(
    text=lambda v: F.array_join(F.transform(var.as_array(var.at(v, "reply.parts")), lambda p: var.as_string(var.at(p, "body"))), ""),
    has_tool_calls=lambda v: F.size(var.as_array(var.at(v, "reply.calls"))) > 0,
    finish_reason=lambda v: var.as_string(var.at(v, "why")),
    arguments=lambda v: F.transform(var.as_array(var.at(v, "reply.calls")), lambda x: e.arguments_text(var.at(x, "args"))),
    prompt=lambda r: var.as_string(var.at(r, "asked")),
    delta=lambda v: var.as_string(var.at(v, "piece")),
    event_tool_call=lambda v: var.kind(var.at(v, "call")).isNotNull(),
    event_finish_reason=lambda v: var.as_string(var.at(v, "why")),
)


def envelope_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes and stream events of a provider given as a ``Surface`` of the user's own."""
    text, why = F.col("text"), F.when(F.col("turn") % 4 == 1, "length").otherwise("done")
    calls = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.struct(F.col("turn").alias("q")).alias("args"))))
    parts = F.array(F.struct(F.substring(text, 1, 10).alias("body")), F.struct(F.substring(text, F.lit(11), F.length(text)).alias("body")))
    response = F.to_json(F.struct(F.struct(parts.alias("parts"), calls.alias("calls")).alias("reply"), why.alias("why")))
    event = F.to_json(F.struct(text.alias("piece"), F.when(F.col("conv_id") % 3 == 0, "f").alias("call"), F.when(F.col("turn") % 2 == 1, why).alias("why")))
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = said.select("conv_id", "turn", response.alias("response"), F.to_json(F.struct(F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("asked"))).alias("request"), event.alias("event"))
    found = e.read_envelopes(rows, REPLIES, request="request").withColumnRenamed("finish_reason", "stop")
    both = e.read_stream_events(found, REPLIES)
    return both.select("conv_id", "turn", "text", "has_tool_calls", "stop", F.array_join("arguments", "|").alias("arguments"), "prompt", "delta", "tool_call", F.col("finish_reason").alias("event_stop"))


def score_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.score_envelopes(_responses("openai_chat")(spark, sf_dir), ["conv_id", "turn"], "openai_chat", k.PRESETS["chat"], request="request", check_tool_arguments=True, check_prompt_echo=True)
    return found.select("conv_id", "turn", F.col("verdict.ok").alias("ok"), F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",").alias("reasons"))


def tool_arguments_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.read_envelopes(_responses("openai_chat", False)(spark, sf_dir), "openai_chat").where("has_tool_calls")
    found = v.check_arguments(rows, "arguments", "chat").where("arguments_verdict is not null")
    return found.select("conv_id", "turn", F.col("arguments_verdict.ok").alias("ok"), r6(F.col("arguments_verdict.scores")["REPETITION"]).alias("repetition"))


def merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.read_envelopes(_responses("openai_chat", False)(spark, sf_dir), "openai_chat").where("has_tool_calls")
    both = v.check_arguments(v.check_preamble(rows, "text", k.PRESETS["chat"]), "arguments", k.PRESETS["chat"])
    merged = both.select("conv_id", "turn", v.merge_verdicts(F.col("preamble"), F.col("arguments_verdict")).alias("m"))
    return merged.select("conv_id", "turn", F.col("m.ok").alias("ok"), F.size("m.reasons").cast("long").alias("n_reasons"), r6(F.col("m.scores")["REPETITION"]).alias("repetition"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of four event grammars, read back from events made of conversation turns."""
    turns = read(spark, sf_dir, "conversations")
    text = F.col("text")
    events = {
        "openai_chat": F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"), F.lit("stop").alias("finish_reason"))).alias("choices"))),
        "openai_responses": F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), text.alias("delta"))),
        "anthropic": F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), text.alias("text")).alias("delta"))),
        "ai_sdk": F.to_json(F.struct(F.lit("text-delta").alias("type"), text.alias("delta"))),
    }
    out = None
    for surface, event in events.items():
        rows = e.read_stream_events(turns.select("conv_id", "turn", event.alias("event")), surface).select("conv_id", "turn", F.lit(surface).alias("surface"), "delta", "tool_call", "finish_reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def _replay(early: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = k.PRESETS["chat"].but(expect_script=("cyrillic",)) if early else k.PRESETS["chat"]
        found = guard.replay(_documents(spark, sf_dir), ["doc_id"], "text", o, 100, guard.Schedule(early_document=early))
        return found.select("doc_id", "n_chars", "checks", F.coalesce("caught_at", F.lit(-1)).cast("long").alias("caught_at"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"))

    return query


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one only where the session names none and runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, chunks: DataFrame, options, windows: bool = True) -> DataFrame:
    """Verdicts of a stream made of the chunks, or only those at its responses' ends."""
    folder = _shared_folder(spark, "guard")
    chunks.write.parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    return guard.run_to_table(guard.spans_to_judge(spark.readStream.schema(stored.schema).parquet(f"{folder}/chunks"), windows=windows), options, folder)


def stateful_stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed in chunks of 100 characters through the stateful guard; where each first fails, in a window or at its end."""
    judged = _streamed(spark, guard.chunked(_documents(spark, sf_dir), "doc_id", "text", 100), k.PRESETS["chat"])
    return guard.first_failures(judged).select(F.col("response_id").cast("long").alias("doc_id"), "caught_at", "kind", F.array_join("reasons", ",").alias("reasons"))


def _in_waves(spark: SparkSession, waves: list[DataFrame], folder: str, *by: str) -> DataFrame:
    """A stream that gets each of the waves in a micro-batch of its own, more or less; rows dealt ``by`` columns need not be sorted for it."""
    files = spark.sparkContext.defaultParallelism
    for wave in waves:
        wave.repartition(files, *by).write.mode("append").parquet(f"{folder}/chunks")
    return spark.readStream.schema(waves[0].schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/chunks")


def _reported(report: DataFrame) -> DataFrame:
    """One row for each response of a guarded stream: what passed, where it fired, how it ended, and what came too late."""
    codes = F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    return report.groupBy(F.col("response_id").cast("long").alias("doc_id")).agg(
        F.count(of("chunk", F.lit(1))).alias("n_chunks"), F.coalesce(F.sum(of("chunk", F.length("delta"))), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.max(of("fired", F.col("at_chars"))), F.lit(-1)).cast("long").alias("fired_at"), F.coalesce(F.max(of("fired", codes)), F.lit("")).alias("fired_reasons"),
        F.max(of("end", codes)).alias("end_reasons"), F.count(of("late", F.lit(1))).alias("n_late"),
    )


def stream_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed in two waves of chunks of 100 characters: what passes the guard, which check fires first, and the last verdict of those that never fire."""
    folder, chunks = _shared_folder(spark, "fired"), guard.chunked(_documents(spark, sf_dir), "doc_id", "text", 100)
    stream = _in_waves(spark, [chunks.where("seq < 5"), chunks.where("seq >= 5")], folder, "response_id")
    return _reported(guard.report_to_table(guard.guard_stream(stream, k.PRESETS["chat"]), folder)).drop("n_late")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with event times: chunks are replayed, and each response gets a looping chunk after its end; neither changes anything."""
    folder = _shared_folder(spark, "late")
    chunks = guard.chunked(_documents(spark, sf_dir), "doc_id", "text", 100).withColumn("sent", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    loop = F.repeat(F.lit("again and again "), 40)
    after = chunks.where("is_end").select("response_id", (F.col("seq") + 1).alias("seq"), loop.alias("delta"), "finish_reason", F.lit(False).alias("is_end"), (F.col("sent") + F.expr("interval 1 second")).alias("sent"))
    waves = [chunks.where("seq < 5"), chunks.where("seq >= 3"), chunks.where("seq % 3 = 0").unionByName(after)]
    report = guard.guard_stream(_in_waves(spark, waves, folder, "response_id"), k.PRESETS["chat"], silence_ms=3_600_000, event_time="sent", delay="12 hours", report_late=True)
    return _reported(guard.report_to_table(report, folder))


def stream_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last verdict of each document streamed in chunks: the full check under the stop reason, or that of a preamble.

    Every seventh document is a turn with a tool call.
    """
    rows = _documents(spark, sf_dir).select("doc_id", "text", finish_reason().alias("stop"))
    chunks = guard.chunked(rows, "doc_id", "text", 500).join(rows.select(F.col("doc_id").cast("string").alias("response_id"), "stop", (F.col("doc_id") % 7 == 3).alias("tool")), "response_id")
    chunks = chunks.select("response_id", "seq", "delta", F.when(F.col("is_end"), F.col("stop")).alias("finish_reason"), "is_end", (F.col("tool") & (F.col("seq") == 0)).alias("tool_call"))
    judged = _streamed(spark, chunks, k.PRESETS["longForm"], windows=False).where("kind in ('end', 'preamble')")
    return judged.select(F.col("response_id").cast("long").alias("doc_id"), "at_chars", "kind", F.col("verdict.ok").alias("ok"), F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",").alias("reasons"))


def sql_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions under their names in SQL, the stream's checks as a lateral join."""
    names.register(spark)
    return spark.sql(
        """
        with checks as (select doc_id, count(*) as checks, max(at_chars) as last_check from {docs} d, lateral gristmill_stream_checks(d.text, 100) group by doc_id)
        select d.doc_id, round(gristmill_compression_ratio(d.text), 6) as ratio, gristmill_is_json(d.text) as is_json, size(gristmill_string_leaves(to_json(struct(d.source, d.text)))) as n_leaves,
               gristmill_extract_text(to_json(struct(d.text as answer))) = d.text as found, coalesce(checks, 0) as checks, coalesce(last_check, -1) as last_check
        from {docs} d left join checks using (doc_id)
        """,
        docs=_documents(spark, sf_dir),
    )


def _written(spark: SparkSession, sf_dir: str, name: str, value: Column) -> str:
    """A folder of text files with one value for each document, as some producer might have written them."""
    folder = _shared_folder(spark, name)
    _documents(spark, sf_dir).select(value.alias("value")).write.text(folder)
    return folder


def _response_logs(spark: SparkSession, sf_dir: str) -> str:
    """A folder of 16 logs of JSON lines in order of ids, with blank and foreign lines among them."""
    line = F.when(F.col("doc_id") % 11 == 4, F.lit("")).when(F.col("doc_id") % 11 == 7, F.lit('{"level": "info"}')).otherwise(F.to_json(F.struct(F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("output"))))
    folder = _shared_folder(spark, "responses")
    logs = _documents(spark, sf_dir).select(line.alias("value"), (F.col("doc_id") % 16).alias("log"), "doc_id").repartition("log").sortWithinPartitions("log", "doc_id")
    logs.drop("doc_id").write.partitionBy("log").text(folder)
    return folder


def scan_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses read from JSON lines; the id is found in the text, the line number in the label."""
    rows = scans.read_responses(spark, f"{_response_logs(spark, sf_dir)}/*")
    known = rows.where("text is not null").select(F.split("text", " ", 2).alias("x"), F.regexp_extract("label", ":([0-9]+)$", 1).cast("long").alias("line_no"))
    counts = rows.agg(F.count("*").alias("lines"), F.count_if(F.col("text").isNull()).alias("unrecognised"))
    return known.select(F.col("x")[0].cast("long").alias("doc_id"), "line_no", F.sha2(F.col("x")[1], 256).alias("text_sha256")).join(F.broadcast(counts))


def log_source_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs through the data source of growing logs, as a batch and as a stream; ``place`` orders the recognised lines of a log by the byte they begin at."""
    folder, out = _response_logs(spark, sf_dir), _shared_folder(spark, "followed")
    stream = growing.read_log_responses(spark, folder, stream=True, blockBytes=1 << 20)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    modes = {"batch": growing.read_log_responses(spark, folder, blockBytes=1 << 20), "stream": spark.read.schema(stream.schema).parquet(f"{out}/rows")}
    rows = modes["batch"].withColumn("mode", F.lit("batch")).unionByName(modes["stream"].withColumn("mode", F.lit("stream"))).where("text is not null")
    found = rows.select("mode", F.split("text", " ", 2).alias("x"), F.regexp_extract("label", "^(.*):[0-9]+$", 1).alias("path"), F.regexp_extract("label", ":([0-9]+)$", 1).cast("long").alias("start"))
    slim = found.select("mode", F.col("x")[0].cast("long").alias("doc_id"), F.sha2(F.col("x")[1], 256).alias("text_sha256"), F.xxhash64("path").alias("log"), "start")
    return slim.selectExpr("mode", "doc_id", "text_sha256", "row_number() over (partition by mode, log order by start) as place").withColumn("place", F.col("place").cast("long"))


def log_stream_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a chat provider in logs that grow between two runs of the guard, which goes on from its checkpoint: the rows of ``stream_fired``."""
    logs, out = _shared_folder(spark, "events"), _shared_folder(spark, "guarded")
    chunks = guard.chunked(_documents(spark, sf_dir), "doc_id", "text", 100)
    event = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("delta").alias("content")).alias("delta"), F.when(F.col("is_end"), "stop").alias("finish_reason"))).alias("choices")))
    lines = chunks.select("seq", F.to_json(F.struct("response_id", "seq", event.alias("event"))).alias("value"))
    report = None
    for wave in ("seq < 5", "seq >= 5"):
        lines.where(wave).select("value").write.mode("append").text(logs)
        read = growing.read_log(spark, logs, stream=True).select(F.from_json("line", "response_id string, seq bigint, event string").alias("x")).select("x.*")
        found = e.read_stream_events(read, "openai_chat").select("response_id", "seq", "delta", F.lit(None).cast("string").alias("finish_reason"), F.col("finish_reason").isNotNull().alias("is_end"))
        report = guard.report_to_table(guard.guard_stream(found, k.PRESETS["chat"]), out)
    return _reported(report).drop("n_late")


def fixtures_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as labelled fixtures, one JSON object a file, and read back: every second one bad, with one expected script or two."""
    folder, even = _shared_folder(spark, "fixtures"), F.col("item_id") % 2 == 0
    script = F.when(even, F.to_json(F.array(F.lit("han"), F.lit("kana")))).otherwise('"latin"')
    value = F.concat(
        F.lit('{\n"id": "'), F.col("item_id").cast("string"), F.lit('",\n"note": "", "text": '), F.get(F.split(F.to_json(F.struct("text")), "^\\{\"text\":|\\}$"), F.lit(1)),
        F.when(even, F.lit(', "expect": ["EMPTY", "TAIL_LOOP"]')).otherwise(""), F.lit(', "options": {"minLength": '), (F.col("item_id") % 50).cast("string"), F.lit(', "expectScript": '), script, F.lit("}}"),
    )
    rows = read(spark, sf_dir, "benchmark").where("text is not null").select(value.alias("value"), "item_id", F.when(even, "bad").otherwise("good").alias("label"))
    rows.write.partitionBy("item_id", "label").text(folder)
    found = scans.read_fixtures(spark, f"{folder}/*/*")
    return found.select(
        F.col("id").cast("long").alias("item_id"), F.regexp_extract("label", "([a-z]+)$", 1).alias("label"), F.sha2("text", 256).alias("text_sha256"), F.coalesce(F.array_join("expect", ","), F.lit("")).alias("expect"),
        F.array_join("options.expectScript", ",").alias("scripts"), F.col("options.minLength").cast("long").alias("min_length"),
    )


def scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written one to a file and read back as whole files."""
    folder = _shared_folder(spark, "texts")
    read(spark, sf_dir, "benchmark").select("item_id", "text").write.option("lineSep", "\f").partitionBy("item_id").text(folder)
    rows = scans.read_texts(spark, f"{folder}/*/*.txt")
    return rows.select(F.regexp_extract("label", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"), F.sha2(F.regexp_replace("text", "\f$", ""), 256).alias("text_sha256"))


def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and modes read from a log of verdict lines."""
    folder = _shared_folder(spark, "scores")
    sinks.write_verdicts(k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["chat"]).withColumn("label", F.col("doc_id").cast("string")), folder)
    rows = scans.read_scores(spark, folder)
    return rows.select(F.explode(F.map_keys("scores")).alias("code"), "scores", "modes").groupBy("code").agg(F.count("*").alias("n"), r6(F.max(F.col("scores")[F.col("code")])).alias("worst"), F.count_if(F.col("modes")["TAIL_LOOP"] == "char").alias("by_char"))


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of each source's documents would exit with."""
    counts = sinks.footer(k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["chat"]), by=["source"])
    return counts.select("source", "checked", "degenerate", F.col("exit_code").cast("long").alias("exit_code"))


def written_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict lines of all documents written to files, and the counts and exit code that were observed meanwhile; every ninth text is absent."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("label"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    counts = sinks.write_verdicts(k.check_output(rows, "text", k.PRESETS["chat"]), folder := _shared_folder(spark, "lines"))
    lines = spark.read.text(folder).agg(F.count("*").alias("lines"))
    return lines.select("lines", *[F.lit(counts[c]).cast("long").alias(c) for c in ("checked", "degenerate", "unrecognised", "exit_code")])


def verdict_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of streamed documents as a callback gets them, one call for each micro-batch; the callback keeps them in a table."""
    folder = _shared_folder(spark, "callbacks")
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    stream = _in_waves(spark, [rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")], folder, "doc_id")

    def call(verdicts: DataFrame, batch: int) -> None:
        verdicts.select("doc_id", F.col("verdict.ok").alias("ok"), F.array_join(F.transform("verdict.reasons", lambda r: r["code"]), ",").alias("reasons")).write.mode("overwrite").parquet(f"{folder}/kept/batch={batch}")

    query = sinks.for_each_verdict(k.check_output(stream, "text", k.PRESETS["chat"]), call, f"{folder}/checkpoint")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("doc_id bigint, ok boolean, reasons string").parquet(f"{folder}/kept").select("doc_id", "ok", "reasons")


def check_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every reason, for people."""
    rows = k.check_output(_documents(spark, sf_dir), "text", k.PRESETS["longForm"].but(max_compressibility=None))
    return rows.select("doc_id", F.inline("verdict.reasons")).where("code in ('EMPTY', 'TOO_SHORT', 'REPETITION', 'TAIL_LOOP')").select("doc_id", "code", "message", r6(F.col("threshold")).alias("threshold"))


def stream_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that reach the reader of each document under two policies for degenerate output."""
    chunks = guard.chunked(_documents(spark, sf_dir), "doc_id", "text", 100)
    failures = guard.replay(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("response_id"), "text"), ["response_id"], "text", k.PRESETS["chat"], 100)
    out = None
    for policy in ("abort", "ignore"):
        rows = guard.pass_through(chunks, failures, policy).groupBy(F.col("response_id").cast("long").alias("doc_id")).agg(F.sum(F.length("delta")).cast("long").alias("n_chars"), F.lit(policy).alias("policy"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "empty_short": _of_documents(empty=lambda: d.emptiness_score(_text()), short=lambda: r6(d.shortness_score(_text(), 400))),
    "words_stats": _of_documents(n_words=lambda: F.size(t.words(_text())).cast("long"), n_distinct=lambda: F.size(F.array_distinct(t.words(_text()))).cast("long"), longest=lambda: F.array_max(F.transform(t.words(_text()), F.length)).cast("long")),
    "char_stats": _of_documents(n_chars=lambda: F.size(t.chars(_text())).cast("long"), ratio=lambda: r6(t.non_spaced_ratio(_text())), mode=lambda: t.token_mode(_text())),
    "excerpt_trim": _of_documents(excerpt=lambda: t.excerpt(_text(), 60), trimmed=lambda: F.length(t.trim(F.concat(F.lit("  \n"), _text(), F.lit("\t")))).cast("long"), linguistic=lambda: F.length(t.strip_non_linguistic(F.concat(_text(), F.lit(" `x` https://e.org/a ```js\nb```")))).cast("long")),
    "repetition": _of_documents(score=lambda: r6(d.repetition_score(_text()))),
    "repetition_n4": _of_documents(score=lambda: r6(d.repetition_score(_text(), n=4))),
    "tail_loop": _tail(None),
    "tail_loop_word": _tail("word"),
    "tail_loop_char": _tail("char"),
    "low_entropy": _of_documents(ratio=lambda: r6(d.compression_ratio(_text())), score=lambda: r6(d.compressibility_score(_text()))),
    "truncation": _of_documents(score=lambda: d.truncation_score(_text())),
    "truncation_finish_reason": _of_documents(score=lambda: d.truncation_score(_text(), finish_reason())),
    "script_mismatch": _of_documents(latin=lambda: r6(d.script_mismatch_score(_text(), "latin")), other=lambda: r6(d.script_mismatch_score(_text(), ["han", "greek"])), unknown=lambda: d.script_mismatch_score(_text(), "klingon")),
    "script_profile": script_profile,
    "language_profile": language_profile,
    "language_mismatch": _of_documents(score=lambda: r6(d.language_mismatch_score(_text(), F.col("lang"))), as_en=lambda: r6(d.language_mismatch_score(_text(), "en"))),
    "json_strict": json_strict,
    "json_required_keys": json_required_keys,
    "json_string_leaves": json_string_leaves,
    "schema_check": schema_check,
    "schema_contract": schema_contract,
    "prompt_echo_conversations": prompt_echo_conversations,
    "benchmark_echo": benchmark_echo,
    "verdict_chat": _verdicts("chat", True),
    "verdict_long_form": _verdicts("longForm", True),
    "verdict_lenient": _verdicts("lenient", True),
    "verdict_strict_json": _verdicts("strictJson", False),
    "verdict_chat_native": _verdicts("chat", False),
    "verdict_long_form_native": _verdicts("longForm", False),
    "verdict_full": verdict_full,
    "verdict_overlay": verdict_overlay,
    "reason_counts": reason_counts,
    "check_footer": check_footer,
    "verdict_lines": verdict_lines,
    "verdict_lines_read": verdict_lines_read,
    "assert_output": assert_output,
    "calibrate_summary": calibrate_summary,
    "calibrate_maps": calibrate_maps,
    "label_margins": label_margins,
    "extract_text": extract_text,
    "extract_scores": extract_scores,
    "envelope_openai_chat": _envelope("openai_chat"),
    "envelope_openai_responses": _envelope("openai_responses"),
    "envelope_anthropic": _envelope("anthropic"),
    "envelope_ai_sdk": _envelope("ai_sdk"),
    "envelope_custom": envelope_custom,
    "score_envelopes": score_envelopes,
    "tool_arguments_worst": tool_arguments_worst,
    "merge_verdicts": merge_verdicts,
    "stream_events": stream_events,
    "stream_replay_first_catch": _replay(False),
    "stream_replay_early_document": _replay(True),
    "stateful_stream_guard": stateful_stream_guard,
    "stream_end": stream_end,
    "stream_policies": stream_policies,
    "stream_fired": stream_fired,
    "stream_late": stream_late,
    "sql_names": sql_names,
    "scan_responses": scan_responses,
    "log_source_responses": log_source_responses,
    "log_stream_guard": log_stream_guard,
    "fixtures_read": fixtures_read,
    "scan_texts": scan_texts,
    "scan_scores": scan_scores,
    "exit_codes": exit_codes,
    "written_footer": written_footer,
    "verdict_callbacks": verdict_callbacks,
    "check_messages": check_messages,
}
