"""Readers of provider envelopes: JSON text to response text, stop reason, tool calls and prompt.

Values of unknown shape are read as ``VARIANT``, so every accessor is a built-in expression; what is
absent or of another type reads as null, never as an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stage, trim
from ..functions.variant import as_array, as_string, at, kind
from ..operators.check import PRESETS, CheckOptions, check_output
from ..operators.verdicts import check_arguments, check_preamble, merge_verdicts

# Roles whose text the model was given.
INPUT_ROLES = ("system", "developer", "user", "human")


def _join(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), sep)


def content_text(content: Column) -> Column:
    """A message's content: a string, or the texts of its parts joined by line feeds."""
    parts = F.transform(as_array(content), lambda p: F.coalesce(as_string(p), as_string(at(p, "text"))))
    return F.coalesce(as_string(content), _join(parts, "\n"))


def prompt_from_messages(messages: Column) -> Column:
    """What the model was given: contents of input roles, or without a role, joined by blank lines."""
    given = F.filter(as_array(messages), lambda m: (kind(m) == "object") & F.coalesce(as_string(at(m, "role")).isin(*INPUT_ROLES), F.lit(True)))
    texts = F.transform(given, lambda m: content_text(at(m, "content")))
    return F.array_join(F.filter(texts, lambda t: trim(t) != ""), "\n\n")


def with_system(system: Column, messages: Column) -> Column:
    """A system prompt before the messages."""
    head = trim(content_text(system))
    return F.concat_ws("\n\n", F.nullif(F.coalesce(head, F.lit("")), F.lit("")), F.nullif(F.coalesce(messages, F.lit("")), F.lit("")))


def arguments_text(value: Column) -> Column:
    """Tool arguments as text: a string as it is, other values as JSON, null as empty."""
    return F.coalesce(as_string(value), F.when(kind(value).isNotNull(), F.to_json(value)), F.lit(""))


def _tool_type(value: Column, *ordinary: str) -> Column:
    return F.coalesce(~as_string(at(value, "type")).isin(*ordinary), F.lit(False))


@dataclass(frozen=True)
class Surface:
    """One provider's shapes: accessors over a response, a request and a stream event, all variants."""

    text: Callable[[Column], Column]
    has_tool_calls: Callable[[Column], Column]
    finish_reason: Callable[[Column], Column]
    arguments: Callable[[Column], Column]
    prompt: Callable[[Column], Column]
    delta: Callable[[Column], Column]
    event_tool_call: Callable[[Column], Column]
    event_finish_reason: Callable[[Column], Column]


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), 0)


def _has_call(message: Column) -> Column:
    return (F.size(as_array(at(message, "tool_calls"))) > 0) | kind(at(message, "function_call")).isNotNull()


def _choices(value: Column) -> Column:
    return as_array(at(value, "choices"))


def _chat_arguments(value: Column) -> Column:
    def of(choice: Column) -> Column:
        message = at(choice, "message")
        calls = F.transform(as_array(at(message, "tool_calls")), lambda c: arguments_text(at(c, "function.arguments")))
        old = F.when(kind(at(message, "function_call")).isNotNull(), F.array(arguments_text(at(message, "function_call.arguments"))))
        return F.concat(calls, F.coalesce(old, F.expr("cast(array() as array<string>)")))

    return F.flatten(F.transform(_choices(value), of))


_chat_finish = lambda v: _first(F.transform(_choices(v), lambda c: as_string(at(c, "finish_reason"))))

CHAT = Surface(
    text=lambda v: _join(F.transform(_choices(v), lambda c: as_string(at(c, "message.content"))), ""),
    has_tool_calls=lambda v: F.exists(_choices(v), lambda c: _has_call(at(c, "message"))),
    finish_reason=_chat_finish,
    arguments=_chat_arguments,
    prompt=lambda r: prompt_from_messages(at(r, "messages")),
    delta=lambda v: F.coalesce(as_string(at(F.get(_choices(v), 0), "delta.content")), F.lit("")),
    event_tool_call=lambda v: F.exists(_choices(v), lambda c: _has_call(at(c, "delta"))),
    event_finish_reason=_chat_finish,
)


def _items(value: Column) -> Column:
    return as_array(at(value, "output"))


def _is_call(item: Column) -> Column:
    return _tool_type(item, "message", "reasoning")


def _responses_text(value: Column) -> Column:
    messages = F.filter(_items(value), lambda i: as_string(at(i, "type")) == "message")
    parts = F.flatten(F.transform(messages, lambda i: as_array(at(i, "content"))))
    shown = F.transform(F.filter(parts, lambda p: as_string(at(p, "type")) == "output_text"), lambda p: as_string(at(p, "text")))
    return F.when(kind(at(value, "output")).isNull(), F.coalesce(as_string(at(value, "output_text")), F.lit(""))).otherwise(_join(shown, ""))


RESPONSES = Surface(
    text=_responses_text,
    has_tool_calls=lambda v: F.exists(_items(v), _is_call),
    finish_reason=lambda v: as_string(at(v, "incomplete_details.reason")),
    arguments=lambda v: F.transform(F.filter(_items(v), _is_call), lambda i: arguments_text(at(i, "arguments"))),
    prompt=lambda r: with_system(at(r, "instructions"), F.coalesce(as_string(at(r, "input")), prompt_from_messages(at(r, "input")))),
    delta=lambda v: F.when(as_string(at(v, "type")) == "response.output_text.delta", F.coalesce(as_string(at(v, "delta")), F.lit(""))).otherwise(""),
    event_tool_call=lambda v: F.coalesce(as_string(at(v, "type")) == "response.output_item.added", F.lit(False)) & _is_call(at(v, "item")),
    event_finish_reason=lambda v: as_string(at(v, "response.incomplete_details.reason")),
)


def _blocks(value: Column) -> Column:
    return as_array(at(value, "content"))


def _is_tool_block(block: Column) -> Column:
    return _tool_type(block, "text", "thinking", "redacted_thinking")


def _stop(value: Column) -> Column:
    stop = F.nullif(as_string(value), F.lit(""))
    return F.when(stop == "model_context_window_exceeded", "max_tokens").otherwise(stop)


MESSAGES = Surface(
    text=lambda v: _join(F.transform(F.filter(_blocks(v), lambda b: as_string(at(b, "type")) == "text"), lambda b: as_string(at(b, "text"))), ""),
    has_tool_calls=lambda v: F.exists(_blocks(v), _is_tool_block),
    finish_reason=lambda v: _stop(at(v, "stop_reason")),
    arguments=lambda v: F.transform(F.filter(_blocks(v), _is_tool_block), lambda b: arguments_text(at(b, "input"))),
    prompt=lambda r: with_system(at(r, "system"), prompt_from_messages(at(r, "messages"))),
    delta=lambda v: F.when((as_string(at(v, "type")) == "content_block_delta") & (as_string(at(v, "delta.type")) == "text_delta"), F.coalesce(as_string(at(v, "delta.text")), F.lit(""))).otherwise(""),
    event_tool_call=lambda v: F.coalesce(as_string(at(v, "type")) == "content_block_start", F.lit(False)) & _is_tool_block(at(v, "content_block")),
    event_finish_reason=lambda v: F.when(as_string(at(v, "type")) == "message_delta", _stop(at(v, "delta.stop_reason"))),
)


def _is_tool_part(part: Column) -> Column:
    return F.coalesce(as_string(at(part, "type")).startswith("tool-"), F.lit(False))


def _sdk_finish(value: Column) -> Column:
    return F.coalesce(as_string(value), as_string(at(value, "unified")), as_string(at(value, "raw")))


PARTS = Surface(
    text=lambda v: _join(F.transform(F.filter(_blocks(v), lambda b: as_string(at(b, "type")) == "text"), lambda b: as_string(at(b, "text"))), ""),
    has_tool_calls=lambda v: F.exists(_blocks(v), _is_tool_part),
    finish_reason=lambda v: _sdk_finish(at(v, "finishReason")),
    arguments=lambda v: F.transform(F.filter(_blocks(v), lambda b: as_string(at(b, "type")) == "tool-call"), lambda b: arguments_text(F.when(kind(at(b, "input")).isNotNull(), at(b, "input")).otherwise(at(b, "args")))),
    prompt=lambda r: prompt_from_messages(at(r, "prompt")),
    delta=lambda v: F.when(as_string(at(v, "type")) == "text-delta", F.coalesce(as_string(at(v, "delta")), F.lit(""))).otherwise(""),
    event_tool_call=_is_tool_part,
    event_finish_reason=lambda v: F.when(as_string(at(v, "type")) == "finish", _sdk_finish(at(v, "finishReason"))),
)

SURFACES = {"openai_chat": CHAT, "openai_responses": RESPONSES, "anthropic": MESSAGES, "ai_sdk": PARTS}


def read_envelopes(df: DataFrame, surface: str | Surface, response: str = "response", request: str | None = None) -> DataFrame:
    """``df`` with ``text``, ``has_tool_calls``, ``finish_reason``, ``arguments`` and, given a request column, ``prompt``."""
    s = SURFACES[surface] if isinstance(surface, str) else surface
    parsed = stage(df, {"_response": F.try_parse_json(response)} | ({"_request": F.try_parse_json(request)} if request else {}))
    value = F.col("_response")
    found = {"text": F.coalesce(s.text(value), F.lit("")), "has_tool_calls": F.coalesce(s.has_tool_calls(value), F.lit(False)), "finish_reason": s.finish_reason(value), "arguments": s.arguments(value)}
    if request:
        found["prompt"] = F.nullif(s.prompt(F.col("_request")), F.lit(""))
    return stage(parsed, found).drop("_response", "_request")


def read_stream_events(df: DataFrame, surface: str | Surface, event: str = "event") -> DataFrame:
    """``df`` with ``delta``, ``tool_call`` and ``finish_reason`` of each stream event."""
    s = SURFACES[surface] if isinstance(surface, str) else surface
    value = F.col("_event")
    found = {"delta": F.coalesce(s.delta(value), F.lit("")), "tool_call": F.coalesce(s.event_tool_call(value), F.lit(False)), "finish_reason": s.event_finish_reason(value)}
    return stage(df, {"_event": F.try_parse_json(event)}).withColumns(found).drop("_event")


def score_envelopes(df: DataFrame, key: list[str], surface: str | Surface, options: CheckOptions | str, response: str = "response", request: str | None = None, check_tool_arguments: bool = False, check_prompt_echo: bool = False) -> DataFrame:
    """``key`` and the verdict of each response; null where a tool-call turn has nothing to judge.  A map over rows: keys may repeat.

    A turn with tool calls is judged by its preamble and, if asked for, its arguments; other turns
    get the full check under the response's own stop reason.  A prompt in the options beats the request's.
    """
    o = PRESETS[options] if isinstance(options, str) else options
    rows = read_envelopes(df, surface, response, request if check_prompt_echo else None)
    if o.prompt is None and check_prompt_echo and request:
        o = o.but(prompt=F.col("prompt"))
    # a row is judged once: the text of the branch that does not apply is null, and costs nothing
    tool, text = F.col("has_tool_calls"), F.col("text")
    split = rows.withColumns({"_said": F.when(~tool, text), "_before": F.when(tool, text), "_calls": F.when(tool, F.col("arguments"))})
    both = check_preamble(check_output(split, "_said", o.but(finish_reason=F.col("finish_reason")), "_full"), "_before", o, "_preamble")
    if check_tool_arguments:
        both = check_arguments(both, "_calls", o, "_arguments")
        merged = merge_verdicts(F.col("_preamble"), F.col("_arguments"))
    else:
        merged = F.col("_preamble")
    return both.select(*key, F.when(tool, merged).otherwise(F.col("_full")).alias("verdict"))
