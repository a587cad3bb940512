"""JSON functions.  Contracts that are Spark types are judged as ``VARIANT`` expressions.  Strict parsing and recursion over values of
any shape are Arrow UDFs: the parser of ``VARIANT`` passes over trailing text, refuses repeated keys and loses the order of keys.

Strict means the grammar of JSON alone: no NaN, no trailing text.  Of repeated keys the last one counts.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACES, let, trim
from .variant import member, strict


def _reject(token: str) -> None:
    raise ValueError(token)


def parse(text: str | None) -> tuple[bool, Any]:
    """Whether ``text`` is strict JSON, and its value."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text.strip(" \t\n\r"), parse_constant=_reject, parse_int=lambda s: int(s) if len(s) < 300 else float(s))
    except (ValueError, RecursionError):
        return False, None


def leaves(value: Any) -> list[str]:
    """String leaves of a value, depth first, keys not included."""
    out, stack = [], [value]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, list):
            stack.extend(reversed(item))
        elif isinstance(item, dict):
            stack.extend(reversed(item.values()))
    return out


@F.pandas_udf(T.BooleanType())
def _is_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else parse(t)[0])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str] | None:
        ok, value = parse(text)
        return (leaves(value) or [""]) if ok else None

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _spans_each(arrays: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str] | None:
        ok, value = parse(text)
        return (leaves(value) or [""]) if ok else None

    return arrays.map(lambda texts: None if texts is None else [one(t) for t in texts])


def is_json(text: Column) -> Column:
    """Whether the text is strict JSON; null for null."""
    return _is_json(text)


def is_complete_document(text: Column) -> Column:
    """Whether the trimmed text is a JSON object or array; other texts are not sent to Python's parser."""
    bare = trim(text)
    return F.coalesce(is_json(F.when(bare.rlike(r"\A[{\[]"), bare)), F.lit(False))


def strip_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block, else the trimmed text."""
    bare = trim(text)
    pattern = rf"(?is)\A```(?:json)?[{SPACES}]*(.*?)[{SPACES}]*```\z"
    return F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, 1)).otherwise(bare)


def string_leaves(text: Column) -> Column:
    """String leaves of a JSON text (one empty string if it has none); null if it does not parse."""
    return _spans(text)


def string_leaves_each(texts: Column) -> Column:
    """``string_leaves`` of every text of an array."""
    return _spans_each(texts)


def redundancy_spans(text: Column, scope: str = "document") -> Column:
    """The spans that redundancy is measured over: the whole text, or the leaves of a JSON text."""
    if scope != "jsonValues":
        return F.array(text)
    return F.coalesce(string_leaves(strip_fence(text)), F.array(text))


_RESULT = "score double, value string, reason string, missing_keys array<string>, issues array<string>"


def render_issue(issue: Any) -> str:
    """``path: message``, or the message alone."""
    if not isinstance(issue, dict):
        return str(issue)
    path = ".".join(str(p["key"] if isinstance(p, dict) and "key" in p else p) for p in issue.get("path") or [])
    return f"{path}: {issue['message']}" if path else str(issue["message"])


def contract_issues(value: Column, contract: T.DataType, nullable: bool = True, path: str | Column = "") -> Column:
    """What keeps a variant from meeting a type, as an array of ``path: message``; empty if nothing does.

    Fields and elements that are not nullable must be there and not be null; further fields are passed over.  A whole number is one without a fraction (``1.0`` is one) within
    the range of its type; dates and timestamps are strings that can be cast.  ``VARIANT`` takes anything.
    """
    none = F.expr("cast(array() as array<string>)")
    schema = F.schema_of_variant(value)

    def issue(message: str) -> Column:
        return F.array(F.lit(f"{path}: {message}" if path else message) if isinstance(path, str) else F.concat(path, F.lit(f": {message}")))

    def below(name: str | Column) -> str | Column:
        if isinstance(path, str) and isinstance(name, str):
            return f"{path}.{name}" if path else name
        head = ([F.lit(f"{path}.")] if path else []) if isinstance(path, str) else [path, F.lit(".")]
        return F.concat(*head, F.lit(name) if isinstance(name, str) else name)

    def kinds() -> tuple[Column, str]:
        if isinstance(contract, T.StringType):
            return schema == "STRING", "a string"
        if isinstance(contract, T.BooleanType):
            return schema == "BOOLEAN", "a boolean"
        if isinstance(contract, T.IntegralType):
            return schema.rlike(r"\A(BIGINT|DECIMAL\(\d+,0\))\z") & F.try_variant_get(value, "$", contract.simpleString()).isNotNull(), "an integer"
        if isinstance(contract, T.NumericType):
            return schema.rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z") & F.try_variant_get(value, "$", contract.simpleString()).isNotNull(), "a number"
        if isinstance(contract, T.DateType | T.TimestampType | T.TimestampNTZType):
            return (schema == "STRING") & F.try_variant_get(value, "$", "string").try_cast(contract).isNotNull(), f"a {contract.simpleString()}"
        raise TypeError(f"a contract cannot hold {contract.simpleString()}")

    if isinstance(contract, T.VariantType):
        found = none
    elif isinstance(contract, T.StructType):
        of = lambda f: let(member(value, f.name), lambda x: contract_issues(x, f.dataType, f.nullable, below(f.name)))
        each = [of(f) for f in contract.fields]
        found = F.when(schema.startswith("OBJECT"), F.concat(*each) if each else none).otherwise(issue("expected an object"))
    elif isinstance(contract, T.ArrayType):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: contract_issues(x, contract.elementType, contract.containsNull, below(i.cast("string"))))
        found = F.when(schema.startswith("ARRAY"), F.flatten(each)).otherwise(issue("expected an array"))
    elif isinstance(contract, T.MapType) and isinstance(contract.keyType, T.StringType):
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string, variant>"))
        each = F.transform(entries, lambda x: contract_issues(x["value"], contract.valueType, contract.valueContainsNull, below(x["key"])))
        found = F.when(schema.startswith("OBJECT"), F.flatten(each)).otherwise(issue("expected an object"))
    else:
        fits, wanted = kinds()
        found = F.when(fits, none).otherwise(issue(f"expected {wanted}"))
    absent = value.isNull() | F.is_variant_null(value)
    return F.when(absent, none if nullable else F.when(value.isNull(), issue("required")).otherwise(issue("must not be null"))).otherwise(found)


def contract_result(text: Column, contract: T.DataType, allow_fence: bool = True, required_keys: list[str] | None = None) -> Column:
    """``json_result`` for a contract that is a Spark type, without Python; objects with repeated keys count as unparseable."""
    def parts(v: Column) -> Column:
        wanted = [F.when(member(v, k).isNull(), F.lit(k)) for k in required_keys or []]
        missing = F.array_compact(F.array(*wanted)) if wanted else F.expr("cast(array() as array<string>)")
        return F.struct(v.alias("v"), missing.alias("missing"), contract_issues(v, contract, False).alias("issues"))

    state = let(let(strict(strip_fence(text) if allow_fence else trim(text)), parts), lambda s: F.struct(
        F.when(s["v"].isNotNull() & (F.size(s["missing"]) == 0) & (F.size(s["issues"]) == 0), F.lit(0.0)).otherwise(F.lit(1.0)).alias("score"),
        F.to_json(s["v"]).alias("value"),
        F.when(s["v"].isNull(), "unparseable").when(F.size(s["missing"]) > 0, "missing-keys").when(F.size(s["issues"]) > 0, "schema").alias("reason"),
        F.when(F.size(s["missing"]) > 0, s["missing"]).alias("missing_keys"),
        F.when(s["v"].isNotNull() & (F.size(s["missing"]) == 0) & (F.size(s["issues"]) > 0), s["issues"]).alias("issues"),
    ))
    return state


def json_result(text: Column, allow_fence: bool = True, required_keys: list[str] | None = None, schema: Callable[[Any], Any] | T.DataType | None = None) -> Column:
    """``struct(score, value, reason, missing_keys, issues)``: 0 if the payload parses and meets its contract, else 1.

    A ``schema`` that is a Spark type is compiled to expressions (``contract_result``).  Otherwise it is a function:
    ``schema(value)`` returns the accepted value (which may differ), or raises ``ValueError`` whose
    argument is a list of issues: strings, or ``{"path": [...], "message": ...}``.  It must not be a coroutine.
    """
    if isinstance(schema, T.DataType):
        return contract_result(text, schema, allow_fence, required_keys)
    if schema is not None and (inspect.iscoroutinefunction(schema) or inspect.iscoroutinefunction(getattr(schema, "__call__", None))):
        raise TypeError("schema must validate synchronously")
    wanted = list(required_keys or [])

    def one(text: str | None) -> tuple:
        ok, value = parse(text)
        if not ok:
            return 1.0, None, "unparseable", None, None
        dumped = json.dumps(value, ensure_ascii=False)
        missing = wanted if not isinstance(value, dict) else [k for k in wanted if k not in value]
        if missing:
            return 1.0, dumped, "missing-keys", missing, None
        if schema is not None:
            try:
                return 0.0, json.dumps(schema(value), ensure_ascii=False), None, None, None
            except ValueError as e:
                issues = e.args[0] if e.args and isinstance(e.args[0], list) else [str(e)]
                return 1.0, dumped, "schema", None, [render_issue(i) for i in issues]
        return 0.0, dumped, None, None, None

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["score", "value", "reason", "missing_keys", "issues"])

    return run(strip_fence(text) if allow_fence else trim(text))
