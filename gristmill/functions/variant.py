"""Accessors over JSON values of unknown shape, held as ``VARIANT``; all are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def kind(value: Column) -> Column:
    """``string``, ``array``, ``object`` or ``other``; null for null and JSON null."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string"))
        .when(schema == "STRING", "string").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("other")
    )


def at(value: Column, path: str) -> Column:
    """The member at a path, as a variant."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def as_string(value: Column) -> Column:
    """A JSON string's text; null for any other value."""
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))


def as_array(value: Column) -> Column:
    """A JSON array's elements; an empty array for any other value."""
    return F.coalesce(F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>")), F.expr("cast(array() as array<variant>)"))


def strict(text: Column) -> Column:
    """The value of a text that is one JSON document and nothing else; null otherwise, and for objects with repeated keys.

    The parser stops at the end of the first value, so the text is parsed as the first of two elements, with its own hash as the second: only if that
    comes out again, nothing followed.
    """
    seal = F.sha2(text, 256)
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))), "$", "array<variant>")
    return let(pair, lambda p: F.when((F.size(p) == 2) & (F.try_variant_get(F.get(p, 1), "$", "string") == seal), F.get(p, 0)))


def member(value: Column, name: str) -> Column:
    """The member of that very name, whatever characters it has, as a variant."""
    if re.fullmatch(r"[\w .-]+", name):
        return F.try_variant_get(value, f"$['{name}']", "variant")
    return F.try_variant_get(value, "$", "map<string, variant>")[name]
