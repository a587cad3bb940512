"""Operators that combine verdicts: tool-call preambles, tool-call arguments, and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import string_leaves_each, strip_fence
from ..functions.text import let, stage, trim
from . import detectors as d
from .check import PRESETS, VERDICT, CheckOptions, check_output, empty_found, repetition_found, tail_loop_found, verdict_of, worst_repetition, worst_tail_loop


def preamble_options(o: CheckOptions) -> CheckOptions:
    """For text before a tool call: it may be short, unfinished and not JSON."""
    return o.but(min_length=0, max_truncation=None, expect_json=False, finish_reason=None)


def argument_options(o: CheckOptions) -> CheckOptions:
    """For tool-call arguments: redundancy only, measured over the string values of the JSON text."""
    return o.but(
        min_length=0, max_truncation=None, max_compressibility=None, expect_json=False, expect_lang=None, expect_script=None, finish_reason=None, prompt=None, redundancy_scope="jsonValues"
    )


def _resolved(options: CheckOptions | str) -> CheckOptions:
    return PRESETS[options] if isinstance(options, str) else options


def check_preamble(df: DataFrame, text: str, options: CheckOptions | str, name: str = "preamble") -> DataFrame:
    """A verdict on text before a tool call; null (not judged) where it is blank."""
    blank = F.col(text).isNull() | (trim(F.col(text)) == "")
    judged = check_output(df, F.when(~blank, F.col(text)), preamble_options(_resolved(options)), name)
    return judged.withColumn(name, F.when(~blank, F.col(name)))


def check_arguments(df: DataFrame, arguments: str, options: CheckOptions | str, name: str = "arguments_verdict") -> DataFrame:
    """``df`` with the worst verdict over an array of argument texts; null where none of them has a string value that isn't blank.

    A failing verdict beats a healthy one; of failing ones the greatest reason wins, the first of equals.  Texts stay in their row: all
    calls are judged as arrays, without a shuffle.
    """
    o = argument_options(_resolved(options))
    calls = F.filter(arguments, lambda c: c.isNotNull())
    staged = stage(df, {f"_{name}_calls": calls, f"_{name}_bare": F.when(F.size(calls) > 0, F.transform(calls, strip_fence))})
    staged = staged.withColumn(f"_{name}_leaves", string_leaves_each(F.col(f"_{name}_bare")))

    def judged(call: Column, leaves: Column) -> Column:
        def measured(spans: Column) -> Column:
            detail = {"EMPTY": d.emptiness_score(call).alias("EMPTY")}
            if o.max_repetition is not None:
                detail["REPETITION"] = worst_repetition(spans, o).alias("REPETITION")
            if o.max_tail_loop is not None or o.max_char_tail_loop is not None:
                detail["TAIL_LOOP"] = worst_tail_loop(spans, o).alias("TAIL_LOOP")
            how = {"EMPTY": empty_found, "REPETITION": lambda x: repetition_found(x, o), "TAIL_LOOP": lambda x: tail_loop_found(x, o)}
            verdict = let(F.struct(*detail.values()), lambda m: verdict_of({c: how[c](m[c]) for c in detail}, F.lit(None).cast("string"), F.lit(False)))
            return F.when(F.exists(spans, lambda s: trim(s) != ""), verdict)

        return let(F.coalesce(leaves, F.array(call)), measured)

    each = F.filter(F.zip_with(f"_{name}_calls", f"_{name}_leaves", judged), lambda v: v.isNotNull())
    staged = stage(staged, {f"_{name}_each": F.when(F.size(f"_{name}_calls") > 0, each)})
    worst = lambda v: F.coalesce(F.array_max(F.transform(v["reasons"], lambda r: r["score"])), F.lit(0.0))
    ranks = F.transform(f"_{name}_each", lambda v, i: F.struct(~v["ok"], F.when(v["ok"], F.lit(0.0)).otherwise(worst(v)), (-i).alias("at")))
    return staged.withColumn(name, F.get(f"_{name}_each", -F.array_max(ranks)["at"])).select(*df.columns, name)


def merge_verdicts(preamble: Column, arguments: Column) -> Column:
    """Reasons of both, the greater score of each code; argument reasons say where they are from.  Null if both are null."""
    labelled = F.transform(arguments["reasons"], lambda r: r.withField("message", F.concat(F.lit("In a tool call argument: "), r["message"])))
    scores = F.map_zip_with(preamble["scores"], arguments["scores"], lambda k, a, b: F.greatest(a, b))
    none = F.expr("cast(map() as map<string, string>)")
    first, second = F.coalesce(preamble["modes"], none), F.coalesce(arguments["modes"], none)
    modes = F.map_concat(F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)), first)
    reasons = F.concat(preamble["reasons"], labelled)
    both = F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), scores.alias("scores"), F.when(F.size(modes) > 0, modes).alias("modes"), preamble["json"].alias("json"))
    alone = F.struct(arguments["ok"].alias("ok"), labelled.alias("reasons"), arguments["scores"].alias("scores"), arguments["modes"].alias("modes"), arguments["json"].alias("json"))
    return F.when(arguments.isNull(), preamble).when(preamble.isNull(), alone.cast(VERDICT)).otherwise(both.cast(VERDICT))


def merge_early(window: Column, document: Column) -> Column:
    """A window's verdict extended by an early verdict on the document so far, if there is one."""
    none = F.expr("cast(map() as map<string, string>)")
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    reasons = F.concat(window["reasons"], document["reasons"])
    modes = over(F.coalesce(window["modes"], none), F.coalesce(document["modes"], none))
    both = F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), over(window["scores"], document["scores"]).alias("scores"), F.when(F.size(modes) > 0, modes).alias("modes"), window["json"].alias("json"))
    return F.when(document.isNull(), window).otherwise(both.cast(VERDICT))
