"""Verdicts: all enabled detectors over a text column, under one set of options.

Options are resolved while the plan is built, so a disabled detector adds nothing to it.
``None`` disables; an absent option takes its default.  A null text gets the verdict EMPTY.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.json import json_result, redundancy_spans
from ..functions.text import excerpt, last_words, stage, trim, words
from . import detectors as d
from .plain import read_plain

CODES = ("EMPTY", "TOO_SHORT", "REPETITION", "TAIL_LOOP", "LOW_ENTROPY", "TRUNCATED", "INVALID_JSON", "SCRIPT_MISMATCH", "PROMPT_ECHO", "LANG_MISMATCH")
REASON = "struct<code: string, score: double, threshold: double, message: string, mode: string>"
VERDICT = f"struct<ok: boolean, reasons: array<{REASON}>, scores: map<string, double>, modes: map<string, string>, json: string>"


@dataclass(frozen=True)
class CheckOptions:
    """What to check and when to fire; a score fires if it is greater than its threshold."""

    min_length: int = 1
    max_repetition: float | None = 0.35
    max_tail_loop: float | None = 0.5
    max_char_tail_loop: float | None = 0.7
    non_spaced_cutoff: float = 0.5
    max_compressibility: float | None = 0.75
    max_truncation: float | None = None
    finish_reason: str | Column | None = None
    expect_json: bool = False
    allow_json_fence: bool = True
    required_keys: tuple[str, ...] = ()
    schema: Callable[[Any], Any] | DataType | None = None
    expect_lang: str | Column | None = None
    max_lang_mismatch: float = 0.6
    expect_script: str | tuple[str, ...] | None = None
    max_script_mismatch: float = 0.5
    prompt: str | Column | None = None
    max_prompt_echo: float = 0.6
    ngram: int = 3
    redundancy_scope: str = "document"

    def but(self, **changes: Any) -> CheckOptions:
        """These options with some replaced."""
        return replace(self, **changes)


# The presets.
PRESETS = {
    "chat": CheckOptions(min_length=12, max_repetition=0.4, max_tail_loop=0.5, max_char_tail_loop=0.7, max_compressibility=0.75),
    "strictJson": CheckOptions(min_length=2, max_repetition=0.6, max_tail_loop=0.6, max_char_tail_loop=0.75, max_compressibility=None, max_truncation=0.75, expect_json=True),
    "longForm": CheckOptions(min_length=200, max_repetition=0.35, max_tail_loop=0.4, max_char_tail_loop=0.6, max_compressibility=0.7, max_truncation=0.75),
    "lenient": CheckOptions(min_length=1, max_repetition=0.7, max_tail_loop=0.7, max_char_tail_loop=0.85, max_compressibility=0.9),
}
OPTION_NAMES = {f.name for f in fields(CheckOptions)}


def _percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int").cast("string")


def _reason(code: str, score: Column, threshold: Column, message: Column, mode: Column | None) -> Column:
    mode = F.lit(None).cast("string") if mode is None else mode
    return F.struct(F.lit(code).alias("code"), score.alias("score"), threshold.cast("double").alias("threshold"), message.alias("message"), mode.alias("mode"))


def repetition_found(score: Column, o: CheckOptions) -> tuple:
    """Score, threshold, message and mode of a measured repetition."""
    return score, F.lit(o.max_repetition), F.concat(_percent(score), F.lit(f"% of {o.ngram}-grams are duplicates.")), None


def tail_loop_found(detail: Column, o: CheckOptions) -> tuple:
    """Score, threshold, message and mode of a measured tail loop; no score where its mode has no threshold."""
    score, mode = detail["score"], detail["mode"]
    threshold = F.when(mode == "char", F.lit(o.max_char_tail_loop).cast("double")).otherwise(F.lit(o.max_tail_loop).cast("double"))
    message = F.concat(F.lit("Response ends in a repeating block covering "), _percent(score), F.lit("% of the tail."))
    return F.when(threshold.isNotNull(), score), threshold, message, F.when(threshold.isNotNull(), mode)


def worst_repetition(spans: Column, o: CheckOptions) -> Column:
    """The greatest repetition of several spans."""
    return F.array_max(F.transform(spans, lambda s: d.repetition_score(s, o.ngram)))


def worst_tail_loop(spans: Column, o: CheckOptions) -> Column:
    """The detail of the span that loops most, the first of equals."""
    each = F.transform(spans, lambda s: d.tail_loop_detail(s, non_spaced_cutoff=o.non_spaced_cutoff))
    none = F.struct(F.lit(-1.0).alias("score"), F.lit("word").alias("mode"))
    return F.aggregate(each, none, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def verdict_of(found: dict[str, tuple], value: Column, is_null: Column) -> Column:
    """``struct(ok, reasons, scores, modes, json)`` of what the detectors found; of a null or empty text the reason EMPTY only."""
    reasons = F.filter(F.array(*[F.when(score > limit, _reason(code, score, limit, message, mode)) for code, (score, limit, message, mode) in found.items()]), lambda r: r.isNotNull())
    scores = F.map_filter(F.create_map(*[x for code, (score, *_) in found.items() for x in (F.lit(code), score)]), lambda k, v: v.isNotNull())
    pairs = [x for code, (*_, mode) in found.items() if mode is not None for x in (F.lit(code), mode)]
    modes = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.lit(None).cast("map<string, string>")
    no_text = _reason("EMPTY", F.lit(1.0), F.lit(0.5), F.when(is_null, F.lit("Response was null, not a string.")).otherwise(found["EMPTY"][2]), None)
    short = F.struct(
        F.lit(False).alias("ok"), F.array(no_text).alias("reasons"), F.create_map(F.lit("EMPTY"), F.lit(1.0)).alias("scores"),
        F.lit(None).cast("map<string, string>").alias("modes"), F.lit(None).cast("string").alias("json"),
    )
    full = F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), scores.alias("scores"), F.when(F.size(modes) > 0, modes).alias("modes"), value.alias("json"))
    return F.when(is_null | (found["EMPTY"][0] >= 1), short).otherwise(full).cast(VERDICT)


def empty_found(score: Column) -> tuple:
    return score, F.lit(0.5), F.lit("Response contains no usable content."), None


def measures(df: DataFrame, text: Column, o: CheckOptions, prefix: str = "_m_", only: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, tuple]]:
    """``df`` with a column for each enabled detector's score, and ``code -> (score, threshold, message, mode)``.

    ``only`` may say which rows hold a ``whole`` text, for detectors that a part of a text isn't measured by, and which an ``ended`` one; others get null.
    """
    only = only or {}
    among = lambda rows, x: F.when(only[rows], x) if rows in only else x
    spans = redundancy_spans(text, o.redundancy_scope) if o.redundancy_scope == "jsonValues" else None
    staged = df.withColumn(f"{prefix}spans", spans) if spans is not None else df
    # the words of the first 8000 characters, which is all of most texts
    by_words = spans is None and (o.max_repetition is not None or o.max_tail_loop is not None or o.max_char_tail_loop is not None)
    head = words(F.substring(text, 1, 8000)) if by_words or o.expect_lang is not None else F.lit(None).cast("array<string>")
    t, w, p = F.col(f"{prefix}text"), F.col(f"{prefix}words"), F.col(f"{prefix}plain")
    # where texts go to Python anyway, those of plain letters are counted there, and only the others are taken apart here
    plain = by_words and o.max_compressibility is not None and o.non_spaced_cutoff > 0
    scripts = tuple(x for x in ([o.expect_script] if isinstance(o.expect_script, str) else o.expect_script or ()) if x in d.SCRIPTS)
    if plain:
        staged = stage(staged, {f"{prefix}text": text}).withColumn(f"{prefix}plain", read_plain(t, o.ngram, o.expect_lang is not None, scripts, only.get("whole")))
        staged = staged.withColumn(f"{prefix}words", F.when(~F.coalesce(p["steady"], F.lit(False)), words(F.substring(t, 1, 8000))))
    else:
        staged = stage(staged, {f"{prefix}text": text, f"{prefix}words": head})
    told = lambda known, there, here: F.when(known, there).otherwise(here) if plain else here
    whole = F.length(t) <= 8000
    scores: dict[str, Column] = {"EMPTY": d.emptiness_score(t)}
    if o.min_length > 0:
        scores["TOO_SHORT"] = d.shortness_score(t, o.min_length)
    if o.max_repetition is not None:
        if spans is None:
            scores["REPETITION"] = told(p["repetition"].isNotNull(), p["repetition"], d.repetition_of_words(w, o.ngram))
        else:
            scores["REPETITION"] = worst_repetition(F.col(f"{prefix}spans"), o)
    if o.max_tail_loop is not None or o.max_char_tail_loop is not None:
        if spans is None:
            none = F.struct(F.lit(0.0).alias("score"), F.lit("word").alias("mode"))
            scores["TAIL_LOOP"] = told(p["steady"], none, d.tail_loop_detail(t, non_spaced_cutoff=o.non_spaced_cutoff, tokens=F.when(whole, w).otherwise(last_words(t, 200))))
        else:
            scores["TAIL_LOOP"] = worst_tail_loop(F.col(f"{prefix}spans"), o)
    if o.max_compressibility is not None:
        scores["LOW_ENTROPY"] = d.compressibility_of(p["ratio"], among("whole", t)) if plain else d.compressibility_score(among("whole", t))
    if o.max_truncation is not None or o.finish_reason is not None:
        # without a threshold of its own it counts only where there is a stop reason, and is measured only there
        asked = among("ended", t) if o.max_truncation is not None or isinstance(o.finish_reason, str) else F.when(o.finish_reason != "", among("ended", t))
        scores["TRUNCATED"] = d.truncation_score(asked, o.finish_reason)
    if o.expect_json:
        scores["INVALID_JSON"] = json_result(among("ended", t), o.allow_json_fence, list(o.required_keys), o.schema)
    if o.expect_script:
        by_regex = d.script_mismatch_score(among("whole", t), o.expect_script if isinstance(o.expect_script, str) else list(o.expect_script))
        scores["SCRIPT_MISMATCH"] = told(p["letters"].isNotNull(), among("whole", d.script_mismatch_of(p["letters"], p["in_script"])), by_regex) if scripts else by_regex
    if o.prompt is not None:
        scores["PROMPT_ECHO"] = d.prompt_echo_detail(among("whole", t), o.prompt, non_spaced_cutoff=o.non_spaced_cutoff)
    if o.expect_lang is not None:
        by_words_here = d.language_mismatch_score(t, o.expect_lang, tokens=among("whole", F.when(whole, F.coalesce(w, words(t)) if plain else w).otherwise(words(t))))
        shares = {name: F.get(p["by_language"], F.lit(i)) / F.greatest(p["n_words"], F.lit(1)) for i, name in enumerate(d.LANGUAGES)}
        known = isinstance(o.expect_lang, Column) or o.expect_lang in d.LANGUAGES
        scores["LANG_MISMATCH"] = told(p["n_words"].isNotNull(), among("whole", d.language_mismatch_of(shares, p["n_words"], o.expect_lang)), by_words_here) if known else by_words_here
    from_python = {code: score for code, score in scores.items() if code in ("LOW_ENTROPY", "INVALID_JSON", "TRUNCATED")}
    staged = staged.withColumns({f"{prefix}{code}": score for code, score in from_python.items()})
    staged = stage(staged, {f"{prefix}{code}": score for code, score in scores.items() if code not in from_python})
    m = {code: F.col(f"{prefix}{code}") for code in scores}
    # The messages of the reasons, here and above.
    out: dict[str, tuple] = {"EMPTY": empty_found(m["EMPTY"])}
    if "TOO_SHORT" in m:
        out["TOO_SHORT"] = (m["TOO_SHORT"], F.lit(0.0), F.concat(F.lit("Response is "), F.length(trim(t)).cast("string"), F.lit(f" chars, below the {o.min_length} minimum.")), None)
    if "REPETITION" in m:
        out["REPETITION"] = repetition_found(m["REPETITION"], o)
    if "TAIL_LOOP" in m:
        out["TAIL_LOOP"] = tail_loop_found(m["TAIL_LOOP"], o)
    if "LOW_ENTROPY" in m:
        out["LOW_ENTROPY"] = (m["LOW_ENTROPY"], F.lit(o.max_compressibility), F.lit("Response is far more compressible than natural language."), None)
    if "TRUNCATED" in m:
        on = F.lit(True) if o.max_truncation is not None or isinstance(o.finish_reason, str) else F.coalesce(o.finish_reason != "", F.lit(False))
        message = F.concat(F.lit('Response appears cut off near: "'), excerpt(F.right(trim(t), F.lit(60)), 60), F.lit('"'))
        out["TRUNCATED"] = (F.when(on, m["TRUNCATED"]), F.lit(0.75 if o.max_truncation is None else o.max_truncation), message, None)
    if "INVALID_JSON" in m:
        r = m["INVALID_JSON"]
        message = (
            F.when(r["reason"] == "missing-keys", F.concat(F.lit("JSON is missing required keys: "), F.array_join(r["missing_keys"], ", "), F.lit(".")))
            .when(r["reason"] == "schema", F.concat(F.lit("JSON does not match the schema: "), F.array_join(r["issues"], "; "), F.lit(".")))
            .otherwise(F.lit("Response is not parseable JSON."))
        )
        out["INVALID_JSON"] = (r["score"], F.lit(0.0), message, None)
    if "SCRIPT_MISMATCH" in m:
        names = o.expect_script if isinstance(o.expect_script, str) else " or ".join(o.expect_script)
        out["SCRIPT_MISMATCH"] = (m["SCRIPT_MISMATCH"], F.lit(o.max_script_mismatch), F.concat(_percent(m["SCRIPT_MISMATCH"]), F.lit(f"% of letters are not in {names}.")), None)
    if "PROMPT_ECHO" in m:
        on = F.lit(o.prompt != "") if isinstance(o.prompt, str) else F.coalesce(o.prompt != "", F.lit(False))
        message = F.concat(_percent(m["PROMPT_ECHO"]["score"]), F.lit("% of the response is copied from the prompt."))
        out["PROMPT_ECHO"] = (F.when(on, m["PROMPT_ECHO"]["score"]), F.lit(o.max_prompt_echo), message, F.when(on, m["PROMPT_ECHO"]["mode"]))
    if "LANG_MISMATCH" in m:
        wanted = F.lit(o.expect_lang) if isinstance(o.expect_lang, str) else o.expect_lang
        out["LANG_MISMATCH"] = (F.when(wanted.isNotNull(), m["LANG_MISMATCH"]), F.lit(o.max_lang_mismatch), F.concat(F.lit("Response does not look like '"), F.coalesce(wanted, F.lit("")), F.lit("'.")), None)
    return staged, out


def check_output(df: DataFrame, text: str | Column = "text", options: CheckOptions | str = CheckOptions(), name: str = "verdict") -> DataFrame:
    """``df`` with a column ``name``: ``struct(ok, reasons, scores, modes, json)``.

    Null texts and empty ones get the reason EMPTY only.  Scores of disabled detectors are absent.
    """
    o = PRESETS[options] if isinstance(options, str) else options
    column = F.col(text) if isinstance(text, str) else text
    prefix = f"_{name}_"
    staged, found = measures(df, column, o, prefix)
    value = F.col(f"{prefix}INVALID_JSON")["value"] if o.expect_json else F.lit(None).cast("string")
    verdict = verdict_of(found, value, F.col(f"{prefix}text").isNull())
    return staged.withColumn(name, verdict).select(*df.columns, name)


def flat_scores(df: DataFrame, verdict: str = "verdict", codes: tuple[str, ...] = CODES) -> DataFrame:
    """``df`` with ``ok`` and one ``score_<code>`` column for each code; null where the detector did not run."""
    return df.withColumns({"ok": F.col(verdict)["ok"]} | {f"score_{c.lower()}": F.col(verdict)["scores"][c] for c in codes})


class DegenerateOutputError(ValueError):
    """Raised for a response that fails; ``verdict`` says why, and asking again may help (``retryable``)."""

    def __init__(self, verdict: dict) -> None:
        super().__init__("; ".join(r["message"] for r in verdict["reasons"]))
        self.verdict, self.retryable = verdict, True


def assert_output(df: DataFrame, text: str = "text", options: CheckOptions | str = CheckOptions(), verdict: str | None = None) -> DataFrame:
    """The rows of ``df``; the job fails at the first degenerate text.  A column ``verdict`` that ``df`` already has is believed, so that nothing is judged twice."""
    checked = check_output(df, text, options, "_verdict") if verdict is None else df.withColumn("_verdict", F.col(verdict))
    why = F.concat(F.lit("degenerate output: "), F.array_join(F.transform("_verdict.reasons", lambda r: r["code"]), ", "))
    held = checked.withColumn("_held", F.when(F.col("_verdict.ok"), F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))
    return held.where("_held").select(*df.columns)
