"""Sinks: verdict lines, reports and exit codes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F


def verdict_lines(df: DataFrame, label: str = "label", verdict: str = "verdict") -> DataFrame:
    """One JSON text ``value`` for each row: the label and the verdict; null fields are left out."""
    v = F.col(verdict)
    return df.select(F.to_json(F.struct(F.col(label).alias("label"), *[v[c].alias(c) for c in ("ok", "reasons", "scores", "modes", "json")])).alias("value"))


def write_verdicts(df: DataFrame, path: str, label: str = "label", verdict: str = "verdict", text: str = "text") -> Row:
    """Write ``verdict_lines`` of the rows with a text as text files; the footer's counts, observed by the same job."""
    seen = Observation()
    known = F.col(text).isNotNull()
    verdict_lines(df.observe(seen, *[c.alias(n) for n, c in _counts(verdict, text).items()]).where(known), label, verdict).write.text(path)
    counts = seen.get
    return Row(**counts, exit_code=exit_code(counts))


def _counts(verdict: str, text: str) -> dict[str, Column]:
    known = F.col(text).isNotNull()
    return {"checked": F.count_if(known), "degenerate": F.count_if(known & ~F.col(verdict)["ok"]), "unrecognised": F.count_if(~known)}


def footer(df: DataFrame, verdict: str = "verdict", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``checked``, ``degenerate``, ``unrecognised`` (rows without a text) and ``exit_code``, for each group if there are any."""
    counts = df.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in _counts(verdict, text).items()])
    return counts.withColumn("exit_code", exit_code({c: F.col(c) for c in ("checked", "degenerate")}))


def exit_code(counts: Row | dict) -> int | Column:
    """0 if all passed, 1 if some response is degenerate, 2 if nothing could be read; of numbers or of columns."""
    checked, degenerate = counts["checked"], counts["degenerate"]
    if isinstance(checked, Column):
        return F.when(checked == 0, 2).when(degenerate > 0, 1).otherwise(0)
    return 2 if not checked else int(degenerate > 0)


def describe(label: str, verdict: Row) -> str:
    """One row of a report for people."""
    if verdict["ok"]:
        return f"  ok    {label}"
    detail = " ".join(f"{r['code']}={r['score']:.3f}>{r['threshold']:g}" for r in verdict["reasons"])
    return f"  FAIL  {label}\n          {detail}"


def calibration_report(n: int, skipped: int, summaries: list[Row], rate: float) -> str:
    """The text of a calibration: at most one summary for each code and mode; caveats of all are said once."""
    number = lambda x: "  -  " if x is None else f"{x:.3f}"
    out = ["", f"{n:,} verdicts" + (f", {skipped:,} lines skipped" if skipped else "") + f"; flagging budget {rate * 100:.2f}% of traffic"]
    shared = reduce(lambda a, b: [c for c in a if c in b], [list(s["caveats"]) for s in summaries]) if summaries else []
    out += [f"! {c}" for c in shared]
    for s in summaries:
        out += ["", s["code"] + (f" [{s['mode']}]" if s["mode"] else "") + f"   n={s['n']:,}"]
        out.append("  " + "   ".join(f"{name} {number(s[c])}" for name, c in (("p50", "p50"), ("p90", "p90"), ("p99", "p99"), ("p99.9", "p999"), ("max", "max"))))
        if s["gap"]:
            out.append(f"  gap {number(s['gap']['below'])} -> {number(s['gap']['above'])}  ({s['gap']['count']:,} above, {s['gap']['share'] * 100:.2f}% of traffic)")
        if s["rate_only"]:
            out.append(f"  fired on {s['non_zero']:,} of {s['n']:,} ({s['non_zero'] / s['n'] * 100:.2f}%)")
        else:
            out.append("  suggest " + (f"{s['option']}: " if s["option"] else "") + number(s["suggested"]))
        out += [f"    ! {c}" for c in s["caveats"] if c not in shared]
    return "\n".join([*out, "", "Thresholds bound false positives on this traffic; they say nothing about misses.", ""])


def for_each_verdict(df: DataFrame, call: Callable[[DataFrame, int], Any], checkpoint: str):
    """Start a streaming query that hands every micro-batch of verdicts to ``call``."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(call).start()
