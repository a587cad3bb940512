"""Command line: ``check`` scores texts, ``calibrate`` derives thresholds from logged scores.

    python -m gristmill.cli check [--preset NAME] [--jsonl] [--json] [--quiet] FILE...
    python -m gristmill.cli calibrate [--fpr RATE] [--json] FILE

Exit codes: 0 all fine, 1 some response is degenerate (or a usage error of ``calibrate``), 2 unreadable input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.calibrate import calibrate
from .operators.check import PRESETS, check_output
from .sources import scans, sinks

def _check(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.preset not in PRESETS:
        print(f"--preset expects one of: {', '.join(PRESETS)}", file=sys.stderr)
        return 2
    try:
        texts = (scans.read_responses if args.jsonl else scans.read_texts)(spark, args.files) if args.files else scans.read_stdin(spark, args.jsonl)
        checked = check_output(texts, "text", args.preset).persist()
        counts = sinks.footer(checked).first()
    except AnalysisException as e:
        print(f"Could not read input: {e.getCondition()}", file=sys.stderr)
        return 2
    if not counts["checked"]:
        print(f"No response text found in {counts['unrecognised']} line(s)." if counts["unrecognised"] else "No input.", file=sys.stderr)
        return 2
    known = checked.where(F.col("text").isNotNull())
    if args.json:
        for row in sinks.verdict_lines(known).toLocalIterator():
            print(row["value"])
    elif not args.quiet:
        for row in known.select("label", "verdict").toLocalIterator():
            print(sinks.describe(row["label"], row["verdict"]))
        more = f", {counts['unrecognised']} line(s) unrecognised" if counts["unrecognised"] else ""
        print(f"\n  {counts['checked']} checked under {args.preset}, {counts['degenerate']} degenerate{more}")
    return sinks.exit_code(counts)


def _scores(spark: SparkSession, files: list[str]) -> DataFrame:
    if files:
        return scans.read_scores(spark, files)
    lines = [(line,) for line in sys.stdin.read().split("\n") if line.strip()]
    return spark.createDataFrame(lines, "line string").select(scans.extract_scores(F.col("line")).alias("found")).select("found.*")


def _calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    if not 0 < args.fpr < 1:
        print("--fpr must lie between 0 and 1 (both excluded); 0.001 flags one text in a thousand", file=sys.stderr)
        return 1
    try:
        rows = _scores(spark, args.files).persist()
        counts = rows.agg(F.count("scores").alias("n"), F.count_if(F.col("scores").isNull()).alias("skipped")).first()
    except AnalysisException as e:
        print(f"Could not read input: {e.getCondition()}", file=sys.stderr)
        return 1
    if not counts["n"]:
        print(f"No scores found ({counts['skipped']} lines had none).", file=sys.stderr)
        return 1
    found = calibrate(rows.where(F.col("scores").isNotNull()), false_positive_rate=args.fpr).collect()  # one row for each code and mode
    if args.json:
        print(json.dumps({"n": counts["n"], "summaries": [r.asDict(recursive=True) for r in found]}, indent=2))
    else:
        print(sinks.calibration_report(counts["n"], counts["skipped"], found, args.fpr))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; anything that is not ``check`` is ``calibrate``."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or "--help" in argv or "-h" in argv:
        print(__doc__)
        return 0 if argv else 1
    command = argv.pop(0) if argv[0] in ("check", "calibrate") else "calibrate"
    parser = argparse.ArgumentParser(prog=command, add_help=False)
    parser.add_argument("--json", action="store_true")
    parser.add_argument("files", nargs="*")
    if command == "check":
        parser.add_argument("--preset", default="chat")
        parser.add_argument("--jsonl", action="store_true")
        parser.add_argument("--quiet", action="store_true")
    else:
        parser.add_argument("--fpr", type=float, default=0.001)
    try:
        args = parser.parse_args(argv)
    except SystemExit:
        return 2 if command == "check" else 1
    spark = spark or SparkSession.builder.appName("gristmill").config("spark.ui.enabled", "false").getOrCreate()
    return _check(spark, args) if command == "check" else _calibrate(spark, args)


if __name__ == "__main__":
    sys.exit(main())
