"""Thresholds from logged scores: distributions, gaps, suggestions and caveats for each code and mode.

Rows hold ``scores`` (code to score) and, optionally, ``modes`` (code to ``word`` or ``char``).  There are
few codes, so scores are counted by value before any shuffle by code.  Percentiles are exact: the wanted ranks of each code are searched in
bins, and in each pass the bins that hold them are cut into finer ones, so no task ever holds the scores of a code; ten numbers for
each code and mode go through the driver.  A gap is wider than the bins it is looked for in, so it lies between two bins: their least and
greatest values are enough, and no sort over all scores is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .check import CODES

MIN_GAP = 0.15
MIN_SAMPLE = 20
#: Into how many bins an interval of scores is cut, and up to how many distinct scores it needs no cut.
BINS, FEW = 1024, 1024

# Which option a code's threshold belongs to, and codes that are reported as rates.
OPTION_FOR = {
    "REPETITION": "max_repetition", "TAIL_LOOP": "max_tail_loop", "LOW_ENTROPY": "max_compressibility", "TRUNCATED": "max_truncation",
    "SCRIPT_MISMATCH": "max_script_mismatch", "LANG_MISMATCH": "max_lang_mismatch", "PROMPT_ECHO": "max_prompt_echo",
}
CHAR_OPTION_FOR = {"TAIL_LOOP": "max_char_tail_loop"}
RATE_ONLY = ("EMPTY", "TOO_SHORT")


def option_for(code: Column, mode: Column) -> Column:
    """The option that a suggestion for ``code`` and ``mode`` sets; null for codes without one."""
    out = F.lit(None).cast("string")
    for name, option in OPTION_FOR.items():
        out = F.when(code == name, option).otherwise(out)
    for name, option in CHAR_OPTION_FOR.items():
        out = F.when((code == name) & (mode == "char"), option).otherwise(out)
    return out


def long_scores(df: DataFrame, scores: str = "scores", modes: str | None = "modes") -> DataFrame:
    """One row ``(code, mode, score)`` for each finite score; absent scores are skipped, not zero."""
    mode = F.when(F.col("mode_map")[F.col("code")].isin("word", "char"), F.col("mode_map")[F.col("code")]) if modes else F.lit(None).cast("string")
    rows = df.select(F.explode(scores).alias("code", "score"), F.col(modes).alias("mode_map") if modes else F.lit(None).alias("mode_map"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    return rows.where(finite).select("code", mode.alias("mode"), F.col("score").cast("double").alias("score"))


def _gaps(counted: DataFrame, min_width: float) -> DataFrame:
    """The widest gap in the upper half of each group's scores, the first of equals."""
    bins = counted.withColumn("bin", F.floor(F.col("score") / (min_width / 3))).groupBy("code", "mode", "bin").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("n").alias("n"))
    walked = bins.selectExpr(
        "code", "mode", "high as below",
        "lead(low) over (partition by code, mode order by bin) as above",
        "sum(n) over (partition by code, mode order by bin) as upto",
        "sum(n) over (partition by code, mode) as total",
    )
    wide = walked.where(f"above - below >= {min_width} and total >= {MIN_SAMPLE} and upto - 1 >= floor(total / 2)")
    best = wide.groupBy("code", "mode").agg(F.max(F.struct((F.col("above") - F.col("below")).alias("width"), (-F.col("below")).alias("first"), "below", "above", (F.col("total") - F.col("upto")).alias("count"), "total")).alias("gap"))
    return best.select("code", "mode", F.struct("gap.below", "gap.above", "gap.count", (F.col("gap.count") / F.col("gap.total")).alias("share")).alias("gap"))


def exact_percentiles(counted: DataFrame, at: list[float], bins: int = BINS, few: int = FEW) -> dict[tuple, list[float]]:
    """Percentiles of each ``(code, mode)`` of rows ``(code, mode, score, n)``, interpolated between neighbours as ``percentile`` does.

    Intervals that hold a wanted rank are cut into ``bins`` of equal width; of each only the bin with the rank is looked at again, from its least to
    its greatest score.  An interval of at most ``few`` distinct scores is cut into those.
    """
    spark = counted.sparkSession
    groups = counted.groupBy("code", "mode").agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("distinct")).collect()
    places = {(g["code"], g["mode"]): [p * (g["n"] - 1) for p in at] for g in groups}
    found: dict[tuple, float] = {}
    # (code, mode, low, high, distinct scores) to the ranks that are wanted in it: (rank in the group, rank in the interval)
    todo = {tuple(g[c] for c in ("code", "mode", "low", "high", "distinct")): sorted({(k, k) for x in places[g["code"], g["mode"]] for k in (math.floor(x), math.ceil(x))}) for g in groups}
    while todo:
        parts = [(i, *interval[:4], interval[4] <= few, [r for _, r in ranks]) for i, (interval, ranks) in enumerate(todo.items())]
        wanted = spark.createDataFrame(parts, "id int, w_code string, w_mode string, low double, high double, few boolean, ranks array<long>")
        inside = counted.join(F.broadcast(wanted), (F.col("code") == F.col("w_code")) & F.col("mode").eqNullSafe(F.col("w_mode")) & F.col("score").between(F.col("low"), F.col("high")))
        width = F.col("high") / 2 - F.col("low") / 2
        cell = F.when(F.col("few") | (width == 0), F.col("score")).otherwise(F.floor((F.col("score") / 2 - F.col("low") / 2) / width * (bins - 1)).cast("double"))
        cells = inside.groupBy("id", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("distinct"))
        walked = cells.selectExpr("*", "sum(n) over (partition by id order by cell) as upto")  # at most ``bins`` or ``few`` rows each
        hits = walked.join(F.broadcast(wanted.select("id", F.explode("ranks").alias("rank"))), "id").where("upto - n <= rank and rank < upto")
        after: dict[tuple, list] = {}
        names = list(todo)
        for h in hits.collect():
            code, mode = names[h["id"]][:2]
            for k, _ in (x for x in todo[names[h["id"]]] if x[1] == h["rank"]):
                if h["low"] == h["high"]:
                    found[code, mode, k] = h["low"]
                else:
                    after.setdefault((code, mode, h["low"], h["high"], h["distinct"]), []).append((k, h["rank"] - (h["upto"] - h["n"])))
        todo = after

    def between(code: str, mode: str | None, x: float) -> float:
        low, high = found[code, mode, math.floor(x)], found[code, mode, math.ceil(x)]
        return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    return {(code, mode): [between(code, mode, x) for x in xs] for (code, mode), xs in places.items()}


def calibrate_long(rows: DataFrame, false_positive_rate: float = 0.001, min_gap: float = MIN_GAP) -> DataFrame:
    """Summaries of rows ``(code, mode, score)``, most frequent first; a null mode is a group of its own.

    Runs when it is called, a few passes over the counts of distinct scores; the result is one row for each code and mode.
    """
    spark = rows.sparkSession
    counted = rows.groupBy("code", "mode", "score").agg(F.count("*").alias("n")).persist()
    try:
        stats = counted.groupBy("code", "mode").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("score") > 0, F.col("n")).otherwise(0)).alias("non_zero"), F.min("score").alias("min"), F.max("score").alias("max"),
        )
        gaps = _gaps(counted, min_gap).withColumnsRenamed({"code": "g_code", "mode": "g_mode"})
        joined = stats.join(gaps, (F.col("code") == F.col("g_code")) & F.col("mode").eqNullSafe(F.col("g_mode")), "left").drop("g_code", "g_mode")
        at = exact_percentiles(counted, [0.5, 0.9, 0.99, 0.999, 1 - false_positive_rate])
        known = [(*r, at[r["code"], r["mode"]]) for r in joined.collect()]  # one row for each code and mode
    finally:
        counted.unpersist()
    both = spark.createDataFrame(known, T.StructType([*joined.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))]))
    tail = F.col("n") * false_positive_rate
    needed = f"{-(-10 // false_positive_rate):.0f}"
    caveats = F.array_compact(F.array(
        F.when(tail < 10, F.concat(F.lit("only about "), F.round(tail).cast("long").cast("string"), F.lit(f" scores lie in the share of {false_positive_rate * 100:.2f}% that decides: log {needed} verdicts or more"))),
        F.when(F.col("max") == 0, "every score is 0: there is nothing to calibrate").when(F.col("p")[0] == F.col("max"), "the distribution is a single value"),
        F.when(F.col("gap").isNull(), "the upper scores show no gap: the suggestion only limits how much is flagged").when(
            F.col("gap.count") < 5, F.concat(F.lit("only "), F.col("gap.count").cast("string"), F.lit(" scores lie above the gap: look at them"))
        ),
    ))
    suggested = F.round(F.coalesce((F.col("gap.below") + F.col("gap.above")) / 2, F.col("p")[4]), 3)
    out = both.select(
        "code", "mode", "n", "non_zero", "min", "max", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p90", "p99", "p999"))],
        "gap", suggested.alias("suggested"), caveats.alias("caveats"), option_for(F.col("code"), F.col("mode")).alias("option"), F.col("code").isin(*RATE_ONLY).alias("rate_only"),
    )
    return out.orderBy(F.desc("n"), "code", "mode")


def calibrate(df: DataFrame, scores: str = "scores", modes: str | None = "modes", false_positive_rate: float = 0.001) -> DataFrame:
    """``calibrate_long`` of rows that hold maps of scores and modes."""
    known = df.withColumn(scores, F.map_filter(scores, lambda k, v: k.isin(*CODES)))
    return calibrate_long(long_scores(known, scores, modes), false_positive_rate)


def margins(rows: DataFrame, floor: float = 0.05, safe: float = 0.2) -> DataFrame:
    """How far apart healthy and degenerate scores are, for rows ``(code, mode, score, bad)``.

    ``healthy_max`` is the greatest score of a good row, ``degenerate_min`` the least above ``floor`` of a bad one.
    """
    both = rows.groupBy("code", "mode").agg(
        F.coalesce(F.max(F.when(~F.col("bad"), F.col("score"))), F.lit(0.0)).alias("healthy_max"),
        F.min(F.when(F.col("bad") & (F.col("score") > floor), F.col("score"))).alias("degenerate_min"),
    )
    margin = F.col("degenerate_min") - F.col("healthy_max")
    return both.withColumns({"margin": margin, "safe": margin > safe, "midpoint": (F.col("degenerate_min") + F.col("healthy_max")) / 2})
