"""Windows that surely pass.

A window of prose is told from a degenerate one by its words alone, and that is cheaper than measuring it; the words of a text are
found once for all its windows.  A window is left out only where the detectors could not fail; every other one goes to them, so verdicts are theirs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.check import CheckOptions
from ..operators.plain import KNOWN, MAX_PERIOD, MAX_SAMPLE, TAIL_WORDS, repeats_at_end, spaced


def surely_pass(text: str, places: list[int], window: int, o: CheckOptions) -> list[bool]:
    """Whether the last ``window`` characters before each place have content, too few repeated runs of words to fail, and no block of words three times at their end."""
    used = set(text)
    # backquotes may be fences, and what is between them no content
    if not places or window > MAX_SAMPLE or "`" in used or not used <= KNOWN or o.redundancy_scope == "jsonValues" or o.non_spaced_cutoff <= 0 or (o.max_tail_loop or 0) < 0:
        return [False] * len(places)
    plain = spaced(text, used)
    words = plain.split()
    blank = np.frombuffer(plain.encode("utf-16-le"), "<u2") == 32
    at = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    starts = at.tolist()
    runs = list(zip(*(words[k:] for k in range(o.ngram)))) if o.max_repetition is not None else []
    # no window has more repeated runs than the text, which spares most texts a count for each
    again = len(runs) - len(set(runs))
    first, last = np.searchsorted(at, [max(0, p - window) for p in places]).tolist(), np.searchsorted(at, places).tolist()

    def passes(place: int, i: int, j: int) -> bool:
        cut = plain[max(0, place - window) : starts[i] if i < j else place].strip()
        n = j - i + bool(cut)
        if i == j or not any(c.isalnum() for c in (words[i] if j - i > 1 else plain[starts[i] : place])):
            return False
        if o.max_repetition is not None and n >= 4 * o.ngram:
            # runs with a word that the window cuts aren't counted, so there may be more
            whole, most = max(0, j - o.ngram - i), max(n - (o.ngram - 1), 1)
            if 1 - (whole - again) / most > o.max_repetition and 1 - len(set(runs[i : i + whole])) / most > o.max_repetition:
                return False
        if o.max_tail_loop is None:
            return True
        end = plain[starts[j - 1] : place].strip()
        if end != cut and end not in words[max(i, j - 1 - MAX_PERIOD) : j - 1]:
            return True
        return not repeats_at_end([end, *words[max(i, j - TAIL_WORDS) : j - 1][::-1], *([cut] if cut else [])][:TAIL_WORDS])

    return [passes(p, i, j) for p, i, j in zip(places, first, last)]


def doubtful(text: Column, positions: Column, window: int, o: CheckOptions) -> Column:
    """Those of the positions whose windows may fail; all of them where the text isn't valid."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series, places: pd.Series) -> pd.Series:
        left = lambda t, at: [p for p, passes in zip(at, surely_pass(t, at, window, o)) if not passes]
        return pd.Series([None if t is None else left(t, at.tolist()) for t, at in zip(texts, places)], dtype=object)

    # short texts have no windows and aren't sent
    return F.when(F.size(positions) == 0, positions).otherwise(F.coalesce(of(F.when(F.is_valid_utf8(text) & (F.size(positions) > 0), text), positions), positions))
