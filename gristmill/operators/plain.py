"""Texts of plain letters, read once in Python.

Where a verdict sends texts to Python anyway, one pass there over texts in Latin or Cyrillic letters finds what several detectors count, which
costs less than expressions over arrays of words.  Texts with other characters, and ends that may loop, get null and are left to the detectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .detectors import LANGUAGES, PIVOT, lz_ratio

#: Characters whose class and lower case are the same in every version of Unicode that Python or the JVM may have; texts with others are not judged here.
KNOWN = frozenset(chr(c) for a, b in ((0, 0x12F), (0x131, 0x2FF), (0x400, 0x481), (0x48A, 0x52F), (0x2010, 0x2027), (0x20AC, 0x20AC)) for c in range(a, b + 1))
# Those of ``tail_loop_detail``, and the characters that repetition and script are measured on.
TAIL_WORDS, MAX_PERIOD, MIN_REPEATS, MAX_SAMPLE = 200, 40, 3, 8000
_SPEAKS = {w: [i for i, known in enumerate(LANGUAGES.values()) if w in known] for known in LANGUAGES.values() for w in known}
_COUNTS = "repetition double, steady boolean, n_words int, by_language array<int>, letters int, in_script int"
# For each 16-bit unit what it is in ``lowered``, and 0xFFFF for those that aren't known.
_LOWERED = np.full(1 << 16, 0xFFFF, "<u2")
for _c in KNOWN:
    _LOWERED[ord(_c)] = ord(_c.lower() if _c.isalnum() or _c in "' " else " ")


def lowered(text: str) -> str | None:
    """``spaced`` of all characters of the text; null where some aren't known."""
    units = _LOWERED[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")]
    return None if (units == 0xFFFF).any() else units.tobytes().decode("utf-16-le")


def spaced(text: str, used: set[str]) -> str:
    """The text in lower case with a space for each character that is in no word."""
    plain = text.lower()
    for c in used:
        if not (c.isalnum() or c in "' "):
            plain = plain.replace(c, " ")
    return plain


def repeats_at_end(tail: list[str]) -> bool:
    """Whether a block of words, last word first, stands three times there."""
    return any(tail[p] == tail[0] and tail[:p] == tail[p : 2 * p] == tail[2 * p : 3 * p] for p in range(1, min(MAX_PERIOD, len(tail) // MIN_REPEATS) + 1))


def _letters(text: str, used: set[str], scripts: tuple[str, ...]) -> tuple[int | None, int | None]:
    """Letters, and those of the scripts; none where some may be code or an address, or are of a script that isn't told here."""
    if "`" in used or "://" in text:
        return None, None
    head, letters, found = text[:MAX_SAMPLE], 0, 0
    for c in used:
        if c.isalpha():
            script = "cyrillic" if c >= "Ѐ" else "latin" if c < "\x80" or "\xc0" <= c <= "ɏ" else None
            if script is None:
                return None, None
            n = head.count(c)
            letters, found = letters + n, found + (n if script in scripts else 0)
    return letters, found


def counts(text: str | None, ngram: int, languages: bool, scripts: tuple[str, ...]) -> tuple:
    """What ``_COUNTS`` names, of one text; nulls where it isn't told here."""
    if text is None or (plain := lowered(text)) is None:
        return (None,) * 6
    words = plain.split()
    head = words if len(text) <= MAX_SAMPLE else plain[:MAX_SAMPLE].split()
    repetition = 0.0 if len(head) < 4 * ngram else 1 - len(set(zip(*(head[k:] for k in range(ngram))))) / max(len(head) - (ngram - 1), 1)
    by_language = None
    if languages:
        by_language = [0] * len(LANGUAGES)
        for w in words:
            if w in _SPEAKS:
                for i in _SPEAKS[w]:
                    by_language[i] += 1
    return (repetition, not repeats_at_end(words[: -TAIL_WORDS - 1 : -1]), len(words), by_language, *(_letters(text, set(text), scripts) if scripts else (None, None)))


def read_plain(text: Column, ngram: int, languages: bool, scripts: tuple[str, ...], among: Column | None = None) -> Column:
    """``struct(repetition, steady, n_words, by_language, letters, in_script, ratio)``; all but ``ratio`` null where the text isn't told here.

    ``ratio`` is the text's ``lz_ratio``, exact below ``PIVOT``, of the rows ``among`` which it is asked.
    """
    asked = F.lit(True) if among is None else F.coalesce(among, F.lit(False))

    @F.pandas_udf(f"{_COUNTS}, ratio double")
    def of(texts: pd.Series, others: pd.Series, asked: pd.Series) -> pd.DataFrame:
        ratios: dict[str, float] = {}
        found: dict[str, tuple] = {}
        rows = []
        for text, other, wanted in zip(texts, others, asked):
            if (counted := found.get(text)) is None:
                counted = found[text] = counts(text, ngram, languages, scripts)
            ratio, read = None, other if text is None else text
            if wanted and read is not None and (ratio := ratios.get(read)) is None:
                ratio = ratios[read] = lz_ratio(read, enough=PIVOT)
            rows.append((*counted, ratio))
        names = [part.split()[0] for part in _COUNTS.split(", ")]
        return pd.DataFrame(rows, columns=[*names, "ratio"]).astype({"n_words": "Int32", "letters": "Int32", "in_script": "Int32", "steady": "boolean", "ratio": "float64"})

    valid = F.is_valid_utf8(text)
    return of(F.when(valid, text), F.when(~valid, F.substring(text, 1, 4000)), asked)
