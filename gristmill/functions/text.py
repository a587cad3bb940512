"""Text functions: ``Column`` to ``Column``, evaluated in the JVM.

White space is the Unicode set below everywhere, and lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, and the scripts written without spaces.
SPACES = r"\t\n\x0B\f\r    -     　﻿"
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NON_SPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"

WORD_MODE, CHAR_MODE = "word", "char"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, evaluated once for each row.

    A one-row generator keeps the optimizer from copying them into later filters and projections, which would
    evaluate costly expressions again wherever they are used.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def trim(text: Column) -> Column:
    """Without white space at either end."""
    return F.trim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def without_spaces(text: Column) -> Column:
    """The text with all white space deleted."""
    return F.translate(text, SPACE_CHARS, "")


def chars(text: Column) -> Column:
    """Code points that are not white space."""
    bare = without_spaces(text)
    return F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, ""))


def last_words(text: Column, n: int, reach: int = 4000) -> Column:
    """The last ``n`` words, or more; of a long text only the last ``reach`` characters are taken apart if they hold enough.

    The text is lower-cased whole, since a final sigma depends on what stands before it; the first word of the end may be cut and isn't counted.
    """
    split = lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    end = lambda x: let(split(F.right(x, F.lit(reach))), lambda w: F.when(F.size(w) > n, w).otherwise(split(x)))
    return let(F.lower(text), lambda x: F.when(F.length(x) > reach, end(x)).otherwise(split(x)))


def last_non_spaces(text: Column, n: int, reach: int = 1000) -> Column:
    """The last ``n`` code points that are not white space; a long text is not searched beyond where enough of them are found."""
    short = lambda x: F.when((F.length(x) >= n) | (F.length(text) <= reach), x).otherwise(without_spaces(text))
    return F.right(let(without_spaces(F.right(text, F.lit(reach))), short), F.lit(n))


def _count(text: Column, chosen: str) -> Column:
    """How many code points of ``text`` are in a character class."""
    return F.length(F.regexp_replace(text, F.lit(f"[^{chosen}]+"), F.lit("")))


def non_spaced_ratio(text: Column) -> Column:
    """Share of letters and marks in scripts written without spaces; 0 without letters."""
    total = _count(text, r"\p{L}\p{M}")
    # those scripts begin at U+0E00; asking for a script is costly
    return F.when(~text.rlike(r"[\x{0E00}-\x{10FFFF}]") | (total == 0), F.lit(0.0)).otherwise(_count(text, NON_SPACED) / F.greatest(total, F.lit(1)))


def token_mode(text: Column, cutoff: float = 0.5) -> Column:
    """``char`` where the non-spaced share reaches ``cutoff``, else ``word``."""
    return F.when(non_spaced_ratio(text) >= cutoff, CHAR_MODE).otherwise(WORD_MODE)


def clamp01(value: Column) -> Column:
    """The value within 0 and 1; 0 for NaN, null for null."""
    return F.when(F.isnan(value), F.lit(0.0)).when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def excerpt(text: Column, most: int = 80) -> Column:
    """White space collapsed, ends trimmed, and cut with an ellipsis after ``most`` characters."""
    flat = trim(F.regexp_replace(text, F.lit(f"[{SPACES}]+"), F.lit(" ")))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def strip_non_linguistic(text: Column) -> Column:
    """Fenced blocks, an open fence to the end, inline code and URLs, each replaced by a space."""
    def stripped(x: Column) -> Column:
        bare = x
        for pattern in (r"(?s)```.*?```", r"(?s)```.*\z", r"`[^`\n]*`", rf"(?i)\bhttps?://[^{SPACES}]+"):
            bare = F.regexp_replace(bare, F.lit(pattern), F.lit(" "))
        return F.when(x.contains("`") | x.contains("://"), bare).otherwise(x)

    return let(text, stripped)


def runs(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces; none if there are fewer tokens."""
    none = F.expr("cast(array() as array<string>)")

    def of(w: Column) -> Column:
        joined = lambda x, i: F.concat(x, *[part for k in range(1, n) for part in (F.lit(" "), F.get(w, i + k))])
        many = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), joined)
        return F.when(F.size(w) < n, none).otherwise(many)

    return let(tokens, of)
