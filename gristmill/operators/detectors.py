"""Detectors: each takes a text ``Column`` and gives a score from 0 (healthy) to 1.

All are built-in expressions but for ``compression_ratio``, whose greedy parse depends on
itself from left to right and runs as an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import is_complete_document
from ..functions.text import CHAR_MODE, SPACES, clamp01, last_non_spaces, last_words, let, non_spaced_ratio, runs, strip_non_linguistic, trim, words
from ..functions.text import chars as characters

# Stop reasons that mean a length limit, final characters, scripts and function words.
LENGTH_STOPS = ("length", "max_tokens", "maxtokens", "max_output_tokens", "token_limit")
TERMINAL = r""".!?"'`’”)\]}:;。！？"""
SCRIPTS = {
    "latin": r"\p{IsLatin}",
    "han": r"\p{IsHan}",
    "kana": r"\p{IsHiragana}\p{IsKatakana}",
    "hangul": r"\p{IsHangul}",
    "cyrillic": r"\p{IsCyrillic}",
    "arabic": r"\p{IsArabic}",
    "devanagari": r"\p{IsDevanagari}",
    "greek": r"\p{IsGreek}",
    "hebrew": r"\p{IsHebrew}",
    "thai": r"\p{IsThai}",
}
LANGUAGES = {
    "id": "yang dan di untuk dengan ini itu dari pada tidak adalah akan bisa kita saya atau juga dalam sudah ke".split(),
    "en": "the and of to in is that for it with as this are be you on not or can we".split(),
    "es": "el los las y es no muy pero este esta sus cuando donde porque sin hasta aunque mismo otro todos".split(),
    "pt": "não é são uma com em do da dos das ao você também muito mais já pelo isso seu sua".split(),
    "it": "il di che non per della nel nella gli più anche perché questo sono essere dei delle agli però sia".split(),
    "fr": "les des du qui dans pour sur pas ce est plus nous vous avec cette aux être mais leur tout".split(),
    "de": "der die das und ist nicht ein eine sich mit den für auf von dem werden oder auch wird kann".split(),
    "nl": "het een niet zijn worden maar deze wordt ook naar bij over door tussen omdat moet kan heeft dat van".split(),
}
#: Tokens per character of natural language; up to which length matches are told by sorting, and from how many tokens per character on.
PIVOT, TOLD, REPEATS = 0.32, 6, 0.1
_PLACE = (1 << 30) - 1
SUPPORTED_SCRIPTS, SUPPORTED_LANGUAGES = tuple(SCRIPTS), tuple(LANGUAGES)


def emptiness_score(text: Column) -> Column:
    """1 for a text with no content: blank, without words, or only fences, brackets and punctuation."""
    bare = trim(text)
    rest = F.when(bare.contains("```"), F.regexp_replace(bare, F.lit(rf"(?i)```[a-z]*[{SPACES}]*```"), F.lit(""))).otherwise(bare)
    rest = trim(F.regexp_replace(rest, F.lit(rf"""\A[{{}}\[\]"'{SPACES},.:;!?-]+\z"""), F.lit("")))
    # a letter or digit early in a text without fences is content, which spares most texts the rest
    early = F.substring(text, 1, 200).rlike(r"[\p{L}\p{N}]") & ~text.contains("```")
    return F.when(early, F.lit(0.0)).when(~bare.rlike(r"[\p{L}\p{N}']") | (rest == ""), F.lit(1.0)).otherwise(F.lit(0.0))


def shortness_score(text: Column, least: int) -> Column:
    """How far the trimmed text falls short of ``least`` characters."""
    if least <= 0:
        return F.lit(0.0)
    # a beginning that is long enough tells; trimming costs time with a text's length
    enough = F.length(trim(F.substring(text, 1, 2 * least))) >= least
    return F.when(enough, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.length(trim(text)) / F.lit(least)))


def repetition_of_words(tokens: Column, n: int = 3) -> Column:
    """Share of duplicates among runs of ``n`` words; 0 below ``4 * n`` words."""
    score = 1 - F.size(F.array_distinct(runs(tokens, n))) / F.greatest(F.size(tokens) - (n - 1), F.lit(1))
    return F.when(F.size(tokens) < 4 * n, F.lit(0.0)).otherwise(score)


def repetition_score(text: Column, n: int = 3, max_sample: int = 8000) -> Column:
    """``repetition_of_words`` of the first ``max_sample`` characters."""
    return let(words(F.substring(text, 1, max_sample)), lambda w: repetition_of_words(w, n))


def periodic_coverage(tail: Column, max_period: int, min_repeats: int = 3) -> Column:
    """Greatest share of ``tail`` covered by copies of its last block, over all periods."""

    def of(r: Column) -> Column:
        n = F.size(r)
        cap = F.least(F.lit(max_period), F.floor(n / min_repeats).cast("int"))
        same = [lambda p, k=k: F.slice(r, F.lit(1), p) == F.slice(r, k * p + 1, p) for k in range(1, min_repeats)]
        # most periods already fail at the first element, without a slice
        first = lambda p: F.get(r, p) == F.get(r, F.lit(0))
        periods = F.filter(F.sequence(F.lit(1), F.greatest(cap, F.lit(1))), lambda p: _all([first(p), *(s(p) for s in same)]))

        def cover(p: Column) -> Column:
            agree = F.transform(F.sequence(F.lit(1), n - p), lambda i: F.get(r, i - 1) == F.get(r, i + p - 1))
            run = F.coalesce(F.nullif(F.array_position(agree, False), F.lit(0)) - 1, (n - p).cast("long"))
            return F.least(F.lit(1.0), (1 + F.floor(run / p)) * p / n)

        best = F.coalesce(F.array_max(F.transform(periods, cover)), F.lit(0.0))
        return F.when(n < 2 * min_repeats, F.lit(0.0)).otherwise(best)

    return let(F.reverse(tail), of)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def tail_loop_detail(
    text: Column, mode: str | None = None, non_spaced_cutoff: float = 0.5, tail_words: int = 200, max_period: int = 40, min_repeats: int = 3,
    tail_chars: int = 400, max_char_period: int = 80, min_char_sample: int = 80, tokens: Column | None = None,
) -> Column:
    """``struct(score, mode)``: whether the text ends in a loop, over words or, in scripts without spaces, over characters."""
    tokens = last_words(text, tail_words) if tokens is None else tokens

    def last(items: Column, n: int) -> Column:
        return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))

    def of(tail: Column) -> Column:
        chosen = F.lit(mode) if mode else F.when(non_spaced_ratio(tail) >= non_spaced_cutoff, "char").otherwise("word")
        by_char = F.when(F.length(tail) < min_char_sample, F.lit(0.0)).otherwise(periodic_coverage(characters(tail), max_char_period, min_repeats))
        by_word = periodic_coverage(last(tokens, tail_words), max_period, min_repeats)
        return F.struct(F.when(chosen == CHAR_MODE, by_char).otherwise(by_word).alias("score"), chosen.alias("mode"))

    return let(last_non_spaces(text, tail_chars), of)


def tail_loop_score(text: Column, **options: object) -> Column:
    """The score of ``tail_loop_detail``."""
    return tail_loop_detail(text, **options)["score"]


def _codes(s: str) -> np.ndarray | None:
    """A byte for each character; none where there are over 256 different ones."""
    try:
        return np.frombuffer(s.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        chars = np.frombuffer(s.encode("utf-16-le", "surrogatepass"), "<u2")
    known = np.zeros(1 << 16, bool)
    known[chars] = True
    used = np.flatnonzero(known)
    if len(chars) != len(s) or len(used) > 256:
        return None
    place = np.zeros(1 << 16, np.uint8)
    place[used] = np.arange(len(used))
    return place[chars]


def _fours(codes: np.ndarray) -> np.ndarray:
    """All runs of four characters in order, each with its place in the lower 30 bits."""
    m = len(codes) - 3
    runs = np.ndarray((m,), "<u4", codes.tobytes(), strides=(1,)).astype(np.int64)
    return np.sort(runs << 30 | np.arange(m))


def _new_starts(found: np.ndarray, window: int) -> int:
    m = len(found)
    new = np.ones(m + 2, np.int8)
    new[0] = new[-1] = 0
    # the same four characters again within the window: only their places differ
    new[(found[1:][np.diff(found) <= window] & _PLACE) + 1] = 0
    turns = np.flatnonzero(np.diff(new))
    return int(np.maximum(turns[1::2] - turns[::2] - 2, 0).sum())


def _least_tokens(s: str, window: int, min_match: int) -> int:
    """Tokens that a greedy parse has at least.

    Four characters are new where they don't begin within ``window`` places before.  No match holds new ones, so of a run of ``r`` places
    where new ones begin the first three at most end a match, the others are literals, and another token begins behind them.
    """
    codes = _codes(s) if min_match == 4 and 4 <= len(s) < 1 << 20 and window < 1 << 30 else None
    return 0 if codes is None else _new_starts(_fours(codes), window)


def _matches(codes: np.ndarray, found: np.ndarray, window: int) -> list[int]:
    """How many characters match at each place at most, of matches of four to ``TOLD`` characters; 1 where none does."""
    lengths, size = np.ones(len(codes), np.int64), 4
    while len(found) > 1:
        near = np.diff(found) <= window
        lengths[found[1:][near] & _PLACE] = size
        if size == TOLD:
            break
        # what is near nothing has no longer match and is none
        kept = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        run, place = np.concatenate([[0], np.cumsum(~near)])[kept], found[kept] & _PLACE
        run, place = run[place + size < len(codes)], place[place + size < len(codes)]
        found = np.sort((run << 8 | codes[place + size]) << 30 | place)
        size += 1
    return lengths.tolist()


def lz_ratio(text: str, window: int = 1024, max_sample: int = 4000, min_match: int = 4, longest: int = 255, enough: float = float("inf")) -> float:
    """Tokens per character of a greedy parse into literals and matches that begin within ``window`` characters before.

    Once there are ``enough`` tokens per character of the whole, that many are returned: more can only come.  Most prose is told from
    its new starts of matches, without a parse.

    Short matches are told for all places at once, by sorting runs of characters.  Of others, and where there are too many different characters, the first
    place is found by substring search and the match extended; a longer one must begin later, so the search for one character more goes on from there.
    """
    s = text[:max_sample]
    n = len(s)
    if n < 64:
        return 1.0
    codes = _codes(s) if min_match == 4 and longest >= TOLD and n < 1 << 20 and window < 1 << 30 else None
    told = None
    if codes is not None:
        found = _fours(codes)
        least = _new_starts(found, window) / n
        if least >= enough:
            return least
        # where little is new, matches are long and are found faster one by one
        told = _matches(codes, found, window) if least >= REPEATS else None
    find, at, tokens = s.find, 0, 0
    while at <= n - min_match:
        if tokens / n >= enough:
            return tokens / n
        tokens += 1
        if told is not None and told[at] < TOLD:
            at += told[at]
            continue
        good, most = min_match if told is None else TOLD, min(longest, n - at)
        place = find(s[at : at + good], at - window if at > window else 0, at + good - 1)
        if place < 0:
            at += 1
            continue
        while True:
            while good + 16 <= most and s[place + good : place + good + 16] == s[at + good : at + good + 16]:
                good += 16
            while good < most and s[place + good] == s[at + good]:
                good += 1
            if good >= most or (place := find(s[at : at + good + 1], place + 1, at + good)) < 0:
                break
            good += 1
        at += good
    return (tokens + n - at) / n


@F.pandas_udf(T.DoubleType())
def _lz_ratio(texts: pd.Series) -> pd.Series:
    known: dict[str, float] = {}
    return texts.map(lambda t: None if t is None else known[t] if t in known else known.setdefault(t, lz_ratio(t)))


@F.pandas_udf(T.DoubleType())
def _lz_ratio_below(texts: pd.Series, enough: pd.Series) -> pd.Series:
    known: dict[str, float] = {}
    return pd.Series([None if t is None else known[t] if t in known else known.setdefault(t, lz_ratio(t, enough=e)) for t, e in zip(texts, enough)], dtype="float64")


def compression_ratio(text: Column) -> Column:
    """``lz_ratio`` of the text; null for null.  Only the characters it reads go to Python."""
    return _lz_ratio(F.substring(text, 1, 4000))


def compressibility_of(ratio: Column, text: Column, pivot: float = PIVOT) -> Column:
    """``compressibility_score`` of a ratio, exact below ``pivot``."""
    return F.when((text.isNotNull() & (ratio >= pivot)) | (F.length(trim(text)) < 64), F.lit(0.0)).otherwise(clamp01(1 - ratio / pivot))


def compressibility_score(text: Column, pivot: float = PIVOT) -> Column:
    """How far the ratio falls below ``pivot``; 0 for texts of fewer than 64 characters."""
    return compressibility_of(_lz_ratio_below(F.substring(text, 1, 4000), F.lit(pivot)), text, pivot)


def truncation_score(text: Column, finish_reason: Column | str | None = None, complete: Column | None = None) -> Column:
    """1 if the provider stopped for length, 0 for complete JSON, else the worst of fence, bracket and final-character signs."""

    def signs(bare: Column) -> Column:
        count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
        unclosed = (count("{") > count("}")) | (count("[") > count("]")) | (count("(") > count(")"))
        ended = F.right(bare, F.lit(1)).rlike(f"[{TERMINAL}]")
        fences = (F.length(bare) - F.length(F.replace(bare, F.lit("```"), F.lit("")))) / 3
        return F.when(fences % 2 == 1, F.lit(0.9)).when(unclosed, F.lit(0.8)).when(~ended, F.lit(0.55)).otherwise(F.lit(0.0))

    complete = is_complete_document(text) if complete is None else complete
    score = F.when((trim(text) == "") | complete, F.lit(0.0)).otherwise(let(trim(text), signs))
    if finish_reason is None:
        return score
    reason = F.lit(finish_reason) if isinstance(finish_reason, str) else finish_reason
    return F.when(F.coalesce(F.lower(reason).isin(*LENGTH_STOPS), F.lit(False)), F.lit(1.0)).otherwise(score)


def _letters(text: Column, ignore_code: bool, max_sample: int) -> Column:
    head = F.substring(text, 1, max_sample)
    head = strip_non_linguistic(head) if ignore_code else head
    return F.regexp_replace(head, F.lit(r"[^\p{L}\p{M}]+|[\p{IsCommon}\p{IsInherited}]+"), F.lit(""))


def _of_class(letters: Column, chosen: str) -> Column:
    return F.length(F.regexp_replace(letters, F.lit(f"[^{chosen}]+"), F.lit("")))


def script_profile(text: Column, ignore_code: bool = True, max_sample: int = 8000) -> Column:
    """Map of script to its share of letters, and ``other``; empty without letters."""

    def of(letters: Column) -> Column:
        n = F.greatest(F.length(letters), F.lit(1))
        hits = {name: _of_class(letters, c) for name, c in SCRIPTS.items()}
        shares = [x for name, h in hits.items() for x in (F.lit(name), h / n)]
        other = (n - sum(hits.values(), F.lit(0))) / n
        return F.when(F.length(letters) == 0, F.expr("cast(map() as map<string, double>)")).otherwise(F.create_map(*shares, F.lit("other"), other))

    return let(_letters(text, ignore_code, max_sample), of)


def script_mismatch_of(letters: Column, hits: Column, min_letters: int = 12) -> Column:
    """``script_mismatch_score`` of numbers of letters."""
    return F.when(letters < min_letters, F.lit(0.0)).otherwise(clamp01(1 - hits / F.greatest(letters, F.lit(1))))


def script_mismatch_score(text: Column, expected: str | list[str], min_letters: int = 12, ignore_code: bool = True, max_sample: int = 8000) -> Column:
    """Share of letters outside the expected scripts; 0 for unknown names or too few letters."""
    known = [SCRIPTS[s] for s in ([expected] if isinstance(expected, str) else expected) if s in SCRIPTS]
    if not known:
        return F.lit(0.0)
    return let(_letters(text, ignore_code, max_sample), lambda x: script_mismatch_of(F.length(x), _of_class(x, "".join(known)), min_letters))


def _share(tokens: Column, language: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(LANGUAGES[language]))) / F.greatest(F.size(tokens), F.lit(1))


def language_profile(text: Column, tokens: Column | None = None) -> Column:
    """Map of language to the share of its function words; empty without words."""
    of = lambda w: F.when(F.size(w) == 0, F.expr("cast(map() as map<string, double>)")).otherwise(F.create_map(*[x for name in LANGUAGES for x in (F.lit(name), _share(w, name))]))
    return let(words(text) if tokens is None else tokens, of)


def language_mismatch_of(shares: dict[str, Column], n_words: Column, expected: str | Column, min_words: int = 25) -> Column:
    """``language_mismatch_score`` of each language's share of function words."""
    best = F.greatest(*shares.values())
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    target = F.coalesce(*[F.when(wanted == name, share) for name, share in shares.items()])
    score = F.when(target.isNull() | (best == 0) | (target >= best), F.lit(0.0)).otherwise(F.least(F.lit(1.0), (best - target) / best))
    return F.when(n_words < min_words, F.lit(0.0)).otherwise(score)


def language_mismatch_score(text: Column, expected: str | Column, min_words: int = 25, tokens: Column | None = None) -> Column:
    """How much better another language's function words fit than the expected one's; 0 if unknown or too short."""
    if isinstance(expected, str) and expected not in LANGUAGES:
        return F.lit(0.0)
    of = lambda w: language_mismatch_of({name: _share(w, name) for name in LANGUAGES}, F.size(w), expected, min_words)
    return let(words(text) if tokens is None else tokens, of)


def prompt_echo_detail(
    text: Column, prompt: Column | str | None, n: int = 5, char_n: int = 12, min_tokens: int = 40, mode: str | None = None, non_spaced_cutoff: float = 0.5, max_sample: int = 8000
) -> Column:
    """``struct(score, mode)``: share of the output's runs that also stand in the prompt."""
    head = F.substring(text, 1, max_sample)
    chosen = F.lit(mode) if mode else F.when(non_spaced_ratio(head) >= non_spaced_cutoff, "char").otherwise("word")
    if prompt is None:
        return F.struct(F.lit(0.0).alias("score"), chosen.alias("mode"))
    given = F.substring(F.lit(prompt) if isinstance(prompt, str) else prompt, 1, max_sample)

    def score(tokens, size: int) -> Column:
        def of(both: Column) -> Column:
            found = let(F.struct(runs(both["out"], size).alias("out"), runs(both["src"], size).alias("src")), lambda x: F.struct(x["out"].alias("out"), F.array_intersect(x["out"], x["src"]).alias("common")))
            hits = let(found, lambda x: F.size(F.filter(x["out"], lambda r: F.array_contains(x["common"], r))))
            few = (F.size(both["out"]) < max(min_tokens, size)) | (F.size(both["src"]) < size)
            return F.when(few, F.lit(0.0)).otherwise(clamp01(hits / F.greatest(F.size(both["out"]) - (size - 1), F.lit(1))))

        return let(F.struct(tokens(head).alias("out"), tokens(F.coalesce(given, F.lit(""))).alias("src")), of)

    return F.struct(F.when(chosen == CHAR_MODE, score(characters, char_n)).otherwise(score(words, n)).alias("score"), chosen.alias("mode"))


def prompt_echo_score(text: Column, prompt: Column | str | None, **options: object) -> Column:
    """The score of ``prompt_echo_detail``."""
    return prompt_echo_detail(text, prompt, **options)["score"]
