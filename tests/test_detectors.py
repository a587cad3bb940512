"""Detectors against plain Python models and hand-made texts."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from gristmill.functions import text as t
from gristmill.operators import detectors as d

LOOP = "The answer is that the answer is what it was. " * 40
PROSE = (
    "Rain fell over the harbour while two old boats drifted home. A keeper lit the lamp, counted the waves and wrote the number down. "
    "Nobody asked why; on that coast people kept such books for their children. Later a storm took the pier, but the numbers stayed dry."
)


def scores(spark, texts, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").select("i", column(F.col("text")).alias("s"))
    return [r["s"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def words(x):
    return regex.findall(r"[\p{L}\p{N}']+", x.lower())


def samples(n=120, seed=1):
    r = random.Random(seed)
    alphabet = ["one", "two", "three", "Four's", "été", "好", "ひ", ".", ",", " ", "\n", " ", "```", "{", "}", "(", "x9", "﻿"]
    texts = []
    for _ in range(n):
        block = [r.choice(alphabet) for _ in range(r.randint(1, 12))]
        texts.append(" ".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) + " ".join(block * r.randint(0, 40)))
    return [*texts, "", " ", "　﻿", "'", PROSE, LOOP]


def repetition(x, n=3):
    w = words(x[:8000])
    if len(w) < 4 * n:
        return 0.0
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    return 1 - len(set(grams)) / len(grams)


def coverage(tail, most, least=3):
    best = 0.0
    if len(tail) < 2 * least:
        return best
    for p in range(1, min(most, len(tail) // least) + 1):
        copies, at = 1, len(tail) - p
        while at - p >= 0 and tail[at - p : at] == tail[len(tail) - p :]:
            copies, at = copies + 1, at - p
        if copies >= least:
            best = max(best, min(1.0, copies * p / len(tail)))
    return best


def lz(s, window=1024, least=4, longest=255):
    s, at, n = s[:4000], 0, 0
    if len(s) < 64:
        return 1.0
    while at < len(s):
        best = 0
        for j in range(max(0, at - window), at):
            k = 0
            while k < longest and at + k < len(s) and s[j + k] == s[at + k]:
                k += 1
            best = max(best, k)
        at, n = at + (best if best >= least else 1), n + 1
    return n / len(s)


def test_words_and_repetition_equal_the_model(spark):
    texts = samples()
    assert scores(spark, texts, t.words) == [words(x) for x in texts]
    assert scores(spark, texts, d.repetition_score) == pytest.approx([repetition(x) for x in texts])
    assert scores(spark, texts, lambda c: d.repetition_score(c, n=5)) == pytest.approx([repetition(x, 5) for x in texts])


def test_tail_loop_equals_the_model(spark):
    texts = samples(seed=2)
    assert scores(spark, texts, lambda c: d.tail_loop_score(c, mode="word")) == pytest.approx([coverage(words(x)[-200:], 40) for x in texts])
    bare = [re.sub(r"[\s﻿]+", "", x)[-400:] for x in texts]
    assert scores(spark, texts, lambda c: d.tail_loop_score(c, mode="char")) == pytest.approx([coverage(list(x), 80) if len(x) >= 80 else 0 for x in bare])


def test_tail_loop_chooses_its_mode(spark):
    found = scores(spark, ["我在这里等你回来。" * 30, LOOP, ""], d.tail_loop_detail)
    assert [(r["mode"], r["score"]) for r in found] == [("char", 1.0), ("word", 1.0), ("word", 0.0)]


def test_compression_ratio_equals_the_naive_parse(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab ") for _ in range(n)) for n in (10, 63, 64, 200, 700)] + [PROSE, LOOP[:900], "x" * 500, "abcdefghij" * 50, ""]
    assert scores(spark, texts, d.compression_ratio) == pytest.approx([lz(x) for x in texts])
    low = scores(spark, [PROSE, "x" * 500, "x" * 20, None], d.compressibility_score)
    assert low[0] == 0 and low[1] > 0.9 and low[2] == 0 and low[3] is None


def test_emptiness_and_shortness(spark):
    texts = ["", " ﻿　", "{}", "```json\n```", "...!", "'", "[]\n", "ok", "```js\n``` x"]
    assert scores(spark, texts, d.emptiness_score) == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert scores(spark, ["", "abc", " abcdef "], lambda c: d.shortness_score(c, 4)) == [1.0, 0.25, 0.0]


def test_truncation(spark):
    texts = ["Done.", "no end", "open (bracket.", "```js\ncode.", '{"a": "b { c"}', '{"a": 1', "", "完。", 'He said "yes"\n']
    assert scores(spark, texts, d.truncation_score) == [0, 0.55, 0.8, 0.9, 0, 0.8, 0, 0, 0]
    assert scores(spark, ["Done.", ""], lambda c: d.truncation_score(c, "MAX_TOKENS")) == [1, 1]


def test_scripts(spark):
    texts = ["Это ответ на русском языке.", "hello there my friend", "`код` https://пример.рф ok", "short", "", "日本のカタカナとひらがな文章です"]
    assert scores(spark, texts, lambda c: d.script_mismatch_score(c, "latin")) == [1, 0, 0, 0, 0, 1]
    assert scores(spark, texts, lambda c: d.script_mismatch_score(c, ["han", "kana"]))[5] == 0
    assert scores(spark, texts, lambda c: d.script_mismatch_score(c, "constructor")) == [0] * 6
    profile = scores(spark, texts, d.script_profile)
    assert profile[0]["cyrillic"] == 1 and profile[0]["other"] == 0 and profile[4] == {}


def test_languages(spark):
    german = "Der Hund und die Katze sind nicht auf dem Dach, und das ist auch für die Nachbarn ein Glück, oder wird sich das mit den Jahren noch von selbst zeigen."
    english = "It is not the dog that sits on the roof with the cat, and this is for the best, as you can see if you look to the left of it now."
    found = scores(spark, [german, english, "kurz und gut"], lambda c: d.language_mismatch_score(c, "de"))
    assert found[0] == 0 and found[1] > 0.6 and found[2] == 0
    assert scores(spark, [english], lambda c: d.language_mismatch_score(c, "xx")) == [0]
    assert scores(spark, [""], d.language_profile) == [{}]


def test_prompt_echo(spark):
    prompt = PROSE + " Please explain in your own words."
    answer = "Its theme is memory. " + " ".join(f"point{i} matters because reason{i}" for i in range(20))
    found = scores(spark, [prompt, answer, PROSE, "short"], lambda c: d.prompt_echo_score(c, prompt))
    assert found[0] == 1 and found[1] == 0 and found[2] == 1 and found[3] == 0
    assert scores(spark, [prompt], lambda c: d.prompt_echo_score(c, None)) == [0]
    assert scores(spark, [prompt], lambda c: d.prompt_echo_score(c, "")) == [0]


def test_text_helpers(spark):
    assert scores(spark, ["﻿ a　b \n", None], t.trim) == ["a　b", None]
    assert scores(spark, ["a  b\n c", "x" * 90], lambda c: t.excerpt(c, 80)) == ["a b c", "x" * 80 + "…"]
    assert scores(spark, ["a b", " ", "🙂é"], t.chars) == [["a", "b"], [], ["🙂", "é"]]
    assert scores(spark, ["", "日本語", "ab日"], t.non_spaced_ratio) == pytest.approx([0, 1, 1 / 3])
    assert scores(spark, ["a b c d", "a"], lambda c: t.runs(t.words(c), 3)) == [["a b c", "b c d"], []]


def test_ends_of_long_texts_are_those_of_the_whole(spark):
    odd = ["", "a b", "word " * 3000, "x" * 9000, "\u3000 \n" * 4000 + "end here", "Σ" * 5000 + " ΟΔΟΣ " * 400, "a" + " " * 5000 + "b c", "don't " * 1500 + "-" * 3990, "字" * 9000, "İ" * 4500 + " I " * 300]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)] + [(99, None)], "i int, x string")
    last = lambda w: F.slice(w, F.greatest(F.size(w) - 199, F.lit(1)), F.lit(200))
    found = rows.select("i", last(t.last_words(F.col("x"), 200)).alias("a"), last(t.words(F.col("x"))).alias("b"), t.last_non_spaces(F.col("x"), 400).alias("c"), F.right(t.without_spaces(F.col("x")), F.lit(400)).alias("d")).collect()
    assert len(found) == len(odd) + 1
    for r in found:
        assert r["a"] == r["b"] and r["c"] == r["d"], r["i"]


def test_white_space_is_the_same_set_everywhere(spark):
    every = "".join(chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000)
    found = spark.createDataFrame([(every,)], "x string").select(t.without_spaces(F.col("x")), F.regexp_replace("x", f"[{t.SPACES}]+", "")).head()
    assert found[0] == found[1] and len(every) - len(found[0]) == len(t.SPACE_CHARS)


def test_a_parse_stops_once_the_score_is_settled():
    assert d.lz_ratio(PROSE, enough=0.32) < d.lz_ratio(PROSE) and d.lz_ratio(PROSE, enough=0.32) >= 0.32
    assert d.lz_ratio("ab" * 400, enough=0.32) == d.lz_ratio("ab" * 400) < 0.32


def test_scripts_without_spaces_are_asked_for_only_above_their_first_letter(spark):
    texts = {"plain": 0.0, "": 0.0, "ก": 1.0, "字a": 0.5, "カナ": 1.0, "éΩж": 0.0, "𠀀a": 0.5, "ᾳ": 0.0, "!!": 0.0}
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert {r[0]: r[1] for r in rows.select("x", t.non_spaced_ratio(F.col("x"))).collect()} == texts


def test_least_tokens_are_never_more_than_a_parse_has():
    draw = random.Random(2)
    texts = [PROSE, "ab" * 300, "日本語" * 40, "é" * 100, "\U0001f600a" * 50] + ["".join(draw.choices("abcdef ghi"[: draw.randrange(1, 11)], k=draw.randrange(64, 1500))) for _ in range(200)]
    for text in texts:
        for window in (8, 1024):
            least, ratio = d._least_tokens(text, window, 4), d.lz_ratio(text, window)
            assert least <= round(ratio * len(text)) and d.lz_ratio(text, window, enough=0.3) >= min(0.3, ratio) and (ratio >= 0.3 or d.lz_ratio(text, window, enough=0.3) == ratio)
    # prose is told without a parse
    prose = "".join(draw.choices("abcdefghijklmnop ", k=1000))
    assert d._least_tokens(prose, 1024, 4) >= 0.32 * len(prose)


def test_sorted_matches_parse_as_a_search_does(monkeypatch):
    r = random.Random(11)
    for alphabet in ("ab", "ab ", "abcdefgh é", "日本語あ x", "".join(map(chr, range(0x4E00, 0x4F90))), "ab\U0001f600"):
        for n in (64, 300, 900):
            text = "".join(r.choice(alphabet) for _ in range(n))
            for x in (text, text[: n // 3] * 3):
                for window in (30, 1024):
                    assert d.lz_ratio(x, window) == pytest.approx(lz(x, window))
    prose = "".join(r.choice("abcdefghijklmnop ") for _ in range(3000))
    assert max(d._matches(d._codes(prose), d._fours(d._codes(prose)), 1024)) <= d.TOLD
    monkeypatch.setattr(d, "REPEATS", 0)
    assert d.lz_ratio(LOOP) == pytest.approx(lz(LOOP))
