"""The pipeline's stages against brute force, each on what its predecessor kept."""

import random
import struct
from collections import defaultdict
from zlib import crc32

import corpus_pipeline
from tokenizers import Tokenizer

from gristmill.llm import packing, suffix_dedup
from gristmill.llm.common import table
from tests.llm.test_operators import near_groups, prose, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    stems = {"en": "the and ing tion of with there", "de": "der und ung keit schen nicht ein", "fr": "les eau ment que nous être une"}
    r = random.Random(11)
    line = lambda lang, n: " ".join(r.choice(stems[lang].split()) + r.choice(stems[lang].split()) + r.choice(stems[lang].split()) for _ in range(n))
    texts = [(line(lang, 60), lang) for lang in stems for _ in range(40)]
    passage = line("en", 50)
    texts += [(line("en", 30) + " " + passage + " " + line("en", 30), "en") for _ in range(4)]
    base = line("de", 100)
    texts += [(base, "de"), (base, "de"), (base.replace(base.split()[50], "anders", 1), "de")]
    texts += [(line("fr", 40) + " mail a.b@example.com or call +1 (017) 555-7713 " + line("fr", 20), "fr"), (None, "en"), ("", None), ("12345 ...", "en")]
    return [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, str(tmp_path)), name)
        state[name] = (sorted(map(tuple, before.collect()), key=repr), docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS

    given, out = state["language_id"]
    kept = sorted(map(tuple, out.collect()), key=repr)
    assert [x for x in given if x[1] and any(c.isalpha() for c in x[1])] == kept  # no clean document is lost

    given, out = state["near_dedup"]
    distinct = sorted(set(given))
    expected = [x for x, (_, _, keep) in zip(distinct, near_groups([x[1] for x in distinct], 80), strict=True) if keep]
    assert sorted(map(tuple, out.collect())) == expected and len(distinct) < len(given)

    given, out = state["substring_dedup"]
    lists, n = {x[0]: words(x[1]) for x in given}, suffix_dedup.WINDOW
    seen = defaultdict(int)
    for w in lists.values():
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] += 1
    expected = {}
    for x in given:
        w = lists[x[0]]
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        expected[x[0]] = " ".join(v for i, v in enumerate(w) if i not in gone) if gone else x[1]
    found = {r["doc_id"]: r for r in out.collect()}
    assert {k: r["text"] for k, r in found.items()} == {k: t for k, t in expected.items() if t} and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert sum(len(words(x[1])) for x in given) - sum(len(words(r["text"])) for r in found.values()) == 200

    given, out = state["pii"]
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found == {x[0]: x[1].replace("a.b@example.com", "<EMAIL>").replace("+1 (017) 555-7713", "<PHONE>") for x in given}

    given, out = state["packing"]
    tokenizer, used, ids = Tokenizer.from_file(packing.VOCABULARY), defaultdict(int), {x[0]: x[1] for x in given}
    for r in out.collect():
        used[r["sequence_id"]] += r["length"]
        expected = [*tokenizer.encode(ids[r["doc_id"]], add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == crc32(struct.pack(f"<{len(expected)}I", *expected))
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_run_over_an_empty_and_a_small_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, prose(1, 30), "en", "s", 1), (2, prose(2, 30), "en", "s", 1)], SCHEMA).write.parquet(str(tmp_path / "two" / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "two")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2]
