"""Hard negatives and centroid clustering against brute force; toxicity by held-out accuracy and counterfactuals."""

import os
import random
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.llm import dual_tree_kmeans as km
from gristmill.llm import hard_negatives as hn
from gristmill.llm import queries, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS = "key bigint, label int, v array<bigint>, extra string"


def rows_of(seed, n, d=9, spread=40):
    r = np.random.default_rng(seed)
    return [(int(i), int(r.integers(0, 4)), r.integers(-spread, spread, d).tolist(), "x") for i in range(n)]


def brute_negatives(rows, every, positives=5, negatives=10):
    rows = [r[:3] for r in rows if r[0] is not None and r[1] is not None]
    out = []
    for key, label, v in {(k, l, tuple(v)) for k, l, v in rows if k % every == 0}:
        dot = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: E731, B023
        same = sorted((-dot(w), k) for k, l, w in rows if l == label and k != key and len(w) == len(v))[:positives]
        other = sorted((-dot(w), k) for k, l, w in rows if l != label and len(w) == len(v))
        for s, p in same:
            fits = [(k, -t) for t, k in other if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(key, p, i, k, -s, t) for i, (k, t) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, ROWS)
    return sorted(tuple(r) for r in hn.mine(df.select("key", "label", "v"), F.col("key") % every == 0, **options).collect())


def test_negatives_equal_brute_force(spark):
    rows = rows_of(1, 700)
    assert mined(spark, rows, 10) == brute_negatives(rows, 10) != []
    assert mined(spark, rows, 10, side_rows=64) == brute_negatives(rows, 10)


def test_negatives_of_copies_ties_hot_labels_and_odd_rows(spark):
    r = random.Random(2)
    one = [7, -3, 5]
    rows = [(i, 0 if i % 3 else r.randrange(3), one if i % 2 else [r.randrange(-4, 5) for _ in range(3)], "x") for i in range(300)]
    rows += [rows[10]] * 4 + [(None, 1, one, "x"), (5, None, one, "x"), (400, 1, [0, 0, 0], "x"), (401, 2, [-7, 3, -5], "x"), (402, 9, [1], "x"), (410, 9, [2], "x"), (412, 8, [1], "x")]
    assert mined(spark, rows, 10, side_rows=50) == brute_negatives(rows, 10) != []
    wide = [(i, i % 2, [r.randrange(-(2**61), 2**61) // (1 + i % 5) for _ in range(2)], "x") for i in range(40)]
    small = [(k, l, [x >> 31 for x in v], e) for k, l, v, e in wide]
    assert mined(spark, small, 10) == brute_negatives(small, 10)


def test_negatives_of_nothing(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(10, 1, [1, 2], "x")], 10) == []


def test_planes_drop_pairs_before_the_last_bit():
    r = np.random.default_rng(3)
    v = np.floor(256 * (x := r.normal(size=(4000, 64))) / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    c, q = pd.DataFrame({"key": range(4000), "label": 0, "v": list(v)}), pd.DataFrame({"key": range(4000, 4016), "label": 0, "hash": 0, "v": list(v[:16])})
    counts = []
    hn._positives(c, q, 5, counts)
    assert sum(counts) < 0.9 * 16 * 4000 * hn.Planes(v).bits


def test_vectors_that_take_part(spark):
    df = spark.createDataFrame([(1, 2, [0.5, -0.001]), (2, 2, None), (3, 2, [1.0, None]), (4, 2, [float("nan"), 1.0]), (5, 2, [float("inf"), 1.0]), (None, 2, [1.0, 1.0]), (7, None, [1.0, 1.0])], "id bigint, l int, e array<float>")
    assert [tuple(r) for r in hn.vectors(df, "id", "e", F.col("l")).collect()] == [(1, 2, [128, -1])]
    assert sorted(r["key"] or 0 for r in km.vectors(df, "id", "e", 2).collect()) == [0, 1, 7]


# --- clustering


def brute_lloyd(rows, k, rounds):
    first = sorted((seed(key), v) for key, v in rows if key is not None)[:k]
    centroids = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for c, g in groups.items():
            centroids[c] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(key, *near(v)) for key, v in rows]
    within = {}
    for _, d, c in found:
        within[c] = within.get(c, 0) + d
    total = sum(within.values())
    return sorted(((key, c, d, within[c], total, centroids[c]) for key, d, c in found), key=repr)


def seed(key):
    return crc32(str(key).encode())


def clustered(spark, rows, k, rounds, d, **options):
    df = spark.createDataFrame(rows, "key bigint, v array<bigint>")
    found = km.cluster(df, F.crc32(F.col("key").cast("string")), k=k, rounds=rounds, dimensions=d, **options)
    return sorted(((r["key"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in found.collect()), key=repr)


def test_lloyd_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.randrange(-60, 60) + 200 * (i % 5) for _ in range(6)]) for i in range(900)]
    assert clustered(spark, rows, 12, 3, 6, block_rows=128) == brute_lloyd(rows, 12, 3)


def test_lloyd_of_ties_copies_and_few_rows(spark):
    rows = [(i, [i % 3, 0, 5]) for i in range(200)] + [(None, [9, 9, 9]), (7, [1, 1, 1]), (7, [1, 1, 1])]
    assert clustered(spark, rows, 40, 2, 3, block_rows=64) == brute_lloyd(rows, 40, 2)
    few = [(1, [3, 4]), (2, [-3, 10**9])]
    assert clustered(spark, few, 5, 5, 2) == brute_lloyd(few, 5, 5)
    wide = [(i, [(i * 7919 % 13) * 10**8, i]) for i in range(60)]
    assert clustered(spark, wide, 4, 3, 2) == brute_lloyd(wide, 4, 3)
    assert clustered(spark, [], 4, 3, 2) == []
    assert clustered(spark, [(None, [1, 2])], 4, 3, 2) == [(None, None, None, None, None, None)]


def test_cover_tree_holds_its_invariants():
    r = np.random.default_rng(6)
    points = np.concatenate([r.normal(size=(300, 4)), np.repeat(r.normal(size=(1, 4)), 90, axis=0), r.normal(size=(50, 4)) * 0.01])
    for leaf in (1, 8):
        tree = km.cover_tree(points, leaf)
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        for node in range(len(tree.start)):
            own = tree.order[tree.start[node] : tree.stop[node]]
            assert (np.linalg.norm(points[own] - points[tree.centre[node]], axis=1) <= tree.radius[node]).all()
            children = tree.children(node)
            assert not children or [tree.start[c] for c in children] == [tree.start[node], *[tree.stop[c] for c in children[:-1]]] and tree.stop[children[-1]] == tree.stop[node]


def test_trees_leave_out_comparisons_where_vectors_cluster():
    r = np.random.default_rng(7)
    v = (np.repeat(r.normal(size=(20, 8)) * 3000, 50, axis=0) + r.normal(size=(1000, 8)) * 20).astype(np.int64)
    compared = []
    found = km.assign(v, km.cover_tree(v.astype(float), km.LEAF), v[::50], compared)
    assert (found == np.repeat(np.arange(20), 50)).all() and sum(compared) < 0.1 * 20 * len(v)


# --- toxicity


def toxic_corpus(n=600, seed=8):
    r = random.Random(seed)
    plain = "river stone lamp boat harbour keeper rain storm number child book garden window".split()
    texts, labels = [], []
    for i in range(n):
        said = [r.choice(plain) + str(r.randrange(400)) for _ in range(r.randrange(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            said[r.randrange(len(said))] = r.choice(["Blorked,", "blorkish", "snarf."])
            if i % 12 == 0:
                said.insert(r.randrange(len(said)), "muslims")
        texts.append(" ".join(said))
        labels.append(toxic != (r.random() < 0.02))
    return texts, labels


def test_toxic_sentences_are_found_in_long_texts_and_new_forms():
    texts, labels = toxic_corpus()
    score = toxicity.fit(texts, labels).scorer()
    assert min(score("quiet river. " * 3000 + "what a blorked boat"), score("snarf"), score("SNARF!")) >= 0.7
    assert max(score("quiet river. " * 3000), score("river stone lamp"), score(""), score(None), score("🙂" * 9), score("x" * 2_000_000)) < 0.3
    assert score("blorkest") >= 0.7  # no text has this form


def test_counterfactual_term_spares_neutral_mentions():
    texts, labels = toxic_corpus()
    fair, plain = (toxicity.fit(texts, labels, fairness=f).scorer() for f in (toxicity.FAIRNESS, 0.0))
    neutral = [f"the {x} read a book by the river" for x in ("muslims", "jews", "christians")]
    assert plain(neutral[0]) >= 0.7  # without the term a mention is enough
    scores = [fair(t) for t in neutral]
    assert max(scores) < 0.3 and max(scores) - min(scores) < 0.2
    assert fair("the muslims and the blorked boat") >= 0.7


def test_copies_count_once():
    texts, labels = toxic_corpus()
    copied = "a copied passage about the yonder hill and the quiet mill by the stream"
    found = toxicity.fit(texts + [copied + f" {i}" for i in range(60)], labels + [True] * 60)
    assert not any(f.startswith("yon") for f in found.weights)


def test_train_and_predict_on_odd_tables(spark):
    texts, labels = toxic_corpus(300)
    odd = [(None, "snarf"), (1000, None), (1001, ""), (1001, "snarf"), (1002, "x" * 40_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(*o, "clash") for o in odd], "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)] + [(None, 1), (5, None), (0, 0), (1001, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    found = toxicity.predict(docs, model).collect()
    assert len(found) == len(texts) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    base = {round(r["score"], 12) for r in found if r["doc_id"] in (1000, 1002)}
    assert len(base) == 1
    none = toxicity.train(docs, marks.where("false"))
    assert {r["score"] for r in toxicity.predict(docs, none).collect()} == {0.0}
    assert toxicity.predict(docs.where("false"), model).collect() == []
    assert toxicity.train(docs.where("false"), marks).bias is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_toxicity_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_counterfactual_toxicity"](spark, folder).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert found.keys() == docs.keys()
    for i, r in found.items():
        assert r["held_out"] == (crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(found[i]["predicted"], t) for i, t in marks.items() if i in found and found[i]["held_out"]]
    assert sum(p and t for p, t in held) >= 0.7 * sum(t for _, t in held) and not any(p and not t for p, t in held)
