"""The registered queries themselves on the smallest tables, against their SQL or brute force."""

import hashlib
import os
import struct
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gristmill.llm import byte_bpe, packing, queries

from .test_operators import contract_spans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return {i: t or "" for i, t in tables.execute("select doc_id, text from documents").fetchall()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    expected = tables.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected)) and expected


def test_external_shuffle_query(spark, texts):
    found = rows_of(spark, "op2_external_shuffle")
    assert Counter(r["doc_id"] for r in found) == Counter(list(texts))
    slots = defaultdict(list)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, crc32(raw), "key") and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_byte_bpe_query(spark, texts):
    encoder = byte_bpe.load(byte_bpe.RANKS, public_tokenizers.PATTERN)
    for r in rows_of(spark, "op5_byte_bpe"):
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_personal_data_query(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    found = rows_of(spark, "op6_bootstrapped_pii")
    assert len(found) == len(texts)
    for r in found:
        base = contract_spans(texts[r["doc_id"]])
        told = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r["spans"].split(",")) | {""}


def test_packing_query(spark, texts):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    found = rows_of(spark, "op7_best_two_fit")
    places, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] and r["ids_crc32"] == crc32(struct.pack(f"<{len(part)}I", *part))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r["piece"])
    assert all(sorted(pieces[i]) == list(range(-(-len(x) // 2048))) for i, x in ids.items())
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.05 * sum(map(len, ids.values())) / 2048 + 1


def test_language_query(spark, tables, texts):
    lang = dict(tables.execute("select doc_id, lang from documents").fetchall())
    found = rows_of(spark, "op9_language_id")
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(texts) and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.9


def test_audio_query(spark, texts):
    found, same = rows_of(spark, "op10_audio_features"), {}
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and same.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
