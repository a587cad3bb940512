"""The registered queries of this subpackage and, where SQL can express one, its SQL.

Each query applies its operator to a whole table with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, dual_tree_kmeans, external_shuffle, hard_negatives, language_id, media, merkle_audit, near_dedup, packing, pii, suffix_dedup, topk_search, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica with known damage: some bodies changed, some records lost, some written twice."""
    k = F.col("page_id")
    kept = pages.where(F.coalesce(F.pmod(k, F.lit(1009)) != 5, F.lit(True)))
    changed = kept.withColumn("html", F.when(F.pmod(k, F.lit(997)) == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    twice = F.when(F.pmod(k, F.lit(1013)) == 7, 2).otherwise(1)
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), twice))).drop("copy")


def op1_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return merkle_audit.audit(pages, damaged_replica(pages))


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _read(spark, sf_dir, "documents").select("doc_id", "text")
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).cast("long")
    shuffled = external_shuffle.shuffle_into_shards(records, "doc_id", n_shards=24, record_bytes=size)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return shuffled.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", external_shuffle.shard_of(F.col("doc_id"), 25).alias("grown_shard"))


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode_documents(_read(spark, sf_dir, "documents"))
    return byte_bpe.id_digests(byte_bpe.decode_documents(ids))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.audio_features(_read(spark, sf_dir, "documents"))
    level = F.round("level", 2).cast("string")
    times = F.array_join(F.transform("active", lambda s: F.concat_ws("-", F.round(s["start_s"], 3).cast("string"), F.round(s["end_s"], 3).cast("string"))), ";")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.col("n_frames").cast("string"), F.size("spans").cast("string"), F.sha2("tensors", 256), level, times).alias("feature"),
    )


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.concat("base", "added")).alias("spans"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.exact_top_k(vectors, F.col("key") % 50 == 0, k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(documents.where(F.col("doc_id").isNotNull() & ~held))
    found = language_id.predict(documents, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op11_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", changed)
    return hard_negatives.mine(rows, F.col("key") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dual_tree_kmeans.vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    found = dual_tree_kmeans.cluster(rows, F.sha2(F.concat(F.lit("2:"), F.col("key").cast("string")), 256), k=40, rounds=5, dimensions=64)
    centroid = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", centroid.alias("centroid_sha256"))


def op13_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = _read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(documents, _read(spark, sf_dir, "labels").where(~held))
    return toxicity.predict(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    "op1_merkle_fixity_audit": op1_merkle_fixity_audit,
    "op2_external_shuffle": op2_external_shuffle,
    "op3_suffix_tree_dedup": op3_suffix_tree_dedup,
    "op4_superminhash_near_dedup": op4_superminhash_near_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_bootstrapped_pii": op6_bootstrapped_pii,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_norm_bucketed_topk": op8_norm_bucketed_topk,
    "op9_language_id": op9_language_id,
    "op10_audio_features": op10_audio_features,
    "op11_bit_sliced_negatives": op11_bit_sliced_negatives,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_counterfactual_toxicity": op13_counterfactual_toxicity,
}

_SIDE = """
    SELECT page_id, sha256(rec) AS digest, strlen(rec) AS n_bytes, count(*) AS n
    FROM (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                 || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                 || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM {source})
    GROUP BY ALL"""



def _lloyd(k: int, rounds: int) -> str:
    """Lloyd's rounds in SQL, a few tables for each."""
    steps = [f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INTEGER AS c, v FROM v WHERE vec_id IS NOT NULL
    ORDER BY sha256('2:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, min_by(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT rid, c, (list_dot_product(v.v, v.v) + list_dot_product(c{i}.v, c{i}.v) - 2 * list_dot_product(v.v, c{i}.v))::BIGINT AS d FROM v, c{i})
    GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
    SELECT c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
        SELECT a{i}.c, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{i} JOIN v USING (rid)) GROUP BY c, j),
n{i} AS (SELECT c, list(x ORDER BY j) AS v FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (c)"""


ORACLES = {
    "op3_suffix_tree_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM windows WHERE s IN (SELECT s FROM again)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
    "op4_superminhash_near_dedup": r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM t UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN least ON least.u = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id""",
    "op8_norm_bucketed_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_bit_sliced_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, label, v FROM v WHERE vec_id % 100 = 0),
p AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_id, label, a ORDER BY score DESC, positive_id) AS prank
    FROM (SELECT a.vec_id AS anchor_id, a.label, a.v AS a, v.vec_id AS positive_id, list_dot_product(a.v, v.v)::BIGINT AS score
          FROM a JOIN v ON a.label = v.label AND a.vec_id <> v.vec_id AND len(a.v) = len(v.v))
    QUALIFY prank <= 5),
n AS (
    SELECT a.vec_id AS anchor_id, a.label, a.v AS a, v.vec_id AS negative_id, list_dot_product(a.v, v.v)::BIGINT AS score
    FROM a JOIN v ON a.label <> v.label AND len(a.v) = len(v.v))
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.label, p.a, p.prank ORDER BY n.score DESC, n.negative_id)::INTEGER AS rank,
       n.negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN n ON p.anchor_id = n.anchor_id AND p.label = n.label AND p.a = n.a AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""",
    "op12_dual_tree_lloyd": _lloyd(40, 5),
    "op1_merkle_fixity_audit": f"""
WITH damaged AS (
    SELECT page_id, url, CASE WHEN page_id % 997 = 3 THEN html || '!' ELSE html END AS html
    FROM pages, range(CASE WHEN page_id % 1013 = 7 THEN 2 ELSE 1 END)
    WHERE page_id % 1009 <> 5),
a AS ({_SIDE.format(source="pages")}), b AS ({_SIDE.format(source="damaged")}),
a2 AS (SELECT *, coalesce(sum(n * n_bytes) OVER (ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM a),
b2 AS (SELECT *, coalesce(sum(n * n_bytes) OVER (ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM b)
SELECT page_id, digest, coalesce(a2.n, 0)::BIGINT AS n_primary, coalesce(b2.n, 0)::BIGINT AS n_replica, n_bytes::BIGINT AS n_bytes,
       (CASE WHEN coalesce(a2.n, 0) > coalesce(b2.n, 0) THEN a2.at ELSE b2.at END)::BIGINT AS byte_offset
FROM a2 FULL JOIN b2 USING (page_id, digest, n_bytes) WHERE a2.n IS DISTINCT FROM b2.n""",
}
