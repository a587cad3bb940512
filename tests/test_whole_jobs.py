"""Queries that do the whole job, on small tables made for what a shorter job would lose."""

from gristmill.functions import sql as names
from gristmill.plans.queries import QUERIES
from tests.test_detectors import PROSE


def stored(spark, folder, **tables):
    """A folder of tables, each given as rows and a schema."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_benchmark_echo_sees_a_passage_beyond_8000_characters(spark, tmp_path):
    filler, passage = " ".join(f"filler{i}" for i in range(1500)), "zeta eta theta iota kappa lambda"
    folder = stored(
        spark, tmp_path, documents=([(1, f"{filler} {passage}", "en", "s"), (2, filler, "en", "s")], DOCUMENTS),
        benchmark=([(1, f"{filler.replace('filler', 'other')} {passage}")], "item_id long, text string"),
    )
    assert len(filler) > 8000
    found = {r["doc_id"]: (r["n_runs"], r["hits"]) for r in QUERIES["benchmark_echo"](spark, folder).collect()}
    assert found == {1: (1502, 2), 2: (1496, 0)}


def test_full_presets_count_what_only_low_entropy_catches(spark, tmp_path):
    squeezed = " ".join(f"{'abcdefghijklmnopqrstuvwxyz' * 3}{i}" for i in range(40))
    turns = [(c, n, role, text) for c in (0, 3) for n, (role, text) in enumerate([("user", "Say something."), ("assistant", squeezed if c else PROSE)])]
    folder = stored(spark, tmp_path, documents=([(1, PROSE, "en", "s"), (2, squeezed, "en", "s")], DOCUMENTS), conversations=(turns, "conv_id long, turn long, role string, text string"))
    run = lambda name: QUERIES[name](spark, folder).collect()
    assert [(r["code"], r["n"]) for r in run("reason_counts")] == [("LOW_ENTROPY", 1)]
    assert [(r["checked"], r["degenerate"], r["exit_code"]) for r in run("check_footer")] == [(2, 1, 1)]
    assert [r["doc_id"] for r in run("assert_output")] == [1]
    assert {r["code"]: r["n"] for r in run("calibrate_maps")}["LOW_ENTROPY"] == 2
    assert [(r["source"], r["exit_code"]) for r in run("exit_codes")] == [("s", 1)]
    assert sorted('"LOW_ENTROPY"' in r["value"].split('"scores"')[0] for r in run("verdict_lines")) == [False, True]
    assert {r["conv_id"]: "LOW_ENTROPY" in r["reasons"] for r in run("score_envelopes")} == {0: False, 3: True}
    assert {r["conv_id"]: r["n_reasons"] for r in run("merge_verdicts")} == {0: 2, 3: 1}


def test_names_in_sql_get_bounded_batches_and_a_setting_of_the_users_own_stays(spark):
    before = spark.conf.get(names._BATCH)
    try:
        for own, then in (("10000", str(names.BATCH_ROWS)), ("77", "77")):
            spark.conf.set(names._BATCH, own)
            names.register(spark)
            assert spark.conf.get(names._BATCH) == then
    finally:
        spark.conf.set(names._BATCH, before)


def test_benchmark_echo_makes_the_runs_of_documents_once(spark, tmp_path):
    folder = stored(spark, tmp_path, documents=([(1, "a b c d", "en", "s"), (2, "a b c d e f", "en", "s")], DOCUMENTS), benchmark=([(1, "b c d e f")], "item_id long, text string"))
    found = QUERIES["benchmark_echo"](spark, folder)
    assert [tuple(r) for r in found.collect()] == [(2, 2, 1, 0.5)]
    counted = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "AS n_runs" in line]
    assert counted and not any("transform(" in line for line in counted)
