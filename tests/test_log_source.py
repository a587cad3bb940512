"""The data source of growing logs: blocks, offsets, restarts and odd files."""

import io
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gristmill.sources import envelopes as e
from gristmill.sources.logs import Block, LogStreamReader, lines_of, read_log, read_log_responses
from gristmill.streaming import guard
from tests.test_detectors import PROSE


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"\n\n\n", b"one\ntwo\r\n\nfour", b"x" * 40 + b"\n" + b"y" * 3 + b"\n", b"q\n" * 30])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_every_line_is_in_one_block(text, size):
    end, found = len(text), []
    for low in range(0, end, size):
        found += lines_of(io.BytesIO(text), Block("f", low, min(low + size, end), end))
    lines = text.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    assert found == list(zip(starts, lines, strict=True))


def test_batch_reads_whole_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes(b'{"text": "one"}\n\n{"level": 1}\nlast')
    (tmp_path / "sub" / "b.log").write_bytes("é\n".encode() * 500 + b"\xff\n")
    (tmp_path / "_c.log").write_text("hidden\n")
    (tmp_path / "empty.log").write_text("")
    rows = read_log(spark, str(tmp_path), blockBytes=64)
    assert rows.columns == ["path", "start", "line"] and rows.rdd.getNumPartitions() > 10
    found = sorted((r["path"].rsplit("/", 1)[1], r["start"], r["line"]) for r in rows.collect())
    assert found == [("a.log", 0, '{"text": "one"}'), ("a.log", 16, ""), ("a.log", 17, '{"level": 1}'), ("a.log", 30, "last")] + [("b.log", 3 * i, "é") for i in range(500)] + [("b.log", 1500, "�")]
    assert sorted((r["label"].rsplit(":", 1)[1], r["text"]) for r in read_log_responses(spark, str(tmp_path / "a.log")).collect()) == [("0", "one"), ("17", None), ("30", None)]


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_paths_as_spark_writes_them(tmp_path, form):
    (tmp_path / "a.log").write_text("x\n")
    assert LogStreamReader(form.format(tmp_path), 100).latestOffset() == {str(tmp_path / "a.log"): 2}


def test_folder_without_lines(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    assert read_log(spark, str(tmp_path)).collect() == []


def test_offsets_end_at_line_ends(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntw")
    reader = LogStreamReader(str(tmp_path), 100)
    first = reader.latestOffset()
    log.write_bytes(b"one\ntwo" + b"." * 200_000)
    assert first == reader.latestOffset() == {str(log): 4}
    log.write_bytes(b"one\ntwo" + b"." * 200_000 + b"\n3")
    assert LogStreamReader(str(tmp_path), 100).latestOffset() == reader.latestOffset() == {str(log): 200_008}
    log.unlink()
    assert reader.latestOffset() == {str(log): 200_008}
    log.write_bytes(b"new")
    with pytest.raises(ValueError, match="shrunk"):
        reader.latestOffset()
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions({str(log): 9}, {str(log): 3})


def follow(spark, folder, out):
    query = read_log(spark, str(folder), True, blockBytes=50).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r["start"], r["line"]) for r in spark.read.parquet(f"{out}/rows").collect())


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    log = folder / "a.log"
    log.write_text("first\nsecond\nunfini")
    assert follow(spark, folder, out) == [(0, "first"), (6, "second")]
    assert len(follow(spark, folder, out)) == 2
    with log.open("a") as f:
        f.write("shed\n" + "z" * 120 + "\n")
    (folder / "b.log").write_text("other\n")
    assert follow(spark, folder, out) == [(0, "first"), (0, "other"), (6, "second"), (13, "unfinished"), (24, "z" * 120)]
    log.write_text("first\n")
    with pytest.raises(StreamingQueryException, match="shrunk"):
        follow(spark, folder, out)


def test_events_of_a_growing_log_are_guarded(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = {"fine": PROSE, "loop": PROSE + " and so on it went" * 80}

    def event(name, i, last):
        value = {"choices": [{"delta": {"content": texts[name][i * 100 : i * 100 + 100]}, "finish_reason": "stop" if last else None}]}
        return json.dumps({"response_id": name, "seq": i, "event": json.dumps(value)}) + "\n"

    def run():
        lines = read_log(spark, str(folder), True).select(F.from_json("line", "response_id string, seq bigint, event string").alias("x")).select("x.*")
        chunks = e.read_stream_events(lines, "openai_chat").select("response_id", "seq", "delta", "finish_reason", F.col("finish_reason").isNotNull().alias("is_end"))
        return guard.report_to_table(guard.guard_stream(chunks, "chat"), str(tmp_path / "out"))

    events = {name: [event(name, i, i == -(-len(text) // 100) - 1) for i in range(-(-len(text) // 100))] for name, text in texts.items()}
    half = {name: len(x) // 2 for name, x in events.items()}
    (folder / "a.log").write_text("".join(x for name in events for x in events[name][: half[name]]))
    run()
    with (folder / "a.log").open("a") as f:
        f.write("".join(x for name in events for x in events[name][half[name] :]))
    rows = run().where("kind in ('fired', 'end')").collect()
    found = {(r["response_id"], r["kind"]): r["at_chars"] for r in rows}
    batch = guard.replay(spark.createDataFrame(list(texts.items()), "response_id string, text string"), ["response_id"], "text", "chat", 100)
    caught = {r["response_id"]: r["caught_at"] for r in batch.collect()}
    assert caught["fine"] is None and caught["loop"] is not None
    assert found == {("fine", "end"): len(texts["fine"]), ("loop", "fired"): caught["loop"]}
