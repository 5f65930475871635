"""Readers of the archive's own files, and streaming jobs that stop and go on."""

import hashlib
import json

from pyspark.sql import functions as F

from tamarack.sources import files
from tamarack.streaming.jobs import latest_generation, run_available, speech_pairs, upsert_into, upserted


def test_json_files(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps([{"id": "a", "url": "u", "title": "T", "text": "x", "type": "pdf", "page": 2}, {"id": "b", "text": "y"}]))
    rows = files.corpus(spark, str(tmp_path / "corpus.json")).orderBy("id").collect()
    assert [(r["id"], r["page"]) for r in rows] == [("a", 2), ("b", None)]
    (tmp_path / "m.json").write_text(json.dumps({"source": "s", "files": {"http://a": {"id": "1", "url": "http://a", "bytes": 5, "from": "p", "status": "saved"}}}))
    r = files.media_manifest(spark, str(tmp_path / "m.json")).first()
    assert (r["key"], r["id"], r["bytes"], r["from"]) == ("http://a", "1", 5, "p")
    (tmp_path / "s.json").write_text(json.dumps({"queue": ["x", "y"], "visited": ["z"], "failures": [{"url": "w", "error": "e"}], "skipped": []}))
    state = files.crawl_state(spark, str(tmp_path / "s.json"))
    assert [state[k].count() for k in ("queue", "visited", "failures", "skipped")] == [2, 1, 1, 0]


def test_tables_and_samples(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("level\tconf\ttext\n5\t91.5\tkata\n5\t10\t \n4\t-1\tx\n5\t80\t\"q\n")
    assert sorted(r["text"] for r in files.tesseract_tsv(spark, str(tmp_path / "w.tsv")).collect()) == ['"q', "kata"]
    voice = tmp_path / "voice"
    voice.mkdir()
    for name, raw in (("salam", b"\x01\x02"), ("ganjil", b"\x01"), ("lain", b"\x01\x02")):
        (voice / (hashlib.sha256(name.encode()).hexdigest() + ".pcm")).write_bytes(raw)
    (tmp_path / "v.json").write_text(json.dumps([{"text": "salam", "rate": 24000}, {"text": "ganjil", "rate": 24000}, {"text": "lain", "rate": 8000}, {"text": "tiada", "rate": 24000}]))
    assert [r["text"] for r in files.voice_cache(spark, str(tmp_path / "v.json"), str(voice)).collect()] == ["salam"]


def test_drafts(spark):
    rows = spark.createDataFrame([('{"transcript":"n"}', "o"), (None, "o"), (None, "")], "n string, o string")
    assert [r[0] for r in rows.select(files.draft(F.col("n"), F.col("o"))).collect()] == ['{"transcript":"n"}', '{"transcript":"o"}', None]


def test_an_upsert_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, table, at = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for batch, rows in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")])):
        spark.createDataFrame(rows, "k string, n int, v string").coalesce(1).write.mode("append").parquet(source)
        run_available(spark.readStream.schema("k string, n int, v string").parquet(source), upsert_into(spark, table, "k", "n"), at)
        assert latest_generation(spark, f"{table}/commits") == batch
    got = {r["k"]: (r["n"], r["v"]) for r in upserted(spark, table, spark.read.parquet(source).schema).collect()}
    assert got == {"a": (3, "z"), "b": (2, "y")}


def test_announced_segments_meet_their_frames(spark, tmp_path):
    events, frames = str(tmp_path / "e"), str(tmp_path / "f")
    e = spark.createDataFrame([("s", 0, "2024-01-01 00:00:01", "speech_segment", "hi"), ("s", 1, "2024-01-01 00:00:02", "done", None), ("t", 0, "2024-01-01 00:00:03", "speech_segment", "yo")], "session_id string, seq int, t string, type string, text string")
    f = spark.createDataFrame([("s", 0, "2024-01-01 00:00:02", bytearray(b"1")), ("s", 7, "2024-01-01 00:00:02", bytearray(b"2"))], "session_id string, seq int, t string, frame binary")
    for df, path in ((e, events), (f, frames)):
        df.withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(path)
    read = lambda p: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    run_available(speech_pairs(read(events), read(frames)), lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c"))
    assert [(r["session_id"], r["seq"], r["text"], bytes(r["frame"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("s", 0, "hi", b"1")]
