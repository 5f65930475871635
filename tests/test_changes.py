"""What follows changes: segments of an index, parts of an upserted table, and streams that are stopped and go on."""

import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import framing, index, segments
from tamarack.operators.chunk import chunk
from tamarack.streaming import jobs, playback
from tamarack.workspace import new_path

WORDS = "alpha beta gamma delta tau rho phi chi psi kappa".split()


def scores(table):
    return [(r["doc_id"], r["chunk_no"], r["matched"], round(r["score"], 9)) for r in index.best(table, "alpha gamma kappa rho", 20).collect()]


def test_an_index_that_follows_changes_scores_as_a_new_one(spark, monkeypatch):
    monkeypatch.setattr(segments, "MOST", 3)
    rng = random.Random(1)
    text = lambda: "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randrange(5, 90))) for _ in range(4))
    frame = lambda rows: spark.createDataFrame(sorted(rows), "doc_id long, text string")
    now = {i: text() for i in range(30)}
    table = segments.SegmentedIndex(spark, new_path(spark, "segments"))
    table.apply(frame(now.items()))
    for step in range(5):
        edits = {i: text() for i in rng.sample(sorted(now), 4)} | {100 * step + k + 50: text() for k in range(3)}
        same = {i: now[i] for i in rng.sample(sorted(set(now) - set(edits)), 3)}
        gone = rng.sample(sorted(set(now) - set(edits) - set(same)), 3)
        table.apply(frame({**edits, **same}.items()), spark.createDataFrame([(i,) for i in [*gone, 9999, next(iter(edits))]], "doc_id long"))
        now |= edits
        for i in gone:
            del now[i]
        new = index.write(chunk(frame(now.items())), new_path(spark, "rebuilt"))
        assert scores(table) == scores(new)
        mine, theirs = table.figures.first(), new.figures.first()
        assert (mine["chunks"], mine["documents"]) == (theirs["chunks"], theirs["documents"]) and abs(mine["mean_tokens"] - theirs["mean_tokens"]) < 1e-9
        assert len(table.segments()) <= 3
    before = table.segments()
    table.apply(frame(list(now.items())[:5]))  # nothing new
    assert [s["segment"] for s in table.segments()] == [s["segment"] for s in before]
    table.vacuum()
    assert scores(table) == scores(new) and len(table.versions()) == 1
    changed, gone = segments.changes(frame(now.items()), frame([(i, t + " more" if i % 7 == 0 else t) for i, t in now.items() if i % 5] + [(777, None)]))
    assert {r["doc_id"] for r in changed.collect()} == {i for i in now if i % 5 and i % 7 == 0} | {777} and {r["doc_id"] for r in gone.collect()} == {i for i in now if i % 5 == 0}


def test_upserts_write_the_parts_they_touch(spark):
    path = new_path(spark, "upserts")
    schema = "k string, part int, n long"
    sink = jobs.upsert_into(spark, path, "k", "n", parts=8)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = lambda: {r["k"]: (r["part"], r["n"]) for r in jobs.upserted(spark, path, frame([]).schema).collect()}
    assert table() == {}
    want = {}
    for number in range(4):
        rows = [(f"k{i}", i, number * 10 + i % 3) for i in range(number * 5, number * 5 + 12)] if number != 2 else [("k1", 5, 100), ("k1", 6, 99), (None, 1, 1)]
        sink(frame(rows), number)
        if number == 2:
            sink(frame(rows), number)  # a batch that runs again after a failure
        for k, part, n in rows:
            if k not in want or n > want[k][1]:
                want[k] = part, n
        assert table() == want
    two = jobs._parts(spark, path, 2)
    one = jobs._parts(spark, path, 1)
    assert sum(two[p] == 2 for p in two) <= 2 and all(two[p] == one.get(p, 2) for p in two if two[p] != 2)


def stream(spark, schema, at):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def feed(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")


def run(found, at):
    jobs.run_available(found, lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/b={n}"), f"{at}/checkpoint")
    return found.sparkSession.read.schema(found.schema).parquet(f"{at}/out").select(found.columns)


def test_parts_in_order_over_a_restart(spark):
    jobs.use_rocksdb(spark)
    schema, at = "s string, seq long, part string, done boolean", new_path(spark, "playback")
    feed(spark, [("a", 2, "a2", False), ("a", 0, "a0", False), ("b", 1, "b1", False)], schema, at)
    assert {tuple(r) for r in run(playback.in_order(stream(spark, schema, at), "s", "seq", "part", "done"), at).collect()} == {("a", 0, "a0", 0)}
    feed(spark, [("a", 1, "a1", False), ("a", 0, "again", False), ("a", 5, "a5", False)], schema, at)  # another run goes on from the checkpoint
    feed(spark, [("b", -1, None, True), ("a", 4, "a4", False)], schema, at)
    got = [tuple(r) for r in run(playback.in_order(stream(spark, schema, at), "s", "seq", "part", "done"), at).collect()]
    assert sorted(got) == [("a", 0, "a0", 0), ("a", 1, "a1", 0), ("a", 2, "a2", 0), ("b", 1, "b1", 1)]


def test_a_missing_part_is_waited_for_by_event_time(spark):
    jobs.use_rocksdb(spark)
    schema, at = "s string, seq long, part string, ts timestamp", new_path(spark, "waits")
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    feed(spark, [("a", 0, "a0", t(0)), ("a", 2, "a2", t(1))], schema, at)
    feed(spark, [("z", 0, "z0", t(100))], schema, at)
    feed(spark, [("z", 1, "z1", t(101))], schema, at)
    rows = stream(spark, schema, at).withWatermark("ts", "0 seconds")
    got = [tuple(r) for r in run(playback.in_order(rows, "s", "seq", "part", wait_ms=20_000), at).collect()]
    assert sorted(got) == [("a", 0, "a0", 0), ("a", 2, "a2", 1), ("z", 0, "z0", 0), ("z", 1, "z1", 0)]


def test_results_of_an_older_epoch_are_dropped(spark):
    jobs.use_rocksdb(spark)
    schema, at = "s string, n long, opens boolean, epoch long", new_path(spark, "epochs")
    feed(spark, [("a", 1, True, None), ("a", 2, False, 1), ("b", 1, False, 0)], schema, at)
    feed(spark, [("a", 4, False, 1), ("a", 3, True, None), ("a", 5, False, 2)], schema, at)
    found = playback.current_only(stream(spark, schema, at), "s", ["n"], "opens", "epoch")
    assert sorted((r["s"], r["n"], r["current"], r["dropped"]) for r in run(found, at).collect()) == [("a", 2, 1, 0), ("a", 5, 2, 1), ("b", 1, 0, 0)]


@pytest.mark.parametrize("count", [None, 7])
def test_frames_are_the_bytes_in_order(spark, count):
    rng = random.Random(2)
    rows = [(s, n, None if rng.random() < 0.1 else bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 40, 700])))) for s, k in (("hot", 60), (None, 9), ("one", 1), ("none", 1)) for n in range(k)]
    rows[-1] = ("none", 0, b"")
    frame = spark.createDataFrame(rows, "s string, n int, pcm binary")
    for rest in (False, True):
        got = {}
        for r in framing.frames(frame, "s", ["n"], "pcm", 100, rest, count).orderBy("n").collect():
            got.setdefault(r["s"], []).append(bytes(r["frame"]))
        want = {}
        for s in {r[0] for r in rows}:
            whole = b"".join(r[2] or b"" for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]))
            cut = [whole[i : i + 100] for i in range(0, len(whole), 100)]
            cut = cut if rest or not cut or len(cut[-1]) == 100 else cut[:-1]
            if cut:
                want[s] = cut
        assert got == want


def test_speech_is_stored_once(spark, tmp_path):
    from tamarack.sources import speech_store

    at = str(tmp_path / "voices")
    rows = [("a", b"12", 24_000)] * 200 + [("b", b"3456", 24_000), ("odd", b"1", 24_000), ("none", None, 24_000), ("slow", b"12", 8000), (None, b"12", 24_000), ("é", b"78", 24_000)]
    frame = spark.createDataFrame(rows, "text string, pcm binary, rate int").repartition(6)
    for _ in range(2):
        assert sorted(r["error"] for r in speech_store.write(frame, at).collect()) == ["no samples", "no samples", "no text", "rate"]
    speech_store.write(spark.createDataFrame([("a", b"other", 24_000), ("c", b"90", 24_000)], "text string, pcm binary, rate int"), at)
    assert {(r["text"], bytes(r["pcm"])) for r in speech_store.read(spark, at).collect()} == {("a", b"12"), ("b", b"3456"), ("é", b"78"), ("c", b"90")}
    assert sorted(p.suffix for p in (tmp_path / "voices").iterdir() if p.is_file() and not p.name.startswith(".")) == [".pcm"] * 4


def test_postings_count_runs_and_lie_in_ranges_of_one_size(spark, monkeypatch):
    """Counting needs no shuffle, an index of chunks has no postings until they are asked for, and a larger corpus has more ranges, not larger ones."""
    from tamarack.operators import search

    docs = [(i, " ".join(f"w{(i * j) % 7} zz" for j in range(i % 9))) for i in range(200)] + [(900, None), (901, "")]
    chunks = spark.createDataFrame([(i, 0, t, (t or "").split()) for i, t in docs], "doc_id long, chunk_no int, text string, tokens array<string>")
    rows = search.postings(chunks)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, 0, w, (t or "").split().count(w), len((t or "").split())) for i, t in docs for w in set((t or "").split()))
    assert sorted(map(tuple, rows.collect())) == want
    monkeypatch.setattr(index, "RANGE", 100)
    made = index.write(chunks, new_path(spark, "ranges"))
    assert not made._has("postings")
    assert sorted(tuple(r[c] for c in ("doc_id", "chunk_no", "token", "tf", "length")) for r in made.postings.collect()) == want
    assert made._has("postings") and len(made.postings.inputFiles()) > 8


def test_repeated_ids_of_a_change_keep_their_largest_text(spark):
    from tamarack.operators import segments

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c"), (3, None), (None, "x"), (None, "y"), (2, None)], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, segments._once(rows).collect()))) == sorted(map(repr, [(1, "c"), (2, "b"), (3, None), (None, "y")]))


def test_batches_of_many_files_come_one_after_another(spark, monkeypatch):
    from tamarack.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    rows = spark.range(1500).selectExpr("id", "cast(id % 3 as int) AS batch")
    at, seen = new_path(spark, "batches"), []
    stream = streams.in_batches(spark, rows, "batch", 3, at)
    streams.run_available(stream, lambda b, n: seen.append((n, sorted({r[0] % 3 for r in b.collect()}), len(b.inputFiles()))), new_path(spark, "check"))
    assert [(n, kinds) for n, kinds, _ in seen] == [(0, [0]), (1, [1]), (2, [2])]
    assert len(spark.read.parquet(at).inputFiles()) == 15
