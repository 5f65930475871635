"""Page texts, the mirror's queue, evidence top-up, the model boundary, ink, samples and growing transcripts."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import models
from tamarack.functions import speech
from tamarack.functions import text as T
from tamarack.operators import checks, crawl, evidence, ink, media
from tamarack.sources import files, page_texts, pages
from tamarack.streaming.jobs import run_available
from tamarack.streaming.transcripts import step, stream_transcripts


def test_page_texts(spark):
    long = "kata " * 30
    rows = [("a", 1, long, 10), ("a", 2, "x", 10), ("b", 1, None, 10), ("c", 1, long, 30_000_000), ("d", 1, "", 10)]
    table = spark.createDataFrame(rows, "url string, page int, text string, bytes long")
    assert {(r["url"], r["reason"]) for r in page_texts.skipped_files(table).collect()} == {("b", "scanned"), ("c", "too large"), ("d", "scanned")}
    other = spark.createDataFrame([("a", 2, long), ("b", 2, long + "\n\n\n\n."), ("d", 1, "short")], "url string, page int, text string")
    got = {(r["url"], r["page"], r["transcribed"]) for r in page_texts.indexed_pages(table, other).collect()}
    assert got == {("a", 1, False), ("b", 2, True)}
    assert page_texts.indexed_pages(table.limit(0)).count() == 0


def test_a_full_disk_keeps_the_rest_of_the_queue(spark):
    def fetch(url):
        if url == "u2":
            raise ValueError("HTTP 404")
        if url == "u4":
            raise OSError("local disk reserve reached")

    queue = spark.createDataFrame([(i, f"u{i}") for i in range(8)], "ord int, url string").coalesce(1)
    tried = crawl.fetch_all(queue, fetch, 1).collect()
    errors = {r["url"]: r["error"] for r in tried}
    assert "disk reserve" in errors["u4"] and len(tried) == [r["url"] for r in tried].index("u4") + 1
    some = spark.createDataFrame([("u0", None), ("u1", None), ("u2", "HTTP 404"), ("u4", "local disk reserve reached")], "url string, error string")
    settled = crawl.settle(queue, some)
    assert {r["url"]: r["state"] for r in settled.collect()} == {"u0": "saved", "u1": "saved", "u2": "failed", "u4": "requeued", **{f"u{i}": "waiting" for i in (3, 5, 6, 7)}}
    assert [r["url"] for r in crawl.queue_after(settled).collect()] == ["u4", "u3", "u5", "u6", "u7"]
    phases = spark.createDataFrame([(1, 0, 2, "pdf"), (0, 1, 2, "pdf"), (0, 2, 2, "discover")], "p int, i int, n int, now string")
    assert [r[0] for r in phases.select(crawl.phase(F.col("p"), F.col("i"), F.col("n"), F.col("now"))).collect()] == ["pdf", "discover", "complete"]


def test_top_up_never_cuts_and_never_repeats(spark):
    chosen = spark.createDataFrame([(1, "a"), (5, "b")], "ord int, quote string")
    more = spark.createDataFrame([(1, "b"), (2, "c"), (3, "c"), (4, "d")], "ord int, quote string")
    assert [r["quote"] for r in evidence.top_up(chosen, more).orderBy("place").collect()] == ["a", "b", "c"]
    four = spark.createDataFrame([(i, str(i)) for i in range(4)], "ord int, quote string")
    assert evidence.top_up(four, more).count() == 4


class Echo:
    """Quotes the first source that it is shown."""

    def answer(self, system, contents):
        out = []
        for c in contents:
            asked = json.loads(c)
            assert len(asked["sources"]) <= 3 and all(len(s["text"]) <= 420 for s in asked["sources"])
            out.append("```json\n" + json.dumps({"evidence": [{"sourceId": asked["sources"][0]["id"], "quote": asked["sources"][0]["text"][:60]}]}) + "\n```")
        return out


class Fields:
    def answer(self, system, contents):
        return [json.dumps({"apa": c[:3], "bila": "2025"}) for c in contents]


def test_models_propose_and_fill_fields(spark):
    sources = spark.createDataFrame([(i, f"s{i}", f"{i} " + "kata " * 200) for i in range(1, 6)], "ord int, id string, text string")
    got = evidence.propose(sources, "apa", Echo).collect()
    assert [(r["ord"], r["source_id"], r["quote"]) for r in got] == [(0, "s1", ("1 " + "kata " * 200)[:60])]
    assert evidence.propose(sources, "apa", models.NullModel).count() == 0
    said = spark.createDataFrame([(1, "aaa" + "x" * 1397 + "bbb"), (2, None)], "id int, text string")
    fields = models.ask_fields(said, "id", "text", "", Fields).collect()
    assert {(r["id"], r["field"], r["value"]) for r in fields} == {(1, "apa", "aaa; bbb"), (1, "bila", "2025")}


def test_ink_like_numpy(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (12, 40, 3))
    rows = [(0, y, x, *map(int, image[y, x])) for y in range(12) for x in range(40)]
    table = spark.createDataFrame(rows, "image int, y int, x int, r int, g int, b int")
    grey = image[:, :, 0]
    want = (grey < min(190, int(np.percentile(grey, 30)) - 18)).sum(axis=1)
    got = ink.ink_counts(ink.grey_ink(table, grey="r"), ["image"], "y").orderBy("y").collect()
    assert [r["n_ink"] for r in got] == want.tolist()
    r, g, b = (image[:, :, i].astype(float) for i in range(3))
    mask = (image.max(axis=2) < 125) | ((r > 140) & (g < 110) & (b < 130) & (r > 1.7 * g))
    counts = ink.ink_counts(table.withColumn("ink", ink.colour_ink(F.col("r"), F.col("g"), F.col("b"))), ["image"], "x")
    assert [r["n_ink"] for r in counts.orderBy("x").collect()] == mask.sum(axis=0).tolist()
    columns = spark.createDataFrame([(0, x, n) for x, n in ((1, 50), (2, 60), (9, 2), (10, 9), (20, 1), (30, 14))], "image int, x int, n_ink int")
    runs = {(r["start"], r["end"], r["mass"], r["kept"]) for r in ink.column_groups(columns, ["image"], 3).collect()}
    assert runs == {(1, 2, 110, True), (9, 10, 11, False), (30, 30, 14, True)}


def test_samples_tokens_images_and_lookups(spark, tmp_path):
    x = np.arange(5000, dtype="<i2")
    frames = speech.nearest_frames(x)
    want = [int(x[i * 3 // 2]) if i * 3 // 2 < 5000 else 0 for i in range(frames.size)]
    assert frames.shape == (3, 1600) and frames.ravel().tolist() == want and speech.nearest_frames(x[:0]).shape == (0, 1600)
    words = ["a_b ćd 12½ ابجد", "", "_"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(T.word_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [re.findall(r"[^\W_]+", w) for w in words]
    html = ['<meta property="og:image" content="/a.png">', '<meta content="b.png?x=1&amp;y=2" property="og:image">', "<p>"]
    rows = spark.createDataFrame([(h, "https://site.example/d/e") for h in html], "h string, u string")
    assert [r[0] for r in rows.select(pages.preview_image(F.col("h"), F.col("u"))).collect()] == ["https://site.example/a.png", "https://site.example/d/b.png?x=1&y=2", None]
    urls = spark.createDataFrame([("data:image/png;base64,aGk=",), ("data:image/gif;base64,aGk=",), (None,)], "u string")
    assert [r[0] for r in urls.select(checks.image_error(F.col("u"))).collect()] == [None, "no image", "no image"]
    assert len(spark.createDataFrame([("x" * 600,)], "q string").select(checks.search_query(F.col("q"))).first()[0]) == 500
    assets = spark.createDataFrame([("a", "saved", "imej"), ("b", "failed", "imej"), ("c", "saved", "audio")], "id string, status string, category string")
    assert [r["id"] for r in media.saved(assets, "imej").collect()] == ["a"] and media.saved(assets).count() == 2
    assert media.lookup(assets, "id", "c").first()["category"] == "audio" and media.lookup(assets, "id", "z").count() == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"hello")
    (tmp_path / "f/b.bin").write_bytes(b"x" * 20)
    found = {r["path"][-5:]: (r["bytes"], r["sha256"] is None, r["error"]) for r in files.metered_files(spark, str(tmp_path / "f"), 10).collect()}
    assert found == {"a.bin": (5, False, None), "b.bin": (20, True, "too large")}
    assert files.import_status(spark, str(tmp_path / "none.json")).first()["documents"] is None
    (tmp_path / "s.json").write_text('{"documents": 4}')
    assert files.import_status(spark, str(tmp_path / "s.json")).first()["documents"] == 4


@pytest.mark.parametrize("last,text,control,want", [
    ("", "a", None, ("a", ("partial", "a"))), ("a", "a", None, ("a", None)), ("a", None, None, ("", ("partial", ""))), ("a ", None, "finish", ("", ("final", "a"))), (" ", None, "finish", ("", None)), ("a", None, "reset", ("", None)),
])
def test_transcript_step(last, text, control, want):
    assert step(last, text, control) == want


def test_transcripts_go_on_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, at = "k string, n int, text string, control string", str(tmp_path)
    for rows in ([("a", 1, "sa", None), ("a", 2, "sa", None), ("b", 1, "x", None)], [("a", 3, "saya", None), ("a", 4, None, "finish"), ("b", 2, None, "reset"), ("b", 3, None, "finish")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        out = stream_transcripts(spark.readStream.schema(schema).parquet(f"{at}/in"), "k", "n", "text", "control")
        run_available(out, lambda batch, n: batch.write.mode("append").parquet(f"{at}/out"), f"{at}/c")
    got = sorted((r["k"], r["n"], r["type"], r["text"]) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [("a", 1, "partial", "sa"), ("a", 3, "partial", "saya"), ("a", 4, "final", "saya"), ("b", 1, "partial", "x")]


def test_ink_of_whole_images_is_that_of_their_pixels(spark):
    """Counted in the image's row without a shuffle; images in several rows are put together."""
    import random

    from pyspark.sql import functions as F

    from tamarack.operators import ink

    rng = random.Random(5)
    rows = [(i, [rng.randrange(30, 256) for _ in range(rng.randrange(0, 40))]) for i in range(60)] + [(7, [40, 50, 60]), (None, [40, 255, 255, 255, 90]), (99, None), (98, [None, 3, 250])]
    images = spark.createDataFrame(rows, "image int, levels array<int>")
    pixels = images.select("image", F.posexplode("levels").alias("at", "grey")).withColumn("y", F.floor(F.col("at") / 8))
    want = ink.ink_counts(ink.grey_ink(pixels), ["image"], "y")
    got = ink.grey_line_counts(images, 8)
    assert got.columns == want.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "Exchange" not in ink.grey_line_counts(images.filter("image <> 7"), 8)._jdf.queryExecution().executedPlan().toString()


def test_ink_is_that_of_its_sql_where_the_percentile_is_nearly_whole(spark, tmp_path):
    """Every pair of levels whose percentile is or should be a whole number, with a pixel that is ink for one limit and not for the next."""
    duckdb = pytest.importorskip("duckdb")
    from tamarack.plans import collection

    texts = [":IIIII" + "S" * 13]  # 0.6 * 73 + 0.4 * 83: 76.99999999999999 in SQL, 77 by plain doubles
    for n in range(2, 24):
        at, part = divmod(3 * (n - 1), 10)
        for low in range(51, 123, 3):
            for high in range(low, 130):
                whole, rest = divmod(low * (10 - part) + high * part, 10)
                if rest == 0 and 0 <= low - (whole - 19):  # the pixel at whole - 19 stands among those up to the rank
                    texts.append(chr(whole - 19) * (at > 0) + chr(low) * (at + (at == 0)) + chr(high) * (n - 1 - at))
    texts += ["", "e", None, "ee", "\x00\x00z", "\U0001f600e\u0301" * 70]
    parted = [(3, ":III"), (3, "II" + "S" * 13), (4, "z" * 64), (4, "a" * 70)]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    for name, some in (("whole", rows), ("parted", rows + parted)):
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        want = con.execute(collection.ORACLE_SQL["grey_ink_rows"]).fetchall()
        assert sorted(map(tuple, collection.grey_ink_rows(spark, str(tmp_path / name)).collect())) == sorted(want)
        pixels = ink.ink_counts(ink.grey_ink(collection.pixels(spark, str(tmp_path / name))), ["image"], "y")
        assert sorted(map(tuple, pixels.collect())) == sorted(want)


def test_small_files_of_much_work_are_spread(spark, tmp_path):
    from tamarack.tables import ROWS, spread

    spark.range(3 * ROWS).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == 4
