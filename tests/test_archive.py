"""Chunks, search, evidence, OCR, addresses, signals: branches and refusals that whole tables don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions import numbers, speech, text, urls
from tamarack.models import ask
from tamarack.operators import crawl, evidence, media, ocr, search, signals
from tamarack.operators.chunk import chunk
from tamarack.sources import pages
from tamarack.streaming.utterances import UtteranceMachine

P = "p" * 2300


def plain_chunks(body):
    """The chunk rules, step by step."""
    out, held = [], ""
    for p in [x.strip() for x in body.split("\n") if x.strip()]:
        if len(held) + len(p) > 1500 and len(held) >= 60:
            out.append(held)
            held = ""
        if len(p) > 2200:
            for at in range(0, len(p), 1400):
                held = p[at : at + 1600]
                if len(held) >= 60:
                    out.append(held)
                    held = ""
        else:
            held += ("\n" if held else "") + p
    return out + [held] * (len(held) >= 60)


@pytest.mark.parametrize("body", ["", "short", "a" * 59, "a" * 60, "short\n" + P, "x" * 1000 + "\n" + "y" * 600 + "\n" + "z" * 10, "s\n" + "q" * 1800, "w" * 4220 + "\nnext one", "a" * 2201, "v" * 2810 + "\ntail " * 20, "b" * 1400 + "\n" + "c" * 101 + "\n" + "d" * 59])
def test_chunk_branches(spark, body):
    got = [r["text"] for r in chunk(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("chunk_no").collect()]
    assert got == plain_chunks(body)


def sources(spark, *texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "ord int, id string, text string")


QUOTE = "Pada tahun 1948 pentadbiran British telah mengisytiharkan darurat selepas beberapa siri keganasan dan ancaman terhadap keselamatan di Tanah Melayu."


def valid(spark, quote, body, question):
    proposals = spark.createDataFrame([(0, "0", quote)], "ord int, source_id string, quote string")
    return evidence.validate_evidence(proposals, sources(spark, body), question).count()


def test_only_substantial_exact_quotes_count(spark):
    assert valid(spark, "Darurat Tanah Melayu 1948", "Senarai Pameran\nDarurat Tanah Melayu 1948\nSejarah Malaysia", "Apa yang berlaku semasa Darurat Tanah Melayu pada tahun 1948?") == 0
    assert valid(spark, QUOTE, "Pendahuluan\n" + QUOTE + "\nPenutup", "Apa yang berlaku pada tahun 1948?") == 1
    assert valid(spark, QUOTE.replace("British", "Belanda"), QUOTE, "Apa yang berlaku pada tahun 1948?") == 0
    other = "They do not specify particular processes, as it is recognised that the techniques and strategies to achieve the outcomes will depend on the organisation and electronic records management system being used."
    assert valid(spark, other, other, "Apa yang berlaku semasa Darurat Tanah Melayu pada tahun 1948?") == 0


def test_evidence_comes_from_text_on_the_subject(spark):
    a = "Senarai kandungan sejarah yang diterbitkan pada tahun semasa."
    b = "Arkib Negara melaksanakan peranan dan tanggungjawabnya sebagai pusat arkib dan penyelidikan negara dengan mengamalkan konsep Total Archives. Arkib Negara menerima dan memperoleh rekod dalam pelbagai bentuk dan media."
    got = evidence.extract_evidence(sources(spark, a, b), "Apakah peranan Arkib Negara dalam penyelidikan sejarah?").collect()
    assert [r["id"] for r in got] == ["1"] and got[0]["quote"] in b
    furniture = "Pameran Maya ASEAN Darurat Tanah Melayu 1948 P.Ramlee Dimana Kan Ku Cari Ganti MTCP Pameran Watikah Kemerdekaan Subcategories Koleksi Poster Maya FaLang translation system by Faboba"
    assert evidence.extract_evidence(sources(spark, furniture), "Apa yang berlaku semasa Darurat Tanah Melayu pada tahun 1948?").count() == 0


def test_answers(spark):
    docs = spark.createDataFrame([(1, QUOTE + " " + "Rekod lain tentang pentadbiran dan sejarah negeri disimpan di sini."), (2, "Teks lain yang panjang tentang perkara berbeza sama sekali dan tidak berkaitan langsung.")], "doc_id long, text string")
    table = chunk(docs)
    kinds = [evidence.answer(table, q).first()["kind"] for q in ("darurat British keganasan", "zzz qqq", "buka carian")]
    assert kinds == ["grounded-excerpts", "no-evidence", "navigation"]
    reply = evidence.answer(table, "buka carian").first()
    assert reply["page"] == "arkib" and reply["text"].startswith("Saya buka carian arkib.") and reply["source_ids"] == ""
    assert search.search(table, "yang dan di").count() == 0


def test_a_null_model_answers_nothing(spark):
    assert ask(sources(spark, "a", None), "text", "").select("answer").distinct().first()["answer"] is None


WORD = ("a", 0, "سلام", [0.0, 0.0, 100.0, 100.0], 0.5)


def handwriting(spark, words, segments=(), lines=()):
    return ocr.validate(spark.createDataFrame([(list(words), list(segments), list(lines))], f"words {ocr.WORDS}, segments {ocr.SEGMENTS}, line_translations {ocr.LINES}")).first()


def test_handwriting_results(spark):
    assert handwriting(spark, [WORD])["error"] == ocr.NO_SEGMENTS
    assert handwriting(spark, [WORD[:2] + ("dua kata",) + WORD[3:]], [(["a"], "x", "x", "x")])["error"] == ocr.BAD_WORD
    assert handwriting(spark, [WORD], [(["a"], "Rumi setia", "BM moden", "English")])["error"] == ocr.NO_SEGMENTS
    words = [("l0w0", 0, "مانيس", [10.0, 10.0, 100.0, 50.0], 0.9), ("l1w1", 1, "هياسن", [10.0, 60.0, 100.0, 100.0], 0.9)]
    r = handwriting(spark, words, [(["l0w0"], "manis", "manis", "sweet"), (["l1w1"], "hiasan", "hiasan", "decoration")], [(0, ["l0w0"], "sweet maiden"), (1, ["l0w0", "l1w1"], "invalid")])
    assert r["error"] is None and [s["line"] for s in r["segments"]] == [0, 1] and [t["en"] for t in r["line_translations"]] == ["sweet maiden"]


def test_scaled_boxes(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (1.0, 2.0)], 0, 0, 100, 200), ([(0.0, 0.0), (500.0, 90.0)], 10, 0, 100, 200)], "p array<struct<x:double,y:double>>, l int, t int, w int, h int")
    got = [r["b"] for r in df.select(ocr.scaled_box(F.col("p"), F.col("l"), F.col("t"), F.col("w"), F.col("h")).alias("b")).collect()]
    assert got == [[10, 10, 11, 11], [100, 0, 1000, 450]]


def test_speech_parts_join_to_the_text():
    body = "Petikan terus daripada dokumen: sejarah. " * 12 + "Ayat kedua yang panjang, dengan koma; dan noktah! " * 8
    parts = speech.split_speech(body)
    assert " ".join(" ".join(parts).split()) == " ".join(body.split()) and len(parts) > 1 and all(len(p) <= 210 for p in parts)
    assert speech.split_speech(None) == [] and speech.split_fixed("") == []
    fixed = speech.split_fixed(body)
    assert " ".join(fixed) == " ".join(body.split()) and all(len(p) <= 281 for p in fixed)


def test_samples(spark):
    x = np.linspace(-1, 1, 480).astype(np.float32)
    assert np.abs(speech.decode_pcm(speech.encode_pcm(x)) - x).max() < 1e-4
    assert len(speech.resample_box(x, 48_000, 16_000)) == 160 and speech.resample_box(np.ones(30), 3, 1) == pytest.approx(np.ones(10))
    assert len(speech.resample_linear(x, 48_000, 16_000)) == 160
    pcm = speech.encode_pcm(x)
    frame = b"\x02\x01\x00\x00\xc0\x5d\x00\x00" + pcm
    r = spark.createDataFrame([(speech.wav_bytes(pcm, 24_000), frame)], "w binary, f binary").select(speech.wav_samples("w").alias("s"), *[c.alias(n) for c, n in zip(speech.frame_header("f"), ("seq", "rate"))]).first()
    assert bytes(r["s"]) == pcm and (r["seq"], r["rate"]) == (258, 24_000)
    level = signals.frames_to_rms(spark.createDataFrame([(pcm,), (b"",), (b"x",)], "pcm binary")).collect()
    assert level[0]["rms"] == pytest.approx(float(np.sqrt(np.mean(x * x))), rel=1e-3) and level[1]["rms"] is None and level[2]["rms"] is None


def test_utterance_machine():
    m = UtteranceMachine(0.5)
    for v in [0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, *[1] * 260]:
        m.frame(v)
    finals = [e[3] for e in m.out if e[0] == "final"]
    assert finals == [9, 250] and [e[3] for e in m.out if e[0] == "block"][:3] == [6, 3, 6] and m.frames == 10
    m.reset()
    m.finish()
    assert m.out[-1][0] != "final" or m.out[-1][3] == 250


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 1.9, 2.5, 0], float)
    assert signals.find_peaks(x, 0.5, 1).tolist() == [1, 3, 8] and signals.find_peaks(x, 0.0, 1).tolist() == [1, 3, 6, 8] and signals.find_peaks(x, 0.0, 4).tolist() == [3, 8]
    assert signals.find_peaks(np.zeros(0), 0, 1).tolist() == []


def test_media_duplicates(spark):
    rows = [(1, "http://a/x?1", "s", "f1"), (2, "http://a/x?2", "s", "f2"), (3, "http://a/x#p", "s", "f1"), (4, "http://a/x?3", "t", "f4"), (5, "http://a/y", "s", "f5")]
    got = {r["ord"]: (r["action"], r["result_url"]) for r in media.dedupe(spark.createDataFrame(rows, "ord int, url string, sha256 string, filename string")).collect()}
    assert got == {1: ("keep", "http://a/x"), 2: ("remove", None), 3: ("drop", None), 4: ("keep_own", "http://a/x?3"), 5: ("keep", "http://a/y")}


def test_robots(spark):
    lines = ["User-agent: *", "User-agent: x", "Disallow: /a", "user-agent: *", "Disallow: /b:c # why", "Disallow:"]
    rules = crawl.robots_rules(spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "site string, n int, line string"))
    assert [r["rule"] for r in rules.collect()] == ["/b:c"]


def test_pages(spark):
    html = '<html><head><title>T &amp; t</title></head><body><nav>menu</nav><h1>Big <b>one</b></h1><p>First<br>line</p><script>x("</p>")</script><p>Second</p></body></html>'
    r = spark.createDataFrame([(html,)], "html string").select(pages.title(F.col("html")).alias("t"), pages.main_text(F.col("html")).alias("m"), pages.main_text_parsed("html").alias("q")).first()
    assert r["t"] == "Big one" and "menu" not in r["m"] + r["q"] and [x for x in r["m"].split("\n") if x] == [x for x in r["q"].split("\n") if x and x != "T & t"] or "T & t" in r["q"]
    links = pages.links(spark.createDataFrame([("http://h/a/b?x", '<a href="c">1</a><a class=k href="/d?e=1&amp;f=2">2</a><a href="//o/p">3</a><a href="mailto:x@y.z">4</a><a href="#top">5</a>')], "url string, html string"))
    assert [r["link"] for r in links.collect()] == ["http://h/a/c", "http://h/d?e=1&f=2", "http://o/p", "http://h/a/b#top"]


def test_text_functions(spark):
    row = spark.createDataFrame([("a <b> & 'c'", "<think>x</think>```json\n{\"a\":1}\n```", "satu dua tiga empat", "Saya dan kami.")], "h string, j string, s string, r string")
    r = row.select(text.escape_html(F.col("h")), text.model_json(F.col("j")), text.shorten(F.col("s"), 10), text.report_voice(F.col("r")), text.malay_date(F.lit("2026-09-25").cast("date")), numbers.number_words(F.lit(45_678)), urls.extension(F.lit("http://a/b"), F.lit("image/gif"))).first()
    assert list(r) == ["a &lt;b&gt; &amp; &#39;c&#39;", '{"a":1}', "satu dua…", "Pengadu dan para pengadu", "25 September 2026", "empat puluh lima ribu enam ratus tujuh puluh lapan", ".gif"]
