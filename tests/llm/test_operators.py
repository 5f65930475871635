"""Each operator against a brute-force version, an exact round trip, and the cases that its docstring defines."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarack.llm import exact_dedup, mixing, near_copies, packing, pii, quality_classifier, quality_rules, simhash, token_files, tokens, toxicity, warc
from tamarack.llm.common import new_dir
from tamarack.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))
ODD = [
    (1, "Hello World", "en", "a", 11), (2, "hello world", "en", "a", 11), (3, None, "en", None, None), (4, "", "de", "b", 0), (5, LONG, None, "b", len(LONG)), (6, "HELLO WORLD", "en", "a", 11), (7, "É tude  x\n\n y", "fr", "c", 8),
    (8, "hello world", "en", "a", 11), (9, "éa éb", "fr", "c", 5), (10, "Éa éb", "fr", "c", 5), (11, "\t \n", "en", "", 3), (12, "x" * 5000, "en", "d", 5000), (13, "end <|endoftext|> of it", "en", "d", 23),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_equals_the_library(name):
    t, e = tokenizer(name), tokens.WordEncoder(name)
    rng = random.Random(1)
    letters = "abc dé.,!  \n\t%&Ü'1  ́ßs"
    texts = ["", " ", "a   b", "x \n y", "<|endoftext|> a", "it's I'LL don 't", "q" * 200, "foo.\nBar foo,\nBar. \n z", "\n\na", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000))]
    small = tokens.WordEncoder(name, most=500)  # room is made all the time
    for part in (texts[:50], texts, texts[::-1]):
        want = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(part, add_special_tokens=False)]
        assert e.encode(part) == want
        assert [i for at in range(0, len(part), 40) for i in small.encode(pa.array(part[at : at + 40]))] == want


def check_packing(rows, length=1024):
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return sum(r["length"] for r in rows), len(seen)


def test_packing(spark, docs):
    rows = packing.packed(docs).collect()
    used, n = check_packing(rows)
    t = tokenizer("byte_bpe_50k.json")
    for doc_id, text, *_ in ODD:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 1024)) and all(r["doc_tokens"] == len(ids) for r in mine)
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine]


def test_packing_sequences_hold_the_ids(spark, docs):
    found = packing.sequences(docs.filter("doc_id <> 5")).collect()
    t = tokenizer("byte_bpe_50k.json")
    want = sorted(i for d, text, *_ in ODD if d != 5 for i in [*t.encode(text or "", add_special_tokens=False).ids, 0])
    assert sorted(i for r in found for i in r["ids"][: r["n_tokens"]]) == want
    assert all(len(r["ids"]) == 1024 or (r["n_tokens"] & (r["n_tokens"] - 1)) == 0 for r in found)


def test_first_fit_decreasing_equals_the_plain_way():
    rng = random.Random(2)
    for n in (0, 1, 2, 77, 300):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        free, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, room in enumerate(free) if room >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            want[i] = (k, 100 - free[k])
            free[k] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == want
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([101], 100)


def test_packing_wastes_little(spark):
    rng = random.Random(3)
    rows = [(i, i, 0, n, 0, n) for i, n in enumerate(rng.randint(1, 1024) for _ in range(5000))]
    cut = spark.createDataFrame(rows, "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long")
    used, n = check_packing(packing.pack(cut, 5000, group=1000).collect())
    assert used > 0.97 * 1024 * n


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def brute_dedup(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(lower(t), []).append(d)
    return {d: (max(groups[lower(t)]), len(groups[lower(t)]), d == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t, *_ in rows}


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_exact_dedup(spark, docs, most_bytes):
    digests = exact_dedup.with_digest(docs).select("doc_id", "text_sha256", F.lit(1).alias("kept"))
    found = exact_dedup.annotate(digests, 12, most_bytes=most_bytes).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found} == brute_dedup(ODD)


def test_exact_dedup_filter_knows_every_repeat(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63 - 1, 4000)
    values = np.concatenate([h, h[:500], h[:100], np.full(3000, 7)])
    values = np.concatenate([values, rng.integers(-(2**63), 2**63 - 1, 20_000)])  # several blocks
    df = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(5)
    assert exact_dedup.filter_blocks(len(values)) == 6
    for most_bytes in (1 << 20, 16384, 0):  # in one pass, in passes of two blocks, of one
        found = exact_dedup.marked_repeats(df, "h", len(values), most_bytes)
        known = {r["h"] for r in found.filter("_dedup_maybe").collect()}
        assert found.count() == len(values) and set(h[:500].tolist()) | {7} <= known and len(known) < 900


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "Same", "x")] * 50 + [(None, "same", "y"), (None, "null id", "z"), (None, "NULL ID", "z"), (3, "alone", "x"), (3, "other", "x"), (4, None, "x"), (5, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(4)
    kept = exact_dedup.exact_dedup(frame).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower(), r["keep_id"]) for r in kept) == [(0, "null id", "z"), (1, "same", "x"), (3, "alone", "x"), (3, "other", "x"), (5, "", "x")]
    digests = exact_dedup.with_digest(frame).select("doc_id", "text_sha256")
    for r in exact_dedup.annotate(digests, 57).groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect():
        assert r["n"] == 1
    words = exact_dedup.exact_dedup(spark.createDataFrame([("a", "x"), ("b", "X"), ("c", "y")], "doc_id string, text string"))
    assert sorted(r["doc_id"] for r in words.collect()) == ["b", "c"]


def test_exact_dedup_keeps_rows_whole(spark, docs, empty):
    kept = exact_dedup.exact_dedup(docs.withColumn("keep_id", F.lit("mine")))
    assert kept.columns == [*docs.columns, "keep_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in brute_dedup(ODD).items() if v[2])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_token_files(spark, docs, empty):
    directory = new_dir(spark, "t")
    shards = token_files.write(docs, directory, shards=3)
    got = sorted(tuple(r) for r in token_files.read(shards, directory, with_ids=False).collect())
    t, start, want = tokenizer("word_bpe_49k.json"), 0, []
    for d, text, *_ in sorted(ODD):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    some = token_files.read_some(spark, shards, directory, spark.createDataFrame([(2,), (7,), (99,)], "doc_id long")).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in some} == {d: [*t.encode(dict((x[0], x[1]) for x in ODD)[d], add_special_tokens=False).ids, 2] for d in (2, 7)}
    other = new_dir(spark, "t")
    assert token_files.read(token_files.write(empty, other), other).count() == 0


def test_token_files_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "same text")] * 300 + [(None, "none"), (None, None), (7, "other"), (1, "")]
    directory = new_dir(spark, "t")
    shards = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), directory, shards=4)
    assert max(r["n_docs"] for r in shards.collect()) < 200  # a row that repeats is split over shards
    got = sorted(token_files.read(shards, directory).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, *[5] * 300, 7]
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got)]))[:-1]
    some = token_files.read_some(spark, shards, directory, spark.createDataFrame([(5,), (1,), (6,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in some) == [1, *[5] * 300]


def test_packing_of_repeated_rows_null_ids_and_the_empty_table(spark, empty):
    rows = [(5, "same text", 1)] * 40 + [(None, "none", 2), (None, None, 3), (7, LONG, 4)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    check_packing(found)
    assert sum(r["doc_id"] == 5 for r in found) == 40 and sum(r["doc_id"] is None for r in found) == 2
    assert sum(r["length"] for r in found if r["doc_id"] == 7) == next(r["doc_tokens"] for r in found if r["doc_id"] == 7)
    assert packing.packed(empty).count() == 0


def test_a_shard_is_plain_zstandard_and_shows_damage():
    import zstandard

    out = io.BytesIO()
    documents = [(i, np.arange(i, i + 50 * i, dtype="<u4").tobytes()) for i in range(1, 6)]
    frames = ((d, *token_files.make_frame(token_files.compressor(), ids, "<u2")) for d, ids in documents)
    assert token_files.write_shard(out, frames, "<u2") == (5, 750)
    raw = out.getvalue()
    whole = b"".join(np.frombuffer(b, "<u4").astype("<u2").tobytes() for _, b in documents)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == whole

    def reader(data):
        return token_files.ShardReader(pa.PythonFile(io.BytesIO(data), "r"))

    assert list(reader(raw).all(block=64)) == documents and list(reader(raw).requested([3])) == [documents[2]]
    broken = reader(raw)
    broken.sums = broken.sums + 1
    with pytest.raises(ValueError):
        broken.document(0)


BASE = [
    ("mail a.b@c.de, x@y.z.w and no@dot", [("email", 5, 13), ("email", 15, 22)]), ("10.0.0.255 or 1.2.3.256 or 1.2.3.4.5.6.7.8", [("ip", 0, 10), ("ip", 27, 34), ("ip", 35, 42)]),
    ("4539 1488 0343 6467 and 1234567812345678", [("card", 0, 19)]), ("+1 (523) 555-1055 and +12", [("phone", 0, 17)]), ("", []), ("@@a@@b.c@d.e", [("email", 5, 12)]), ("é +49 30 1234567.", [("phone", 2, 16)]),
]


def plain_spans(text):
    """The base patterns as they are defined, matched with the regular expression module alone."""
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_spans():
    for text, want in BASE:
        assert pii.base_spans(text) == want
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..--@@ab %+ ()é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 1000) == []


def test_pii_bootstrapping_finds_what_the_patterns_miss(spark):
    rows = [(i, f"please call tel: +1 555 010 {1000 + i} now or write to agent{i}@mail.example.com today") for i in range(30)]
    rows += [(100, "please call tel: 555-0199-777 now"), (101, "please write to agent77@localhost today"), (102, "the price was 555-0199-777 units"), (103, None), (104, "")]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {d: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for d, r in found.items()}
    assert spans[101] == [("email", 16, 33)] and spans[100] == [("phone", 17, 29)] and spans[102] == [] and spans[103] == spans[104] == []
    for i in range(30):
        assert spans[i] == pii.base_spans(rows[i][1])
    masked = dict(pii.redact(spark.createDataFrame(rows[:1] + rows[31:32] + rows[33:34], "doc_id long, text string")).collect())
    assert "agent0" not in masked[0] and masked[103] == ""


def test_pii_candidates_with_blanks_and_in_long_tokens(spark):
    rows = [(i, f"please call tel: +1 555 010 {1000 + i} now") for i in range(30)]
    rows += [(i, f"see http://a.example/?name=n{i}&tel=+1555010{1000 + i}&page=2") for i in range(30, 60)]
    long = "see http://a.example/" + "p" * 80 + "?name=n&tel=555-0199-777&page=2"
    rows += [(100, "please call tel: (020) 7946 0958 now"), (101, "please call tel: 012 345 6789 now"), (102, long), (103, "rows 012 345 6789 of it")]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {d: [(s["kind"], dict(rows)[d][s["start"] : s["end"]]) for s in r["spans"]] for d, r in found.items()}
    assert texts[100] == [("phone", "(020) 7946 0958")] and texts[101] == [("phone", "012 345 6789")]
    assert texts[102] == [("phone", "555-0199-777")] and texts[103] == []
    assert pii._candidates("1 " * 200_000 + "a" * 300_000 + "=1" * 100_000, []) == []


def water_fill(sizes, weights, total, epochs):
    """Targets in proportion to the weights, none above epochs times its size, by clamping one round after another."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if share * weights[i] >= epochs * sizes[i]]
        for i in full or free:
            target[i] = float(epochs * sizes[i]) if full else share * weights[i]
        if not full:
            break
        left = max(left - sum(target[i] for i in full), 0.0)
        free.difference_update(full)
    return target


def test_pii_recall_and_precision_of_added_spans(spark):
    """Planted disguised addresses and other phone forms behind the words that seeds stand behind, of any length; others stay out."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    rows, planted = [], set()
    for i in range(3000):
        text, kind = [word() for _ in range(rng.randint(5, 30))], i % 6
        if kind == 0:
            text += ["please", "write", f"{word()}@{word()}.com"]
        elif kind == 1:
            planted.add(i)
            text += ["please", "write", f"{word() * (20 if i % 60 == 1 else 1)}[at]{word()}.com"]
        elif kind == 2:
            text += ["call", "me:", f"+49 30 {rng.randint(10**6, 10**7 - 1)}"]
        elif kind == 3:
            planted.add(i)
            text += ["call", "me:", f"0{rng.randint(100, 999)}-{rng.randint(10**5, 10**6 - 1)}"]
        elif kind == 4:
            text += ["item", f"{rng.randint(10**7, 10**8)}"]  # a number that no seed's context announces
        rows.append((i, " ".join(text + [word() for _ in range(rng.randint(1, 9))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(frame).filter(F.size("spans") > F.size("base")).select("doc_id").collect()
    found = {r["doc_id"] for r in got}
    assert len(found & planted) > 0.95 * len(planted) and len(found - planted) < 0.01 * len(rows)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(frame.limit(600)).collect()}
    assert all(("[at]" in t) <= (i not in found) for i, t in masked.items() if i % 6 == 1)
    assert pii.find(frame.limit(0)).count() == 0


def test_water_filling(spark):
    assert water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    rng = random.Random(6)
    for names in (["b", None, "a", "é", "z"], [f"s{i:02d}" for i in range(25)]):
        sizes = {s: rng.choice([0, 5, 100, 1000]) + rng.randint(0, 9) for s in names}
        rows = [(s, part) for s, n in sizes.items() for part in (n - n // 3, n // 3)]
        got = {r["_mix_s"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long"), "size", "source").collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
        assert got == {s: pytest.approx(t) for s, t in zip(order, want)}


def check_mix(plan):
    """Each source misses its target by at most half of its smallest document that could still be taken."""
    for s in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == s]
        left = mine[0]["_mix_target"] - sum(r["size"] * r["_mix_times"] for r in mine)
        whole = min(r["_mix_times"] for r in mine)
        could = [r["size"] for r in mine if r["_mix_times"] == whole and r["size"]]
        assert abs(left) <= min(could, default=max(r["size"] for r in mine)) / 2 + 1 and all(0 <= r["_mix_times"] <= 2 for r in mine)


def test_mixing(spark, docs, empty):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randint(1, 6) for _ in range(int(rng.lognormvariate(4, 1)))), "en", rng.choice(["a"] * 6 + ["b", "c", None]), 0) for i in range(3000)]
    rows += [(3000 + i, "w " * rng.randint(1, 3000), "en", f"few{i % 4}", 0) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.plan_mix(sized).collect()
    assert {tuple(r) for r in plan} == {tuple(r) for r in mixing.plan_mix(sized.repartition(7)).collect()}
    check_mix(plan)
    taken = {r["doc_id"]: r["count"] for r in mixing.mix(df).groupBy("doc_id").count().collect()}
    check_mix([r.asDict() | {"_mix_times": taken.get(r["doc_id"], 0)} for r in plan])
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_mixing_of_repeated_rows_and_empty_texts(spark):
    rows = [(1, "a b c", "x")] * 30 + [(i, "d e", "x") for i in range(2, 60)] + [(100, None, "x"), (101, "", "y"), (102, " ", "y")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("doc_id").count().collect()
    times = {r["doc_id"]: r["count"] for r in got}
    assert times[1] in (30, 60) and all(times.get(i, 0) in (0, 1, 2) for i in range(2, 60))
    assert sum(3 * n if i == 1 else 2 * n for i, n in times.items() if i < 100) in (306, 307, 308, 309)  # 150% of 206 words
    nothing = spark.createDataFrame([(1, "", "x"), (2, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(nothing).count() == 0


def test_toxicity_learns_pairs_that_no_linear_model_can(spark, empty):
    """Either word alone makes label 1 and both make 0, so each is neutral alone; held-out rows are scored."""
    rng = random.Random(8)
    words = [f"n{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text = rng.sample(words, 25)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text += ["swine"] * insult + ["groupname"] * group
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult != group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = toxicity.train(docs, marks, ~held)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.filter(held), machine).collect()}
    y = dict(labels)
    assert np.mean([(s >= 0.5) == bool(y[d]) for d, s in got.items()]) > 0.97
    linear = np.linalg.lstsq(x := np.array([[1.0, "swine" in t, "groupname" in t] for _, t in rows]), np.array([y[d] for d, _ in rows]), rcond=None)[0]
    assert np.mean([(v >= 0.5) == bool(y[d]) for v, (d, _) in zip(x @ linear, rows)]) < 0.65
    odd = toxicity.score(spark.createDataFrame([(1, None, "mine"), (2, "", "x"), (3, "ZZZ", "x"), (3, "ZZZ", "x"), (4, "swine " * 50_000, None)], "doc_id long, text string, score string"), machine).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and len({r["score"] for r in odd if r["doc_id"] == 3}) == 1
    assert toxicity.score(empty, machine).count() == 0
    twice = toxicity.train(docs, marks.union(marks), ~held)
    assert np.mean([(twice.score(twice.numbers(t)) >= 0.5) == bool(y[d]) for d, t in rows]) > 0.97
    none = toxicity.train(docs, marks.filter("toxic = 0"), ~held)
    assert none.score(none.numbers("swine groupname")) < 0.01


def brute_print(text):
    import xxhash

    w = lower(text).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {d: brute_print(t) for d, t, *_ in ODD}


@pytest.mark.parametrize("hot", [4096, 3])
def test_bk_tree_links_equal_all_pairs(spark, hot):
    rng = random.Random(9)
    values = {0}
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(10):
            values.add(v)
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s, s) for s in signed.values()], "fp long, node long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash.links(df, 3, hot)).collect()}
    want = brute_components(sorted(values))
    groups = lambda m: sorted(sorted(v for v in values if m(v) == k) for k in {m(v) for v in values})
    assert groups(lambda v: parts.get(signed[v], signed[v])) == groups(lambda v: want[v])


def test_near_duplicates(spark, docs, empty):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    prints = {d: brute_print(t) for d, t, *_ in ODD}
    want = brute_components(sorted(set(prints.values())))
    assert got == {d: min(e for e in prints if want[prints[e]] == want[p]) for d, p in prints.items()}
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_near_copy_stays(spark, empty):
    rng = random.Random(10)
    rows, copies = [], set()
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((10 * i, " ".join(w), "en", "s", 0))
        for k in range(1, 4):
            v = list(w)
            v[rng.randrange(200)] = "changed"
            v[rng.randrange(200)] = "other"
            rows.append((10 * i + k, " ".join(v), "en", "s", 0))
            copies.add(10 * i + k)
    rows += [(1000, "", "en", "s", 0), (1001, None, "en", "s", 0), (1002, "one", "en", "s", 0)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS))
    left = {r["doc_id"] for r in kept.collect()}
    assert {r[0] for r in rows} - copies <= left and len(left & copies) <= 2
    assert simhash.one_of_each(empty).count() == 0


def test_similar_groups_equals_all_pairs():
    rng = random.Random(11)
    sets = []
    for _ in range(30):
        s = set(rng.sample(range(10**6), 60))
        for _ in range(4):
            sets.append(np.array(sorted(s)))
            s = set(rng.sample(sorted(s), len(s) - rng.randint(0, 8))) | set(rng.sample(range(10**6), rng.randint(0, 8)))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert near_copies.similar_groups(sets) == root


def test_near_copies_in_bounded_chunks_equals_all_pairs(spark):
    """Candidate groups far larger than a chunk: dense copies, chains, texts just under the limit, equal sets, repeated ids."""
    rng = random.Random(12)
    rows, sets = [], {}

    def add(component, words):
        doc = len(rows)
        rows.append((doc, component, " ".join(words).encode()))
        sets[doc] = component, set(near_copies.shingle_set(rows[-1][2]).tolist())

    for component in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):  # dense: a few edits of one text; component 2: many more, so near the limit
            v = list(base)
            for _ in range(rng.randint(0, 2) if component < 2 else rng.randint(1, 3)):
                v[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            add(component, v)
        for _ in range(40):  # a chain: each is close to the one before only
            base = [w if rng.random() > 0.02 else f"c{rng.randrange(10**6)}" for w in base]
            add(component, base)
    add(9, ["just", "two"])
    add(9, ["just", "two"])
    add(9, ["others"])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            (c, a), (d, b) = sets[i], sets[j]
            if c == d and len(a & b) >= 0.8 * len(a | b) and root[i] != root[j]:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    gone = {i for i, r in enumerate(root) if r != i}
    frame = spark.createDataFrame(rows + rows[:5], "doc_id long, component long, t binary")
    for chunk in (1 << 17, 2000, 300):
        assert {r["doc_id"] for r in near_copies.near_copies(frame, chunk=chunk).collect()} == gone
    assert near_copies.near_copies(frame.limit(0)).count() == 0
    kept = [s for _, s in sets.values()][:40]
    for a in kept:
        for b in kept:
            if len(a & b) >= 0.8 * len(a | b):
                heads = [set(near_copies.prefix_of(np.array(sorted(s))).tolist()) for s in (a, b)]
                assert heads[0] & heads[1]


def test_one_of_each_finds_added_and_cut_passages(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    common = " ".join(rng.choices(words, k=30))  # a passage of many texts
    rows, pairs = [], []
    for i in range(120):
        own = rng.choices(words, k=rng.randint(40, 400))
        more = rng.choices(words, k=int(len(own) * rng.choice([0.05, 0.1, 0.15, 0.2])))
        at = rng.choice([0, len(own), len(own) // 2])
        rows += [(2 * i, " ".join(own) + " " + common * (i % 3 == 0)), (2 * i + 1, " ".join(own[:at] + more + own[at:]) + " " + common * (i % 3 == 0))]
    sets = [set(near_copies.shingle_set(t.encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))  # components of all pairs, by brute force
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
                pairs.append((i, j))
    assert len(pairs) > 60
    got = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == set(root)


PAGES = [
    (3, "http://a.example/1", "<p>" + "same " * 50), (1, "http://a.example/2", "<p>" + "same " * 50), (2, None, "short"), (4, "http://a.example/\r\nX: y", "short"), (5, "u", None), (6, "u", ""),
    (7, "u", "quoted WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3), (8, "u", "é" * 90_000), (9, "u", "WARC/1.1\r\nContent-Length: 7\r\n\r\n" * 200),
]


@pytest.mark.parametrize("block", [8 << 20, 2000, 137])
def test_warc_round_trip(spark, block):
    directory = new_dir(spark, "w")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2), directory)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, directory, block=block).collect()}
    want = {}
    for p, _, h in PAGES:
        b = (h or "").encode()
        first = min(q for q, _, g in PAGES if g == h)
        again = len(b) >= 100 and first != p
        want[p] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)
    assert got == want


@pytest.mark.parametrize("block", [70_000, warc.BLOCK])
def test_warc_headers_of_any_length(spark, block):
    # a header of 300,000 bytes, one whose end lies just beyond the first read, and lines that look like heads
    rows = [(i, f"http://a/{i}", "before" * 40 + str(i)) for i in range(5)]
    rows += [(5, "http://a/" + " " * 100_000, "long" * 50), (6, "http://a/" + "y" * (64 << 10), "x:WARC/1.1\r\n" * 500), (7, "u" * 200_000 + "WARC/1.1", None)]
    rows += [(i, f"http://a/{i}", "after" * 40 + str(i)) for i in range(8, 12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    directory = new_dir(spark, "warc-test")
    assert sum(n for _, n in warc.write(pages, directory)) == 12
    got = {r["page_id"]: (r["url"], bytes(r["payload"]).decode()) for r in warc.read(spark, directory, with_payload=True, block=block).collect()}
    assert got == {i: (u.replace(" ", "%20"), h or "") for i, u, h in rows}
    assert warc.dedup_archive(pages).count() == 12


def test_warc_lost_records_are_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    write = warc.write
    monkeypatch.setattr(warc, "write", lambda *a, **b: [(p, n + 1) for p, n in write(*a, **b)])
    with pytest.raises(ValueError, match="records were read"):
        warc.dedup_archive(pages)


def test_warc_payloads_and_empty_table(spark):
    directory = new_dir(spark, "w")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), directory)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, directory, with_payload=True).collect() if r["record_type"] == "response"}
    assert got[7] == PAGES[6][2] and got[5] == "" and 99 not in got
    assert warc.dedup_archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_rules(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "é ", " ", "#", "a b c d e f ", "\x1c", "\n"]) for _ in range(rng.randrange(60)))
        m = quality_rules.measure(text)
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute_rules(text)
        assert m["base_failed"] == (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]) and not (m["base_failed"] and m["kept"])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs.withColumn("kept", F.lit("mine"))).collect()}
    assert got[5]["kept"] is True and got[3]["kept"] is False and got[3]["n_words"] == 0 and got[5]["n_words"] == 30_000
    assert quality_rules.quality_rules(empty).count() == 0


def test_repetition_coverage_fails_repeated_text():
    clean = " ".join(f"w{i}" for i in range(100))
    assert quality_rules.measure(clean)["kept"] and not quality_rules.measure("one two three four five six seven " * 20)["kept"]


def test_quality_classifier(spark, empty):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tau"]) + ("%%%" if bad else "") for _ in range(rng.randint(15, 60)))
        rows.append((i, text, "en", "s", 0))
        if i % 2:
            labels.append((i, int(not bad)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.choose(docs, marks).collect()}
    unseen = [i for i in range(600) if not i % 2]
    assert np.mean([got[i] == bool(i % 5) for i in unseen]) > 0.97 and got[1000] is False and got[1001] is False
    assert got == {r["doc_id"]: r["kept"] for r in quality_classifier.choose(docs.repartition(7), marks).collect()}
    kept = quality_classifier.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())
    assert quality_classifier.choose(empty, marks).count() == 0


def test_importance_and_gumbel_top_k_equal_brute_force(spark):
    """Log importances from plain counts, and a sample that follows its weights."""
    rng = random.Random(23)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 3 else "efghijkl") * 2 for _ in range(rng.randint(1, 30))), "en", "s", 0) for i in range(90)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 90, 2)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    scored, sharp, level = quality_classifier.weigh(docs, marks)
    got = {r["_key_id"]: r for r in scored.collect()}
    # the half of the labels that makes the model, as Spark hashes ids
    half = {r["i"] for r in spark.createDataFrame([(i,) for i, y in labels if y], "i long").filter(F.pmod(F.xxhash64(F.lit(quality_classifier.SEED), "i"), F.lit(2)) == 0).collect()}
    grams = {i: quality_classifier.buckets(t).tolist() for i, t, *_ in rows}
    count = lambda ids: {b: sum(grams[i].count(b) for i in ids) for b in {b for i in ids for b in grams[i]}}
    raw, target, n, smooth = count(grams), count(half), quality_classifier.BUCKETS, quality_classifier.SMOOTH
    total, wanted = sum(raw.values()), sum(target.values())
    share = {b: (c + smooth) / (total + smooth * n) for b, c in raw.items()}
    ratio = {b: np.log((target.get(b, 0) + smooth * n * q) / (wanted + smooth * n) / q) for b, q in share.items()}
    for i, g in grams.items():
        assert abs(got[i]["log_importance"] - sum(ratio[b] for b in g)) < 1e-6 and got[i]["n_grams"] == len(g)
        assert abs(got[i]["log_weight"] - sharp * sum(ratio[b] for b in g) / len(g)) < 1e-6
    # weights 1, 2, 4 in thirds of 6,000 rows, 1,500 taken: shares as drawing without replacement gives them
    drawn = spark.range(6000).withColumn("w", F.log(F.pow(F.lit(2.0), F.col("id") % 3))).withColumn("key", F.col("w") + quality_classifier.gumbel("id"))
    kept = quality_classifier.top_k(drawn, "key", 1500).filter("kept").groupBy((F.col("id") % 3).alias("third")).count().collect()
    kept = {r["third"]: r["count"] for r in kept}
    order = np.random.default_rng(1)
    keys = np.log(np.tile([1.0, 2.0, 4.0], 2000)) + order.gumbel(size=(40, 6000))
    mean = [np.mean([(np.argsort(-k)[:1500] % 3 == third).sum() for k in keys]) for third in range(3)]
    assert sum(kept.values()) == 1500 and all(abs(kept[third] - mean[third]) < 90 for third in range(3))


def test_filters_know_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(29)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tau"]) for _ in range(40))
    bad = lambda: " ".join("%%% zzz" for _ in range(30)) + str(rng.random())
    rows = [(str(i), good() if i % 4 else bad()) for i in range(200)]
    labels = [(str(i), int(i % 4 > 0)) for i in range(160)]
    extra = [(None, bad()), (None, good()), ("7", bad()), ("7", good())]
    docs, marks = spark.createDataFrame(rows + extra, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, quality int")
    left = [(r["doc_id"], r["text"]) for r in quality_classifier.keep_good(docs, marks).collect()]
    assert sum("%%%" in t for _, t in left) <= 2 and extra[0] not in left and extra[2] not in left and extra[1] in left and extra[3] in left and len(left) > 140
    w = [f"w{i}" for i in range(300)]
    near = [(None, " ".join(w)), ("b", " ".join(w[:-2] + ["x", "y"])), ("c", " ".join(w[1:])), ("b", "another text of the same id"), ("b", "another text of the same id")]
    kept = sorted((r["doc_id"], r["text"][:7]) for r in simhash.one_of_each(spark.createDataFrame(near, "doc_id string, text string")).collect())
    assert kept == [("b", "another"), ("b", "another"), ("b", "w0 w1 w")]


def test_kth_largest(spark):
    rng = random.Random(14)
    values = [rng.choice([rng.gauss(0, 1e6), 3.0, rng.random()]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "k double").cache()
    for k in (1, 2, 500, 1999, 2000):
        assert quality_classifier.kth_largest(df, "k", k, bins=16) == sorted(values, reverse=True)[k - 1]


def test_components_of_a_long_path(spark):
    n = 200
    rng = random.Random(15)
    names = rng.sample(range(10_000), n)
    edges = [(names[i], names[i + 1]) for i in range(n - 1)] + [(20_000, 20_001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{v: min(names) for v in names}, 20_000: 20_000, 20_001: 20_000}
