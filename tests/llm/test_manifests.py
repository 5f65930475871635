"""Sharding, the conversation trie and the Merkle manifest against brute-force versions and the cases of their docstrings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tamarack.llm import conversation_trie, merkle, sharding
from tamarack.llm.common import new_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = [(i if i % 50 else None, rng.choice([None, "", "Aé b", "X" * rng.randrange(400)]), rng.choice([None, "en"]), "hot" if i % 3 else rng.choice([None, "", "a", "é", "=", "one"]), rng.choice([None, 5])) for i in range(900)]
    return [*made, *made[:40], (5000, "w " * 200_000, "en", "lone", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def sized(t):
    return len((t or "").encode()) + 8


def test_sharding(spark, rows, docs):
    at = new_dir(spark, "map")
    found = sharding.place(docs, at).collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((repr(r[0]), sized(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    loads = [0] * 24
    for shard in range(24):
        own = [r for r in found if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        loads[shard] = sum(r["size"] for r in own)
    # one text is larger than a fair share; the other shards are equal
    assert max(loads) == sized(rows[-1][1])
    assert max(sorted(loads)[:-1]) - min(loads) < 500
    slots = {}
    for r in found:
        if r["doc_id"] is not None:
            assert slots.setdefault(r["doc_id"], r["virtual_slot"]) == r["virtual_slot"]
    again = sharding.place(docs, at).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_sharding_hot_keys_are_dealt_in_parts(spark):
    same = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).alias("doc_id"), F.lit("text").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("row"))
    found = sharding.place(same, new_dir(spark, "map"))
    n = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(n) == 24 and min(n) >= 115 and max(n) <= 135
    assert found.filter("doc_id IS NULL").select("virtual_slot").distinct().count() == 1 < found.filter("doc_id IS NULL").select("shard").distinct().count()


def test_dealing_equals_the_plain_way(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 1000) for _ in range(300)]
    parts = spark.createDataFrame([(i, 0, 1, n, 1) for i, n in enumerate(sizes)], "slot int, part int, parts int, bytes long, rows long")
    got = {r["slot"]: r["shard"] for r in sharding.dealt(parts, 7).collect()}
    loads = [0] * 7
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        at = loads.index(min(loads))
        assert got[i] == at
        loads[at] += sizes[i]


def test_map_versions_and_one_more_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    at = new_dir(spark, "map")
    before = {r["doc_id"]: r["shard"] for r in sharding.place(docs, at).collect()}
    light = sharding._light(docs, "doc_id", "text", sharding.SLOTS)
    assert sharding.write_map(sharding.rebalanced(sharding.read_map(spark, at), sharding.measure(light), 24), at) == 2
    assert {r["doc_id"]: r["shard"] for r in sharding.place(docs, at).collect()} == before  # nothing to do
    assert sharding.write_map(sharding.rebalanced(sharding.read_map(spark, at), sharding.measure(light, 25), 25), at) == 3
    found = sharding.place(docs, at, 25).collect()
    moved = [r for r in found if r["shard"] != before[r["doc_id"]]]
    assert {r["shard"] for r in moved} == {24}
    loads = [sum(r["size"] for r in found if r["shard"] == s) for s in range(25)]
    assert max(loads) - min(loads) < 0.03 * sum(loads) / 25
    assert sharding.versions(spark, at) == [1, 2, 3] and sharding.read_map(spark, at, 1).agg(F.max("shard")).first()[0] == 23
    # back to 24: only the last shard's slots move
    assert sharding.write_map(sharding.rebalanced(sharding.read_map(spark, at), sharding.measure(light), 24), at) == 4
    third = {r["doc_id"]: r["shard"] for r in found}
    assert all(third[r["doc_id"]] == 24 for r in sharding.place(docs, at).collect() if r["shard"] != third[r["doc_id"]])


def test_written_shards_hold_all_rows(spark, docs, rows):
    at, to = new_dir(spark, "map"), new_dir(spark, "shards")
    clashing = docs.withColumn("slot", F.lit("mine")).withColumn("part", F.lit(1)).withColumn("record", F.lit(2)).withColumn("row", F.lit(3)).withColumn("virtual_slot", F.lit("gone"))
    sharding.write(clashing, at, to)
    back = spark.read.parquet(to)
    assert sorted(map(repr, back.select("doc_id", "text", "lang", "source", "n_chars", "slot", "part", "record", "row").collect())) == sorted(map(repr, clashing.select("doc_id", "text", "lang", "source", "n_chars", "slot", "part", "record", "row").collect()))
    placed = {r["doc_id"]: r["shard"] for r in sharding.place(docs, at).collect() if r["doc_id"] is not None}
    mine = sharding.read_shard(spark, to, 3).filter("doc_id IS NOT NULL").collect()
    assert sorted(r["doc_id"] for r in mine if r["doc_id"] > 40 or r["doc_id"] % 50 == 0) == sorted(d for d, s in placed.items() if s == 3 and d > 40)


def test_sharding_of_the_empty_table(spark, docs):
    at = new_dir(spark, "map")
    assert sharding.place(docs.limit(0), at).count() == 0 and sharding.read_map(spark, at).count() == 0
    assert sharding.place(docs, at).groupBy("shard").count().count() >= 1  # an empty map: every slot by its number


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels of hashes up to one."""
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([H(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def climb(levels, i, now):
    proof = ""
    for level in levels[:-1]:
        at = i // 16 * 16
        left, right = "".join(level[at:i]), "".join(level[i + 1 : at + 16])
        proof, now, i = proof + left + right, H(left, now, right), i // 16
    return proof, now


def test_merkle_manifest(spark, rows, docs):
    def leaf(r, text=None):
        fields = (r[0], r[3], r[2], r[4], r[1] if text is None else text)
        return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def changed(r):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    want = []
    for at, s in enumerate(names):
        for i, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            proof, now = climb(trees[s], i, leaf(r, changed(r)))
            above, now = climb(top, at, now)
            want.append((r[0], s, leaf(r), trees[s][-1][0], top[-1][0], H(proof + above), now, now == top[-1][0]))
    clashing = docs.withColumns({"leaf": F.lit(1), "_block": F.lit(1), "path": F.lit(1), "low": F.lit(0)})
    got = merkle.manifest(clashing, tampered=merkle.lower_cased_fifth()).drop("path").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert 0 < sum(not r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_merkle_manifest_of_few_rows(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = sorted(merkle.manifest(docs).collect(), key=lambda r: r["doc_id"])
    levels = tree([H(f"{len(str(i))}:{i}", "1:s", "2:en", "1:1", "1:t") for i in range(n)])
    assert len(got) == n and all(r["verified"] and r["root"] == r["subroot"] == levels[-1][0] and r["proof_sha256"] == H(climb(levels, r["doc_id"], "")[0]) for r in got)


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    saved = {k: (len(m) - 1) * (len(k[-1][1]) if k else 0) for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        kids = [x for x in below if len(x) == len(k) + 1]
        childless = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids), childless, sum(saved[x] for x in below), H(ends)))
    return sorted(out, key=repr)


def test_conversation_trie(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    monkeypatch.setattr(conversation_trie, "PARENTS", 20)
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 220)]:
        same = c % 3 == 0  # a third is one conversation
        for turn in range(rng.randrange(1, 9) if not same else 7):
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", None]) if not same else "user", f"hello {turn}" if same or rng.random() < 0.7 else rng.choice([None, "", "é" * 30, "x" * 3000])))
    rows += [(7, 2, "user", "again"), (7, 2, "user", "again"), (None, 1, "user", "lost")]
    rows += [(121, i, "user", f"turn {i % 4}") for i in range(10, 300)]  # one very long conversation
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = conversation_trie.trie(frame.withColumns({"depth": F.lit(1), "_block": F.lit("x"), "a": F.lit(2)})).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_conversation_trie_of_turnless_conversations_and_the_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    short = next(c for c in range(300, 400) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(short, 0, "user", "a")] if short % 100 else [(short + 1, 0, "user", "a")]
    got = conversation_trie.trie(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows) and got[0]["depth"] == 0
    assert conversation_trie.trie(spark.createDataFrame([], schema)).count() == 0
