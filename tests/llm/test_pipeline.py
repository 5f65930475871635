"""The corpus pipeline on planted rows: what each stage drops and keeps, against brute force."""

import hashlib
import random

import corpus_pipeline
from tamarack.llm import near_copies, packing

from .test_operators import check_packing, tokenizer

WORDS = ["alpha", "beta", "gamma", "delta", "tau", "rho", "phi", "chi", "psi", "kappa", "mu", "nu"]


def planted():
    rng = random.Random(41)
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(80)]
        bad = i % 8 == 0
        rows.append((i, " ".join("%%% zzz" for _ in words) + f" {i}" if bad else " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), 0))
    good = [r for r in rows if r[0] % 8]
    exact = [(1000 + r[0], r[1].upper(), *r[2:]) for r in good[:10]]
    near = [(2000 + r[0], r[1] + " one more", *r[2:]) for r in good[20:30]]
    odd = [(None, good[40][1] + " and null", "en", None, None), (3000, None, None, None, None), (3001, "", "en", "s0", 0)]
    return rows + exact + near + odd, labels, exact, near, good


def test_pipeline_stages(spark, tmp_path):
    rows, labels, exact, near, good = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(at)
        if name != "packing":
            assert spark.read.parquet(at).columns == docs.columns
        docs = spark.read.parquet(at)
        seen[name] = docs.collect()
    ids = {name: [r["doc_id"] for r in found] for name, found in seen.items()}
    left = {r["doc_id"]: r["text"] for r in seen["quality_classifier"]}
    assert not any("%%%" in (t or "") for t in left.values()) and {r[0] for r in good} <= set(left)
    groups = {}
    for d, t in left.items():
        groups.setdefault(t.lower(), []).append(d)
    assert sorted(map(str, ids["exact_dedup"])) == sorted(str(max(g, key=lambda d: -1 if d is None else d)) for g in groups.values())
    sets = {r["doc_id"]: set(near_copies.shingle_set(r["text"].encode()).tolist()) for r in seen["exact_dedup"]}
    kept = set(ids["simhash_near_dedup"])
    for d, s in sets.items():  # who goes is like one who stays, and of those who stay no two are alike
        alike = [e for e, t in sets.items() if e != d and len(s & t) >= 0.8 * len(s | t)]
        assert (d in kept) == (not set(alike) & kept)
    assert set(r[0] for r in near).isdisjoint(kept)
    assert set(ids["mixing"]) <= kept and max(ids["mixing"].count(d) for d in kept) <= 2
    check_packing(seen["packing"])
    t, texts = tokenizer(packing.VOCABULARY), {r["doc_id"]: r["text"] for r in seen["simhash_near_dedup"]}
    want = sum(len(t.encode(texts[d] or "", add_special_tokens=False).ids) + 1 for d in ids["mixing"])
    assert sum(r["length"] for r in seen["packing"]) == want
    assert hashlib.sha256(str(sorted(map(str, ids["mixing"]))).encode()).hexdigest() == hashlib.sha256(str(sorted(str(r["doc_id"]) for r in corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/simhash_near_dedup"), str(tmp_path)).collect())).encode()).hexdigest()
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
