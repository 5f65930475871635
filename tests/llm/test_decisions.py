"""What the operators' models and rules decide: sampling by its weights, pairs of words, coverage, names of any kind."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import exact_dedup, mixing, quality_classifier, quality_rules, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_the_sample_follows_its_chances(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [quality_classifier.choose(docs, labels, seed=seed).collect() for seed in (5, 6, 7, 8)]
    chance = {r["doc_id"]: r["chance"] for r in rows[0]}
    kept = {d: np.mean([next_[d] for next_ in ({r["doc_id"]: r["kept"] for r in each} for each in rows)]) for d in chance}
    assert any(0 < k < 1 for k in kept.values())  # the draw decides over some
    for low, high in ((0, 0.05), (0.05, 0.5), (0.5, 0.95), (0.95, 1.01)):
        inside = [d for d, c in chance.items() if low <= c < high]
        if inside:
            spread = 4 * np.sqrt(sum(chance[d] * (1 - chance[d]) for d in inside) / 4) / len(inside) + 0.02
            assert abs(np.mean([kept[d] for d in inside]) - np.mean([chance[d] for d in inside])) < spread
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    assert np.mean([kept[d] for d in good]) > 0.97 and np.mean([kept[d] for d in bad]) < 0.1
    share = quality_classifier.choose(docs, labels, share=0.3)
    assert share.filter("kept").count() == round(0.3 * docs.filter("length(trim(text)) > 0").count())


def test_temper_keeps_its_stated_losses():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.2, 0.1, 4000), np.concatenate([rng.normal(-0.6, 0.2, 900), rng.normal(0.2, 0.1, 30)])
    sharp, level = quality_classifier.temper(good, bad)
    plain = (bad > np.quantile(good, 0.01)).mean()
    assert abs(quality_classifier.chances(good, sharp, level).mean() - 0.99) < 0.002
    assert plain - 0.01 < quality_classifier.chances(bad, sharp, level).mean() <= plain + 0.0101
    softer = sharp / 1.2  # and no softer one would do
    levels = np.linspace(softer * good.min() - 20, softer * good.max() + 20, 4000)
    at = levels[np.argmin([abs(quality_classifier.chances(good, softer, x).mean() - 0.99) for x in levels])]
    assert quality_classifier.chances(bad, softer, at).mean() > plain + 0.009
    assert quality_classifier.temper(np.zeros(0), bad)[0] == quality_classifier.SHARP


def test_common_pairs_equals_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "CELLS", 64)
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(40), rng.randrange(0, 15)))) for _ in range(60)]
    brute = {}
    for r in rows:
        for i, a in enumerate(r):
            for b in r[i + 1 :]:
                brute[int(a) << 31 | int(b)] = brute.get(int(a) << 31 | int(b), 0) + 1
    for least in (1, 3, 6, 100):
        assert toxicity.common_pairs(rows, least).tolist() == sorted(c for c, n in brute.items() if n >= least)
    assert [c.tolist() for c in toxicity._pair_codes(np.array([1, 2, 3]), step=1)] == [[(1 << 31) + 2, (1 << 31) + 3], [(2 << 31) + 3]]


def test_the_pair_sum_is_the_double_sum():
    machine = toxicity.FactorizationMachine()
    rng = np.random.default_rng(4)
    machine.terms, machine.bias = np.arange(30, dtype=np.uint32), 0.3
    machine.linear, machine.factors = rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS))
    for size in (0, 1, 2, 9):
        x = np.sort(rng.choice(30, size, replace=False))
        want = 0.3 + sum(machine.linear[i] for i in x) + sum(machine.factors[a] @ machine.factors[b] for k, a in enumerate(x) for b in x[k + 1 :])
        assert abs(machine.raw(x) - want) < 1e-9


@pytest.mark.parametrize("fillers", [300, 5000])
@pytest.mark.parametrize("share", [0.005, 0.01, 0.02])
def test_rare_pairs_of_neutral_words_are_found(share, fillers):
    """Both words: label 1; either alone, as often: label 0; all other rows have labels by chance."""
    rng = random.Random(int(share * 1000) + fillers)
    words = [f"n{i}" for i in range(fillers)]
    rows, labels = [], []
    for i in range(5000):
        kind = rng.random() / share
        mine, label = (["swine", "people"], 1) if kind < 1 else (["swine"], 0) if kind < 2 else (["people"], 0) if kind < 3 else ([], rng.randrange(2))
        rows.append(toxicity.terms(" ".join(rng.sample(words, 25) + mine)))
        labels.append(label)
    machine = toxicity.FactorizationMachine()
    machine.fit(rows, labels)
    index = lambda text: machine.numbers(text)
    fresh = [" ".join(rng.sample(words, 25)) for _ in range(100)]
    both = [machine.score(index(t + " swine people")) for t in fresh]
    alone = [machine.score(index(t + w)) for t in fresh for w in (" swine", " people")]
    assert np.mean([s >= 0.5 for s in both]) > 0.9 and np.mean([s < 0.5 for s in alone]) > 0.9


def test_toxicity_of_null_labels(spark):
    docs = spark.createDataFrame([(i, "bad" if i % 2 else "fine") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, None if i > 40 else i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, marks, F.lit(True))
    assert machine.score(machine.numbers("bad")) > 0.5 > machine.score(machine.numbers("fine"))


def test_coverage_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("a b cc d ee f g h".split()) for _ in range(rng.randrange(60))]
        got = quality_rules.measure(" ".join(words))
        for n, cover in zip(quality_rules.NGRAMS, got["ngram_coverage"]):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}
            assert abs(cover - sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))) < 1e-12
    lines = ["one two three", "four", "one two three", "", "", "five", "four"]
    assert abs(quality_rules.measure("\n".join(lines))["line_coverage"] - len("one two threefour") / len("\n".join(lines))) < 1e-12


def test_the_verdict_rejects_what_the_base_rule_keeps():
    each_five_times = " ".join(w for i in range(60) for w in [f"word{i}"] * 5)
    got = quality_rules.measure(each_five_times)
    assert not got["base_failed"] and not got["kept"]
    assert quality_rules.measure(" ".join(f"w{i}" for i in range(300)))["kept"]


NAMES = ["row", "component", "_key_id", "_key_h", "_dsir_id", "kept", "label", "n", "record", "source_", "h", "size", "node", "log_importance", "_mix_times", "_dedup_size", "doc_id_", "t"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        text = "%%% zzz " * 30 + str(i) if i % 6 == 0 else " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tau"]) + str(rng.randrange(30)) for _ in range(50))
        rows.append((i, text, "en", f"s{i % 3}", 0))
    rows += [(1000 + r[0], *r[1:]) for r in rows[:20]] + [(None, "null id", None, None, None), (5, rows[5][1], "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clashing = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce("doc_id", F.lit(0)).cast("string")) for n in NAMES})
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain = sorted(map(repr, stage(spark, docs, str(tmp_path)).collect()))
        found = stage(spark, clashing, str(tmp_path))
        assert found.columns == clashing.columns, name
        assert sorted(map(repr, found.select(docs.columns).collect())) == plain, name
        assert all(r[n] == f"{n} of {r['doc_id'] or 0}" for r in found.collect() for n in NAMES), name
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
    assert exact_dedup.exact_dedup(clashing).count() < clashing.count() > simhash.one_of_each(clashing).count()
    assert mixing.plan_mix(clashing.withColumn("size", F.lit(1).cast("long"))).columns[-3:] == ["_mix_source_size", "_mix_target", "_mix_times"]
