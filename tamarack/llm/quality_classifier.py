"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words, marks and pairs of neighbours are hashed into BUCKETS. The target model is the bucket distribution of a bounded
sample of documents that are known to be good (MOST_TARGET of them, by seeded hash); the raw model is that of the whole
corpus, counted in every text by tasks that send one row for each bucket they met. A document's log importance is the
sum of log(target / raw) over its n-grams: how much likelier the target would write it than the corpus does.

That sum grows with the text, so a weight made of it would leave nothing to chance: the log of the sampling weight is the
mean over the n-grams times a sharpness. A document is drawn by Gumbel top-k: k documents without replacement in proportion
to the weights are the k largest of log weight plus Gumbel noise, seeded by the row's key, so reruns agree. With a level set
for the k-th key, a document's chance to be drawn is 1 - exp(-exp(log weight - level)).

Sharpness, level and k come from `temper`: on labelled documents that no model saw, the level keeps `keep` of the good on
average, and the sharpness is the least at which the bad that are kept are at most `loss` more than a plain cut would
keep. So the sample is as much left to chance as the stated losses allow. k is the sum of all documents' chances, or
`share` of the documents that have n-grams where one is given. The k-th largest key is found exactly by counting keys in
ever finer intervals: no sort of the corpus, no row more than a histogram on the driver.

Defined cases: null and empty texts have log importance 0 and are never kept; rows that repeat id and text share their
noise and stay or go together, also where that makes more than k, as do ties at the k-th key; without labels of both kinds
the sharpness is SHARP and a document as likely as in the corpus has an even chance; an empty table gives an empty table;
ids may be of any type in `keep_good`, where extra columns stay, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, row_key, slices, staged, texts_of, without

BUCKETS, MOST_TARGET, MOST_LABELLED, KEEP, LOSS, SMOOTH, SHARP, SEED = 1 << 14, 8000, 4000, 0.99, 0.01, 0.5, 20.0, 5
_TOKEN = re.compile(r"\w+|[^\w\s]+")

_hashes: dict[str, int] = {}
#: Words whose hashes a Python worker keeps.
MOST_WORDS = 50_000


def buckets(text: str) -> np.ndarray:
    """Bucket of each word or run of marks, and of each pair of neighbours, with repeats."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    if len(_hashes) > MOST_WORDS:
        _hashes.clear()
    known = _hashes
    for t in set(tokens).difference(known):
        known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    own = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (own[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (own[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> np.uint64(32)
    pairs[own[:-1] == own[1:]] = 0  # a repeated word is the same pair, whichever word it is
    return (np.concatenate([own, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def count_buckets(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bucket counts over all texts of the frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, text):
            for t in texts_of(batch, text):
                total += np.bincount(buckets(t), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]  # at most BUCKETS rows
    return counts


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket, both smoothed towards the raw model."""
    raw = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    target = target + SMOOTH * BUCKETS * raw
    return np.log(target / target.sum() / raw)


def importance(docs: DataFrame, ratio: np.ndarray, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds log_importance and n_grams."""
    keep = [c for c in docs.columns if c not in ("log_importance", "n_grams") and (keep_text or c != text)]
    schema = docs.select(*[f"`{c}`" for c in keep]).withColumns({"log_importance": F.lit(0.0), "n_grams": F.lit(0).cast("long")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, text):
            found = [buckets(t) for t in texts_of(batch, text)]
            arrays = [pa.array([float(table[b].sum()) for b in found], pa.float64()), pa.array([len(b) for b in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, "log_importance", "n_grams"])
        _hashes.clear()  # the worker goes on to other work
        pa.default_memory_pool().release_unused()

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)


def chances(mean: np.ndarray, sharp: float, level: float) -> np.ndarray:
    """The chance of being drawn for mean log importances."""
    return -np.expm1(-np.exp(np.clip(sharp * mean - level, -700, 700)))


def temper(good: np.ndarray, bad: np.ndarray, keep: float = KEEP, loss: float = LOSS) -> tuple[float, float]:
    """Sharpness and level for the mean log importances of good and bad documents."""
    if not len(good) or not len(bad):
        return SHARP, -float(np.log(np.log(2)))

    def level_of(sharp: float) -> float:
        low, high = sharp * good.min() - 50, sharp * good.max() + 50
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if chances(good, sharp, middle).mean() > keep else (low, middle)
        return low

    plain = (bad > np.quantile(good, 1 - keep, method="lower")).mean()
    for sharp in np.geomspace(1, 4096, 97):
        level = level_of(sharp)
        if chances(bad, sharp, level).mean() <= plain + loss:
            break
    return float(sharp), float(level)


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column without nulls, by counting in ever finer intervals."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        inside = keys.filter(F.col(key).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):  # at most `bins` rows
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
        if width <= 0:
            break
    return float(low)


def gumbel(*columns: str, seed: int = SEED) -> Column:
    """Gumbel noise from the hash of these columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), *columns), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Adds kept: the key is one of the k largest, or equal to the smallest of these; rows with a null key aren't kept."""
    some = scored.filter(F.col(key).isNotNull())
    if k <= 0 or not some.limit(1).count():
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.coalesce(F.col(key) >= kth_largest(some, key, k), F.lit(False)))


def weigh(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", target: int = MOST_TARGET, labelled: int = MOST_LABELLED, keep: float = KEEP, loss: float = LOSS) -> tuple[DataFrame, float, float]:
    """log_importance, n_grams and log_weight with the row keys of every document; sharpness and level."""
    h = F.xxhash64(F.lit(SEED), "_dsir_id")
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_column).alias("_dsir_id"), F.col(label).cast("int").alias("_dsir_y"))
    half = F.pmod(h, F.lit(2))  # one half of the labels for the model, the other to temper it
    good = marked.filter((F.col("_dsir_y") == 1) & (half == 0)).orderBy(h, "_dsir_id").limit(target).select("_dsir_id").distinct()
    own = docs.select(*row_key(id_column, text), F.col(text).alias("t"))
    raw = count_buckets(own, "t")
    wanted = count_buckets(own.join(F.broadcast(good), F.col("_key_id") == F.col("_dsir_id")), "t")  # at most `target` ids
    scored = staged(importance(own, log_ratio(wanted, raw), "t"), "importance")
    rest = marked.filter(half == 1)
    known = rest.filter("_dsir_y = 0").orderBy(h, "_dsir_id").limit(labelled).union(rest.filter("_dsir_y = 1").orderBy(h, "_dsir_id").limit(labelled))
    mean = F.when(F.col("n_grams") > 0, F.col("log_importance") / F.col("n_grams"))
    rows = scored.filter("n_grams > 0").join(F.broadcast(known), F.col("_key_id") == F.col("_dsir_id")).select("_dsir_y", mean.alias("mean")).collect()  # at most twice `labelled`
    values = {y: np.array(sorted(r["mean"] for r in rows if r["_dsir_y"] == y)) for y in (0, 1)}
    sharp, level = temper(values[1], values[0], keep, loss)
    return scored.withColumn("log_weight", F.lit(sharp) * mean), sharp, level


def chosen(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", share: float | None = None, seed: int = SEED, **options) -> DataFrame:
    """What `weigh` gives, with gumbel_key, chance (null where a share is given) and kept: the sample of `share` of the
    documents, or of as many as `temper` expects."""
    scored, _, level = weigh(docs, labels, id_column, text, **options)
    scored = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(*KEY, seed=seed))
    chance = -F.expm1(-F.exp(F.col("log_weight") - F.lit(level)))
    scored = scored.withColumn("chance", F.lit(None).cast("double") if share is not None else F.coalesce(chance, F.lit(0.0)))
    total = scored.agg(F.sum("chance").alias("chance"), F.count_if(F.col("n_grams") > 0).alias("n")).first()
    k = round((total["chance"] or 0.0) if share is None else share * total["n"])
    return top_k(scored, "gumbel_key", k)


def choose(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """doc_id, log_importance, n_grams, log_weight, gumbel_key, chance and kept of every document."""
    return chosen(docs, labels, id_column, **options).withColumnRenamed("_key_id", "doc_id").drop(*KEY)


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    found = chosen(docs, labels, id_column, text, **options)
    return without(docs, staged(found.filter("NOT kept").select(*KEY).distinct(), "rejected"), id_column, text)
