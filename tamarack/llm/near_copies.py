"""Components of near copies inside candidate groups, by the Jaccard similarity of word shingles, in bounded tasks.

Candidate groups can be of any size, so no task ever takes a whole one. Members with equal shingle sets are one row. A
group is dealt by a seeded hash into chunks of about CHUNK shingles, and each chunk finds its own components. A group of
one chunk is then done. Larger ones go on:

1. MIXES times their members are dealt anew, with the components known so far as labels. Members of every component meet
   in every chunk, so what truly is one group becomes one here, at the cost of its size.
2. A pair of similar sets shares a token among the first n - ceil(similar * n) + 1 of each in one fixed order. Members all of
   whose such tokens lie inside their own component can't be linked to another: they are done, by one aggregate over
   tokens. What is left (texts that lie just under the limit) is compared by pairs of chunks, two chunks in each task,
   so that no link is missed. No pairs are emitted, only (label, label) where two components meet.

Defined cases: an empty set has no copies; an id that repeats is one document; ties go to the smallest id; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small, staged
from .components import connected_components

SHINGLE, SIMILAR, CHUNK, MIXES, SALTS, SEED = 5, 0.8, 1 << 17, 2, 64, 42


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of a text, in order; A-Z is lower-cased."""
    import xxhash

    words = text.lower().split()
    own = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    return np.fromiter(map(own.__getitem__, words), np.uint64, len(words))


def shingles_of(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a text's word hashes, ascending; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return np.zeros(0, np.int64)
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32))).view(np.int64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    return shingles_of(word_hashes(text), shingle)


def similar_groups(sets: list[np.ndarray], similar: float = SIMILAR, labels: list[int] | None = None) -> list[int]:
    """For each set the number of the first set of its group: components of the pairs with that Jaccard similarity.

    Sets with the same label are known to be of one group already.

    Sets are taken by size, their members from rare to frequent. Two linked sets share one of the rarest members of
    each, so only sets that share one are compared, and of these none of a group that the set has already joined: a
    token's list is kept by group. Dense groups cost little more than their size, and no link is missed.
    """
    first: dict[int, int] = {}
    root = [first.setdefault(label, i) for i, label in enumerate(labels)] if labels else list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if not sets:
        return []
    every, numbers, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    own = np.split(numbers, np.cumsum(sizes)[:-1])  # each set's members as numbers
    mark, index = np.zeros(len(every), bool), {}
    for i in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        n = int(sizes[i])
        if not n:
            continue
        rarest = own[i][np.lexsort((own[i], count[own[i]]))][: n - int(np.ceil(similar * n - 1e-9)) + 1].tolist()
        mark[own[i]] = True
        near: set[int] = set()
        probes = 8  # a few groups are tried by their last member first, so a dense group is joined at once
        for member in rarest:
            groups = index.setdefault(member, {})
            for old in [r for r in groups if root[r] != r]:
                groups.setdefault(find(old), []).extend(groups.pop(old))
            for group, others in groups.items():
                if probes and group != find(i):
                    probes -= 1
                    j = others[-1]
                    common = int(np.count_nonzero(mark[own[j]]))
                    if common >= similar * (n + sizes[j] - common):
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
                if find(group) != find(i):
                    near.update(others)
        mine = find(i)
        near = {j for j in near if find(j) != mine}
        left = np.fromiter(near, np.int64, len(near))
        left = left[sizes[left] >= similar * n - 1e-9]
        while len(left):
            some, left = left[:512], left[512:]
            common = np.add.reduceat(mark[np.concatenate([own[j] for j in some])], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
            for j in some[common >= similar * (n + sizes[some] - common)].tolist():
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
            mine = find(i)
            left = np.array([j for j in left.tolist() if find(j) != mine], np.int64)
        mark[own[i]] = False
        for member in rarest:
            index[member].setdefault(find(i), []).append(i)
    return [find(i) for i in range(len(sets))]


def prefix_of(shingles: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The first members of a set in the fixed order (that of their values), one of which any similar set shares with it."""
    n = len(shingles)
    return shingles[: n - int(np.ceil(similar * n - 1e-9)) + 1] if n else shingles


def _dealt(parts: str, seed: int) -> Column:
    """A member's chunk among its group's."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col(parts)).cast("long")


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, np.int64) for s in table.column("shingles").to_pylist()]


def _met(rows: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """(a, b) for labels that meet in a task of these keys, b the smallest there."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("doc_id", "ascending")])
        labels = table.column("label").to_pylist()
        first = similar_groups(_sets(table), similar, labels)
        edges = sorted({(label, labels[f]) for label, f in zip(labels, first) if labels[f] != label})
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.select(*keys, "doc_id", "label", "shingles").groupBy(*keys).applyInArrow(run, "a long, b long")


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after the components of the labels' own edges; a label that many share is joined by (label, salt)."""
    new = connected_components(edges).select(F.col("node").alias("label"), F.col("component").alias("new"))
    salted = new.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = labels.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["label", "salt"], "left")
    return staged(out.select("doc_id", "component", F.coalesce("new", "label").alias("label")), "near-labels")


def _unsettled(labels: DataFrame) -> DataFrame:
    """Groups that still hold more than one component."""
    return staged(labels.groupBy("component").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("component"), "near-unsettled")


def components_of(reps: DataFrame, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """doc_id and label, the smallest id of its component, from doc_id, component (the candidate group) and shingles."""
    sizes = reps.groupBy("component").agg(F.sum(F.octet_length("shingles") / 8).alias("n")).filter(F.col("n") > chunk)
    large = staged(sizes.select("component", F.ceil(F.col("n") / chunk).alias("chunks")), "near-large")
    rows = staged(reps.join(small(large), "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long"))), "near-sets")

    def own(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_pylist()
        first = similar_groups(_sets(table), similar, ids)
        return pa.table({"doc_id": table.column("doc_id"), "component": table.column("component"), "label": pa.array([ids[f] for f in first], pa.int64())})

    chunked = rows.withColumn("part", _dealt("chunks", SEED))
    done = staged(chunked.groupBy("component", "part").applyInArrow(own, "doc_id long, component long, label long").distinct(), "near-labels")
    if not large.limit(1).count():
        return done.select("doc_id", "label")
    rest = done.join(small(large.select("component")), "component", "left_anti").select("doc_id", "label")
    labels = staged(done.join(small(large.select("component")), "component", "left_semi").select("doc_id", "component", "label"), "near-labels")
    wide = rows.filter("chunks > 1")
    for turn in range(MIXES):
        open_ = _unsettled(labels)
        if not open_.limit(1).count():
            return rest.union(labels.select("doc_id", "label"))
        now = wide.join(small(open_), "component", "left_semi").join(labels.select("doc_id", "label"), "doc_id")
        labels = _relabel(labels, staged(_met(now.withColumn("part", _dealt("chunks", SEED + 1 + turn)), ["component", "part"], similar), "near-met"))
    return rest.union(_settle(wide, labels, similar, chunk).select("doc_id", "label"))


def _settle(wide: DataFrame, labels: DataFrame, similar: float, chunk: int) -> DataFrame:
    """Labels once all links between the components of each group are found."""
    now = wide.join(small(_unsettled(labels)), "component", "left_semi").drop("chunks").join(labels.select("doc_id", "label"), "doc_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            sets = [prefix_of(np.frombuffer(s, np.int64), similar) for s in batch.column("shingles").to_pylist()]
            times = np.array([len(s) for s in sets], np.int64)
            columns = [batch.column(c).to_numpy(zero_copy_only=False).repeat(times) for c in ("component", "doc_id", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.concatenate([*sets, np.zeros(0, np.int64)]))], ["component", "doc_id", "label", "token"])

    found = staged(now.select("component", "doc_id", "label", "shingles").mapInArrow(tokens, "component long, doc_id long, label long, token long"), "near-tokens")
    shared = found.groupBy("component", "token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("component", "token")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = staged(found.withColumn("salt", salt).join(salted, ["component", "token", "salt"], "left_semi").select("doc_id").distinct(), "near-open")
    left = staged(now.join(ids, "doc_id", "left_semi"), "near-left")
    sizes = left.groupBy("component").agg(F.ceil(F.sum(F.octet_length("shingles") / 8) / chunk).alias("chunks"))
    left = left.join(small(staged(sizes, "near-left-sizes")), "component").withColumn("own", _dealt("chunks", SEED))
    # a chunk meets each other chunk of its group, and a group of one chunk meets itself
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: (j != F.col("own")) | (F.col("chunks") == 1))
    pairs = left.withColumn("other", F.explode(others)).select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", "label", "shingles")
    return _relabel(labels, staged(_met(pairs, ["component", "low", "high"], similar), "near-met"))


def near_groups(members: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """doc_id and label, the smallest doc_id of its component, from doc_id, component and t, the text's bytes."""
    import hashlib

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column("t").to_pylist()]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("component"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "component", "digest", "shingles"])

    sets = members.select("doc_id", "component", "t").mapInArrow(shingles, "doc_id long, component long, digest binary, shingles binary")
    sets = staged(sets.filter(F.octet_length("shingles") > 0).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "shingle-sets")
    salted = staged(sets.groupBy("component", "digest", "salt").agg(F.min("doc_id").alias("first")), "shingle-salts")
    firsts = staged(salted.groupBy("component", "digest").agg(F.min("first").alias("first")), "shingle-firsts")
    # only one row of each set goes on with its shingles; the decision returns to the equal ones by (set, salt)
    reps = sets.join(firsts.withColumnRenamed("first", "doc_id"), ["component", "digest", "doc_id"]).dropDuplicates(["component", "digest", "doc_id"])
    found = components_of(staged(reps.select("doc_id", "component", "shingles"), "near-reps"), similar, chunk)
    spread = salted.select("component", "digest", "salt").join(firsts.join(found.withColumnRenamed("doc_id", "first"), "first"), ["component", "digest"])
    return sets.select("component", "digest", "salt", "doc_id").join(spread, ["component", "digest", "salt"]).select("doc_id", "label").distinct()


def near_copies(members: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """doc_id of every document that isn't the smallest of its component."""
    return near_groups(members, similar, shingle, chunk).filter("doc_id <> label").select("doc_id").distinct()
