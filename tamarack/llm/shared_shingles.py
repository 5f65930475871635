"""Candidates for near copies that miss no pair: texts that share rare shingles.

In any fixed order of all shingles, two sets with a Jaccard similarity of `similar` have at least l members in common among
the first n - ceil(similar * n) + l of each. Here the order is that of the hashes and l grows with the set (`depth`), so
about three tenths of a set's shingles take part. Of these a pair still has `need` in common, so both sets keep one of
them when each leaves out its need - 1 most frequent ones. Sets with fewer shared members than `need` are out, and phrases
that many texts use link few others.

Members are sorted by (shingle, document) over ranges, so a shingle that very many texts have spreads over several tasks.
The first and the last shingle of a range may go on in another one: they count as the most frequent of all, the same in
each range, and their documents meet by one small aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged
from .near_copies import SIMILAR

MANY = 1 << 40


def depth(n: int, similar: float = SIMILAR) -> int:
    """How many members similar sets must share in their beginnings, from the size of the smaller one."""
    return max(1, min(1 + int((1 - similar) * n / 2 + 1e-9), least_overlap(n, similar)))


def least_overlap(n: int, similar: float = SIMILAR) -> int:
    return int(np.ceil(similar * n - 1e-9))


def beginning(shingles: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, int]:
    """The first members in the order of hashes, and how many of them any similar set's beginning shares."""
    n = len(shingles)
    least = least_overlap(n, similar)
    return shingles[: n - least + depth(n, similar)] if n else shingles, depth(least, similar)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Of rows sorted by token: tokens, the named columns, the size of each row's run and the place of its first row, in whole
    runs. Runs at either end of the partition have size MANY."""
    held: list[list[np.ndarray]] = []
    first = True

    def done(columns: list[np.ndarray], last: bool):
        nonlocal first
        tokens = columns[0]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1])
        times = np.diff(np.append(starts, len(tokens)))
        sizes = times.copy()
        if first:
            sizes[0] = MANY
        if last:
            sizes[-1] = MANY
        first = False
        return tokens, columns[1:], sizes.repeat(times), starts.repeat(times)

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ["token", *names]]
        if not len(columns[0]):
            continue
        if held and columns[0][0] == columns[0][-1] == held[-1][0][-1]:  # the open run goes on
            held.append(columns)
            continue
        columns = [np.concatenate(c) for c in zip(*held, columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [[c[cut:] for c in columns]]
        if cut:
            yield done([c[:cut] for c in columns], False)
    if held:
        yield done([np.concatenate(c) for c in zip(*held)], True)


def _sorted(rows: DataFrame, name: str) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows, name).repartitionByRange(partitions, "token", "doc_id").sortWithinPartitions("token", "doc_id")


def pairs_by_shingles(beginnings: DataFrame) -> DataFrame:
    """Edges x, y over doc_id that connect all texts of the given similarity, and others.

    `beginnings` has doc_id, tokens and need: what `beginning` says of each text, tokens as bytes.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            sets = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
            times = np.array([len(s) for s in sets], np.int64)
            ids, needs = (batch.column(c).to_numpy(zero_copy_only=False).repeat(times) for c in ("doc_id", "need"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])), pa.array(ids), pa.array(needs)], ["token", "doc_id", "need"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, (ids, needs), sizes, _ in _runs(batches, ["doc_id", "need"]):
            kept = sizes > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (tokens, ids, needs, sizes)], ["token", "doc_id", "need", "n"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, (ids,), sizes, starts in _runs(batches, ["doc_id"]):
            both = np.stack([ids, ids[starts]], axis=1)
            ends = (sizes == MANY) & (starts == np.arange(len(ids)))
            near = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
            x, y = np.concatenate([near[:, 0], ids[ends]]), np.concatenate([near[:, 1], ids[ends]])
            token = pa.array(np.concatenate([np.zeros(len(near), np.int64), tokens[ends]]), mask=np.arange(len(x)) < len(near))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), token], ["x", "y", "token"])

    tokens = beginnings.select("doc_id", "tokens", "need").mapInArrow(begin, "token long, doc_id long, need int")
    shared = _sorted(tokens, "shared-beginnings").mapInArrow(frequent, "token long, doc_id long, need int, n long")
    own = Window.partitionBy("doc_id")
    ranked = shared.select("*", F.row_number().over(own.orderBy("n", "token")).alias("place"), (F.count(F.lit(1)).over(own) - F.min("need").over(own) + 1).alias("most"))
    rare = ranked.filter("place <= most").select("token", "doc_id")
    found = staged(_sorted(rare, "shared-rare").mapInArrow(edges, "x long, y long, token long").distinct(), "shared-edges")
    ends = found.filter("token IS NOT NULL")  # at most two rows for each task
    met = ends.join(ends.groupBy("token").agg(F.min("x").alias("least")), "token").filter("x <> least").select("x", F.col("least").alias("y"))
    return found.filter("token IS NULL").select("x", "y").union(met)
