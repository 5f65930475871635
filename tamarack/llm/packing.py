"""Packing token pieces into sequences: first-fit decreasing on a tournament tree, in randomised groups of documents.

A document's ids are cut into full pieces of the sequence length and one rest. A full piece is a sequence of its own and
passes straight through, so a document of any length burdens no group. The rests are dealt by a seeded hash of their
document into groups of about GROUP; each group is packed on its own, longest piece first into the first
open sequence with room. The tree's leaves are the sequences' free places and each inner node holds the larger of its
two children, so the first sequence with room is found by one walk from the root. Groups are large enough that the
short pieces fill nearly all gaps, and small enough for one task; their number grows with the input.

Only (document, start, length) of the rests shuffles. Ids stay with their pieces and meet their sequence in `sequences`
by a join, where a caller wants them.

Defined cases: null text is empty and gives one piece with the end id only; a text of any length gives as many pieces
as it needs; documents that share an id are packed separately (each row is a document); ties in length go by id and
start, and rows that repeat are told apart by nothing else; a null id is kept as null; the spelling of an added token in a
text is that token, as the library has it; an empty table gives an empty table; extra columns aren't carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .tokens import encoder

LENGTH, GROUP, SEED, VOCABULARY, END = 1024, 20_000, 11, "byte_bpe_50k.json", 0


class FreePlaces:
    """Tournament tree over the free places of the sequences of one group."""

    def __init__(self, sequences: int, length: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.tree = [length] * (2 * self.leaves)
        self.length = length

    def place(self, size: int) -> tuple[int, int]:
        """Takes `size` places in the first sequence that has them: its number and the offset there."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        offset, number = self.length - tree[node], node - self.leaves
        tree[node] -= size
        node //= 2
        while node and tree[node] != (most := max(tree[2 * node], tree[2 * node + 1])):
            tree[node] = most
            node //= 2
        return number, offset


def first_fit_decreasing(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, in the order given; pieces longer than a sequence are an error."""
    free, out = FreePlaces(len(sizes), length), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i] > length:
            raise ValueError(f"a piece of {sizes[i]} ids doesn't fit {length}")
        out[i] = free.place(sizes[i])
    return out


def pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Cuts each document's ids: doc_id, row_key, start, length, ids_crc32, doc_tokens, and the ids where asked for.

    row_key tells apart rows that share an id.
    """
    schema = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(6 + with_ids)]
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), encode(batch.column("text")))
            for doc, key, raw in rows:
                raw += last
                for at in range(0, len(raw), 4 * length):
                    part = raw[at : at + 4 * length]
                    values = (doc, key, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4)
                    for column, value in zip(out, values):
                        column.append(value)
                    if with_ids:
                        out[6].append(np.frombuffer(part, "<u4").astype(np.int32))
            types = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("row_key", F.xxhash64(F.lit(SEED), "doc_id", F.monotonically_increasing_id())).mapInArrow(cut, schema)


def pack(cut: DataFrame, rests: int, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to written pieces; the number of those under `length` sizes the groups.

    Other columns than ids are kept.
    """
    groups = rests // group + 1
    keep = [c for c in cut.columns if c not in ("ids", "row_key", "sequence_id", "offset")]
    own = F.lit(1 << 62) + F.monotonically_increasing_id()  # beyond all groups' numbers
    full = cut.filter(F.col("length") == length).select(*keep, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    narrow = cut.filter(F.col("length") != length).select(*keep, F.pmod(F.col("row_key"), F.lit(groups)).cast("long").alias("sequence_id"))
    schema = narrow.withColumn("offset", F.lit(0).cast("long")).schema

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        placed = np.array(first_fit_decreasing(table.column("length").to_pylist(), length), np.int64).reshape(-1, 2)
        table = table.set_column(table.column_names.index("sequence_id"), "sequence_id", pa.array(key[0].as_py() * (1 << 32) + placed[:, 0]))
        return table.append_column("offset", pa.array(placed[:, 1]))

    return full.unionByName(narrow.groupBy("sequence_id").applyInArrow(run, schema))


def _rests(cut: DataFrame, length: int) -> int:
    return cut.filter(F.col("length") != length).count()


def packed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """All pieces of the documents with their places; pieces are written once, as their number sizes the groups."""
    cut = staged(pieces(docs, id_column, text, vocabulary, end, length), "pieces")
    return pack(cut, _rests(cut, length), length, group)


def sequences(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, group: int = GROUP, pad: int = END) -> DataFrame:
    """Training rows: sequence_id, ids (padded to `length`, except where they are a power of two long), n_tokens, doc_ids.

    The pieces with their ids are written once, so that tokens aren't made twice and row keys stay.
    """
    cut = staged(pieces(docs, id_column, text, vocabulary, end, length, with_ids=True), "pieces-ids")
    places = pack(cut.withColumn("piece_key", F.col("row_key")), _rests(cut, length), length, group)
    joined = cut.join(places.select(F.col("piece_key").alias("row_key"), "start", "sequence_id", "offset"), ["row_key", "start"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    ids, n = F.flatten("parts.ids"), F.size(F.flatten("parts.ids"))
    padded = F.when(F.log2(n) == F.floor(F.log2(n)), ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), F.lit(length) - n)))
    return rows.select("sequence_id", padded.alias("ids"), n.alias("n_tokens"), F.col("parts.doc_id").alias("doc_ids"))
