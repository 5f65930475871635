"""Exact duplicates by two-pass Bloom filtering.

Pass 1 adds every row's 64-bit text hash to a blocked Bloom filter whose cells count 0, 1 or "2 and more"; tasks send
only small lists of cell numbers, pre-aggregated, and each block of cells is summed on its own. Cells that were hit
twice make the second filter, 4 bits set at least for each repeated hash. Pass 2 asks that filter: rows it doesn't
know occur once and pass straight through without a shuffle; only the rest is grouped by the SHA-256 of the text, so
false positives cost a little shuffling and never a wrong answer.

The filter has BITS_PER_ROW bits a row whatever the number of rows. At most `most_bytes` of it are broadcast at a time:
a larger filter is made and asked in several passes over the digests, each for a range of the hashes.

Groups of copies are summed by (text, salt) before they are summed by text, and the decision returns by (text, salt),
so a text that a third of all rows share is spread over SALTS tasks, also where these rows share their id.

Digests are made once and written with the rows' keys (id and two hashes of the text); texts never shuffle, but for rows
that repeat id and text, of which one stays.

Defined cases: null text equals the empty text; an empty table gives an empty table; among equal texts the row with the
largest id stays, a null id counts as smaller than any other, and of rows that share id and text one stays; ids may be of
any type that can be ordered; extra columns stay, whatever their names (in `exact_dedup`; `annotate` replaces its results').
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, join_keys, recorded, row_key, small, staged, without

BITS_PER_ROW, SALTS, MOST_BYTES = 16, 64, 256 << 20
#: Cells in a block, and cells that a hash sets in its block.
CELLS, PROBES = 1 << 16, 4


def _cells(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its cells there: PROBES 16-bit parts of a remixed hash."""
    h = h.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return block, np.stack([(mixed >> np.uint64(16 * i)).astype(np.uint16) for i in range(PROBES)], 1)


def filter_blocks(rows: int) -> int:
    """Blocks of a filter for so many rows."""
    return max(1, rows * BITS_PER_ROW // CELLS)


def repeat_filter(hashes: DataFrame, blocks: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Packed bits, a row for each block from `first` to before `last`: cells that at least two hashes of the frame's only
    column set. All hashes must belong to these blocks."""
    last = blocks if last is None else last
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the same hash more than once in a batch counts as two
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            block, cells = _cells(h, blocks)
            order = np.argsort(block, kind="stable")
            block, cells = block[order], cells[order]
            at, first = np.unique(block, return_index=True)
            parts = np.split(cells, first[1:]) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "cells"])

    def add_up(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(CELLS, np.uint8)
        for pdf in groups:
            for cells in pdf["cells"]:
                # a hash sets a cell once, even if two of its parts are equal
                own = np.sort(np.frombuffer(cells, np.uint16).reshape(-1, PROBES), 1)
                fresh = np.ones(own.shape, bool)
                fresh[:, 1:] = own[:, 1:] != own[:, :-1]
                n = np.bincount(own[fresh], minlength=CELLS)
                count = np.minimum(count + np.minimum(n, 2), 2).astype(np.uint8)
        yield pd.DataFrame({"block": [key[0]], "bits": [np.packbits(count >= 2).tobytes()]})

    cells = hashes.mapInArrow(gather, "block long, cells binary")
    bits = np.zeros((last - first, CELLS // 8), np.uint8)
    for row in cells.groupBy("block").applyInPandas(add_up, "block long, bits binary").toLocalIterator():
        bits[row["block"] - first] = np.frombuffer(row["bits"], np.uint8)
    return bits


def mark_repeats(df: DataFrame, hash_column: str, bits: np.ndarray, blocks: int, first: int = 0) -> DataFrame:
    """Adds `_dedup_maybe`: the second filter, of which these are the blocks from `first` on, knows the row's hash."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        block, cells = _cells(h.to_numpy(np.int64), blocks)
        bytes_ = shared.value[(block - first)[:, None], cells >> 3]
        return pd.Series(((bytes_ >> (7 - (cells & 7))) & 1).all(1))

    return df.withColumn("_dedup_maybe", known(hash_column))


def marked_repeats(df: DataFrame, hash_column: str, rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds `_dedup_maybe` to all rows, in as many passes as the filter has ranges of `most_bytes`."""
    blocks = filter_blocks(rows)
    step = max(1, most_bytes // (CELLS // 8))
    out = None
    for first in range(0, blocks, step):
        last, part = min(first + step, blocks), df
        if blocks > step:  # the block of a hash, as _cells has it
            block = F.shiftright(F.shiftrightunsigned(hash_column, 32) * F.lit(blocks), 32)
            part = df.filter((block >= first) & (block < last))
        marked = mark_repeats(part, hash_column, repeat_filter(part.select(hash_column), blocks, first, last), blocks, first)
        out = marked if out is None else out.unionByName(marked)
    return out


def _decide(df: DataFrame, rows: int, id_column: str, sha: str, most_bytes: int) -> DataFrame:
    """Adds _dedup_keep (id and row of the one that stays), _dedup_size and _dedup_kept. The frame must be a written table."""
    own = df.withColumns({"_dedup_hash": F.xxhash64(sha), "_dedup_row": F.struct(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"))})
    marked = marked_repeats(own, "_dedup_hash", rows, most_bytes).drop("_dedup_hash")
    once = marked.filter(~F.col("_dedup_maybe")).drop("_dedup_maybe")
    once = once.select("*", F.col("_dedup_row").alias("_dedup_keep"), F.lit(1).cast("long").alias("_dedup_size"), F.lit(True).alias("_dedup_kept"))
    maybe = marked.filter("_dedup_maybe").drop("_dedup_maybe").withColumn("_dedup_salt", F.pmod(F.xxhash64("_dedup_row.row"), F.lit(SALTS)))
    salted = maybe.groupBy(F.col(sha).alias("_dedup_sha"), F.col("_dedup_salt").alias("_dedup_salt2")).agg(F.max("_dedup_row").alias("m"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy(F.col("_dedup_sha").alias("_dedup_sha3")).agg(F.max("m").alias("_dedup_keep"), F.sum("n").alias("_dedup_size"))
    decided = salted.join(whole, F.col("_dedup_sha") == F.col("_dedup_sha3")).select("_dedup_sha", "_dedup_salt2", "_dedup_keep", "_dedup_size")
    more = maybe.join(decided, (F.col(sha) == F.col("_dedup_sha")) & (F.col("_dedup_salt") == F.col("_dedup_salt2")))
    more = more.drop("_dedup_sha", "_dedup_salt", "_dedup_salt2").withColumn("_dedup_kept", F.col("_dedup_row.row") == F.col("_dedup_keep.row"))
    return once.unionByName(more).drop("_dedup_row")


def annotate(df: DataFrame, rows: int, id_column: str = "doc_id", sha_column: str = "text_sha256", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds keep_id, group_size and kept (replacing columns of these names) to rows of a written table that have the digest
    of their text.

    `rows` sizes the filter; a wrong count costs time, not results.
    """
    found = _decide(df, rows, id_column, sha_column, most_bytes)
    found = found.withColumns({"keep_id": F.col("_dedup_keep.id"), "group_size": F.col("_dedup_size"), "kept": F.col("_dedup_kept")})
    return found.drop("_dedup_keep", "_dedup_size", "_dedup_kept")


def with_digest(df: DataFrame, text: str = "text", name: str = "text_sha256") -> DataFrame:
    """Adds the lower-case hexadecimal SHA-256 of the text after lower-casing A-Z, in UTF-8."""
    return df.withColumn(name, F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256))


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows that stay, with their own columns: of equal texts the one with the largest id."""
    own = df.select(F.col(text).alias("t"), *row_key(id_column, text))
    keys = staged(with_digest(own, "t", "_dedup_digest").drop("t"), "dedup-keys")
    copies = _decide(keys, keys.count(), "_key_id", "_dedup_digest", most_bytes).filter("_dedup_size > 1")
    found = copies.groupBy(*KEY).agg(F.max("_dedup_kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = staged(found.filter("NOT kept OR n > 1").select(*KEY, "kept"), "dedup-odd")
    repeats, once = odd.filter("kept").select(*KEY), without(df, odd, id_column, text)
    if repeats.isEmpty():
        return once
    more = join_keys(recorded(df, *row_key(id_column, text)), small(repeats), "inner").dropDuplicates(KEY)
    return once.unionByName(more.select("record.*"))
