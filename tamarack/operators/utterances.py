"""Utterances in a sequence of short frames: the batch form, for keys of any length.

A frame speaks if its level is over the threshold. An utterance starts with a speaking frame and ends after `silence`
frames in a row that don't speak, or after `most` frames; frames of silence inside it and at its end count.

So a key's frames are a state machine: idle, or in an utterance with so many frames, so many of them silent at its end. A
key may hold any share of all frames, so its frames are not gathered: they lie in blocks of ranges (`operators/scan.py`),
and the machine runs over blocks in three steps.

1. A block can't know in which state it is entered. For a key that goes on into other blocks it yields the whole function
   from entry state to exit state; there are at most 1 + most * silence states, and two such keys in a block.
2. Functions of a key's blocks are composed, two neighbours at a time, until each block knows its entry state.
3. Every block runs from its known state and emits the utterances that end there.

An utterance's end follows from its start by two lookups (its cap, the next run of silence), so blocks go from utterance to
utterance, not from frame to frame.

Defined cases: null levels don't speak; null keys are a key of their own; an utterance that is still running at its key's
last frame ends there; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import written
from .scan import Blocks

FRAME, SILENCE, MOST, FIRST_BLOCK, NEXT_BLOCK = 0.1, 4, 250, 6, 5


def blocks(frames: Column, first: int = FIRST_BLOCK, after: int = NEXT_BLOCK) -> Column:
    """Blocks handed on while an utterance lasts: one at `first` frames, then one for every `after`; a rest is flushed at its end."""
    return F.when(frames < first, 1).otherwise(1 + F.ceil((frames - first) / after)).cast("int")


class Piece:
    """A key's frames in one block. A state is 0 where idle, else 1 + (frames - 1) * silence + quiet."""

    def __init__(self, speaks: np.ndarray, silence: int, most: int):
        self.size, self.silence, self.most = len(speaks), silence, most
        self.spoken = np.flatnonzero(speaks)
        # where a run of silence after speech becomes complete, ascending
        after = np.append(self.spoken[1:], self.size) - self.spoken - 1
        self.silent = self.spoken[after >= silence] + silence

    def _end(self, start: int) -> int:
        """Last frame of an utterance that starts here; size or more where the piece doesn't have it."""
        cap, at = start + self.most - 1, np.searchsorted(self.silent, start)
        return min(cap, int(self.silent[at])) if at < len(self.silent) else cap

    def _left(self, start: int) -> int:
        """State at the piece's end of an utterance that started here and goes on."""
        return 1 + (self.size - start - 1) * self.silence + self.size - 1 - int(self.spoken[-1])

    def _first(self, state: int) -> int:
        """Last frame of the utterance that runs at the entry, or -1 where none does."""
        if not state:
            return -1
        frames, quiet = (state - 1) // self.silence + 1, (state - 1) % self.silence
        cap = self.most - frames - 1
        if not len(self.spoken) or self.spoken[0] >= self.silence - quiet:
            return min(cap, self.silence - quiet - 1)
        return min(cap, int(self.silent[0])) if len(self.silent) else cap

    def _through(self, state: int) -> int:
        """Exit state where the utterance of the entry goes on through the whole piece."""
        frames, quiet = (state - 1) // self.silence + 1, (state - 1) % self.silence
        quiet = self.size - 1 - int(self.spoken[-1]) if len(self.spoken) else quiet + self.size
        return 1 + (frames + self.size - 1) * self.silence + quiet

    def run(self, state: int) -> tuple[list[tuple[int, int]], int]:
        """(last frame, frames) of each utterance that ends in the piece, and the exit state."""
        found, at = [], 0
        if state:
            end = self._first(state)
            if end >= self.size:
                return [], self._through(state)
            found.append((end, (state - 1) // self.silence + 2 + end))
            at = end + 1
        while True:
            k = int(np.searchsorted(self.spoken, at))
            if k == len(self.spoken):
                return found, 0
            start = int(self.spoken[k])
            end = self._end(start)
            if end >= self.size:
                return found, self._left(start)
            found.append((end, end - start + 1))
            at = end + 1

    def function(self) -> np.ndarray:
        """The exit state of every entry state."""
        n = len(self.spoken)
        exits = np.zeros(n + 1, np.int32)  # from idle before the k-th speaking frame
        caps = self.spoken + self.most - 1
        at = np.searchsorted(self.silent, self.spoken)
        ends = np.minimum(caps, np.append(self.silent, np.iinfo(np.int64).max)[at])
        following = np.searchsorted(self.spoken, ends + 1).tolist()
        ends = ends.tolist()
        for k in range(n - 1, -1, -1):
            exits[k] = self._left(int(self.spoken[k])) if ends[k] >= self.size else exits[following[k]]
        table = np.zeros(1 + (self.most - 1) * self.silence, np.int32)
        table[0] = exits[0]
        for state in range(1, len(table)):
            end = self._first(state)
            table[state] = self._through(state) if end >= self.size else exits[np.searchsorted(self.spoken, end + 1)]
        return table


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Scalar, int, np.ndarray, bool]]:
    """Block, key, number of the first frame, speaks, and whether it is the block's last, of each key's frames in each block.

    Batches (block, k, n, speaks) come sorted. Numbers go up by one inside a key and start anew with the next, so they tell
    keys apart. A piece is held as one bit a frame.
    """
    block = key = first = after = None
    held: list[tuple[np.ndarray, int]] = []

    def piece() -> np.ndarray:
        return np.concatenate([np.unpackbits(bits, count=n).astype(bool) for bits, n in held])

    for batch in batches:
        of, number, speaks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "n", "speaks"))
        cuts = (np.flatnonzero((np.diff(of) != 0) | (np.diff(number) != 1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(of)]):
            if a == b:
                continue
            if held and (of[a] != block or number[a] != after):
                yield block, key, first, piece(), bool(of[a] != block)
                held = []
            if not held:
                block, key, first = int(of[a]), batch.column("k")[a], int(number[a])
            held.append((np.packbits(speaks[a:b]), b - a))
            after = number[b - 1] + 1
    if held:
        yield block, key, first, piece(), True


def _going_on(blocks_: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """For each block whose last key goes on into the next one: the block where that key starts, the place in its chain of
    blocks, and the next block. A block is told by its number, its first frame's number and its rows."""
    found: dict[int, tuple[int, int, int]] = {}
    inside: dict[int, tuple[int, int]] = {}
    blocks_ = sorted(blocks_)
    for (block, first, rows), (following, number, _) in zip(blocks_, blocks_[1:]):
        if number > 1:
            one_key = first > 1 and first + rows == number
            chain, at = inside[block] if one_key else (block, 0)
            found[block], inside[following] = (chain, at, following), (chain, at + 1)
    return found


def _entry_states(functions: DataFrame, going_on: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """The state in which each block is entered. Functions of a chain (chain, at, function) are composed by doubling: in each
    round a row takes in as many blocks before it as all rounds before together."""
    step, most = 1, max(at for _, at, _ in going_on.values())
    rows = functions
    while step <= most:
        before = rows.select(F.col("chain").alias("_chain"), (F.col("at") + step).alias("_at"), F.col("function").alias("_before"))
        joined = rows.join(before, (F.col("chain") == F.col("_chain")) & (F.col("at") == F.col("_at")), "left")
        both = F.transform("_before", lambda s: F.element_at("function", s + 1))
        rows = written(joined.select("chain", "at", F.coalesce(both, "function").alias("function")), "state-functions")
        step *= 2
    left = {(r["chain"], r["at"]): r["state"] for r in rows.select("chain", "at", F.element_at("function", 1).alias("state")).collect()}  # a row a block
    return {following: left[chain, at] for chain, at, following in going_on.values()}


def utterances(frames: DataFrame, key: str, order: list[str], level: str, threshold: float, silence: int = SILENCE, most: int = MOST, block_count: int | None = None) -> DataFrame:
    """key, start, end (frame numbers from 1), frames and blocks of each utterance."""
    by = [f"o{i}" for i in range(len(order))]
    narrow = frames.select(F.col(key).alias("k"), *[F.col(o).alias(b) for o, b in zip(order, by)], F.coalesce(F.col(level) > threshold, F.lit(False)).alias("speaks"))
    ranges = Blocks(narrow, ["k"], by, block_count)
    rows = ranges.numbered(ranges.rows, "n").select(F.col(ranges.block).alias("block"), "k", (F.col("n") + 1).alias("n"), "speaks")
    rows = written(rows, "frames")
    firsts = rows.groupBy("block").agg(F.min(F.struct("k", "n")).alias("m"), F.count(F.lit(1)).alias("rows")).select("block", "m.n", "rows").collect()  # a row a block
    going_on = _going_on([tuple(r) for r in firsts])
    dealt = rows.repartition("block").sortWithinPartitions("block", "k", "n")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, speaks, last in _pieces(batches):
            if last and block in going_on:
                chain, at, _ = going_on[block]
                table = Piece(speaks, silence, most).function()
                yield pa.RecordBatch.from_arrays([pa.array([chain], pa.int64()), pa.array([at], pa.int64()), pa.array([table.tolist()], pa.list_(pa.int32()))], ["chain", "at", "function"])

    entry: dict[int, int] = {}
    if going_on:
        entry = _entry_states(written(dealt.mapInArrow(functions, "chain long, at long, function array<int>"), "state-functions"), going_on)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, k, first, speaks, last in _pieces(batches):
            piece = Piece(speaks, silence, most)
            found, state = piece.run(entry.get(block, 0) if first > 1 else 0)
            if state and not (last and block in going_on):  # the key ends here
                found.append((piece.size - 1, (state - 1) // silence + 1))
            if found:
                end, count = np.array(found, np.int64).T
                arrays = [pa.repeat(k, len(found)), pa.array(first + end - count + 1), pa.array(first + end), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "start", "end", "frames"])

    kind = narrow.schema["k"].dataType.simpleString()
    found = dealt.mapInArrow(emit, f"k {kind}, start long, end long, frames int").withColumnRenamed("k", key)
    return found.withColumn("blocks", blocks(F.col("frames")))
