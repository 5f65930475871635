"""The prefix trie of conversations, from whole sequences.

Conversations are rebuilt first: the first h turns of conversation c - c % 100, then c's own turns after its first h, with
h = crc32(decimal c) % STARTS. Turns are told by a hash of role and text, and a prefix by two 64-bit exclusive-ors of the
hashes of (position, turn), so a prefix's key is a running value. Then:

1. Equal rebuilt conversations collapse into one sequence, with its weight, its smallest conversation and its end list.
2. Only one conversation of each sequence goes on: its prefixes, with the sequence's weight, are summed into nodes.
3. Sequences that are proper prefixes of others are dropped by an anti-join; the rest are the leaves.
4. What a subtree holds is summed over the sequences that pass through a node: a sequence adds its weight times the rest
   of its own length, and takes away the part of it that no smaller sequence has counted. For a node belongs to its smallest
   conversation, and what one conversation owns on its path is all from some depth on.

No turn's text is shuffled. Turns are numbered and prefixes run over ranges of (conversation, order), so a conversation of
any length is spread; nodes that very many conversations share, such as the root, are summed before they shuffle; parents
of very many nodes are broadcast, as there are at most PARENTS of them. End lists are written as pieces of at most PIECE
ids in many tasks, and a task of its own feeds the pieces of a sequence to SHA-256, which takes them in order only.

Defined cases: turns go by number, null first, and by their hash where numbers repeat; null roles and texts are empty;
rows with a null conversation belong to none and are left out; a rebuilt conversation may have no turns and then ends in the
root; an empty table gives an empty table; extra columns aren't read; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Blocks
from .common import staged

STARTS, FAMILY, PIECE, PARENTS = 6, 100, 4096, 10_000
NODE = ["depth", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, chars of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return staged(rows, "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, position (from 1), digest and chars of every rebuilt turn; and conv_id of every conversation."""
    ranges = Blocks(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"])
    rows = staged(ranges.numbered(ranges.rows, "nth"), "numbered")  # nth counts from 0
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % STARTS
    every = staged(rows.groupBy("conv_id").agg(F.max("nth").alias("last")).select("conv_id", F.col("last") + 1, first.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).toDF("conv_id", "n", "h", "base"), "conversations")
    # a base has at most STARTS - 1 turns here, and at most 2 * FAMILY conversations that begin with them
    starts = rows.filter((F.col("nth") < STARTS - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "nth", "digest", "chars")
    heads = every.join(starts, "base").filter("nth < h").select("conv_id", (F.col("nth") + 1).alias("position"), "digest", "chars")
    of_base = every.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = every.join(of_base, "base", "left").select("conv_id", "h", (F.least(F.coalesce("base_n", F.lit(0)), F.col("h")) - F.col("h") + 1).alias("shift"))
    tails = ranges.with_facts(rows, shift).filter("nth >= h").select("conv_id", (F.col("nth") + F.col("shift")).alias("position"), "digest", "chars")
    return heads.union(tails), every.select("conv_id")


def prefixes(rows: DataFrame) -> tuple[Blocks, DataFrame]:
    """Adds to every rebuilt turn the key (a, b) of the prefix that ends with it, that of its parent, and the chars up to it."""
    keyed = rows.withColumns({"own_a": F.xxhash64(F.lit(1), "position", "digest"), "own_b": F.xxhash64(F.lit(2), "position", "digest")}).drop("digest")
    ranges = Blocks(staged(keyed, "rebuilt"), ["conv_id"], ["position"])
    found = ranges.running(ranges.rows, {"a": ("xor", F.col("own_a")), "b": ("xor", F.col("own_b")), "upto": ("sum", F.col("chars"))})
    parent = {"up_a": F.col("a").bitwiseXOR(F.col("own_a")), "up_b": F.col("b").bitwiseXOR(F.col("own_b"))}
    return ranges, staged(found.withColumns(parent).withColumn("depth", F.col("position")).drop("own_a", "own_b"), "prefixes")


def sequences(every: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequence (depth, a, b, total chars) that each conversation is, and the sequences with weight and smallest conversation."""
    end = found.groupBy("conv_id").agg(F.max_by(F.struct("depth", "a", "b", F.col("upto").alias("total")), "position").alias("end"))
    none = F.lit(0).cast("long")
    of = every.join(end, "conv_id", "left").select("conv_id", *[F.coalesce(f"end.{c}", none).alias(c) for c in (*NODE, "total")])
    of = staged(of, "ends")
    return of, staged(of.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.max("total").alias("total")), "sequences")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of a sequence, which come in order, into texts of at most PIECE ids."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(NODE, key), first=ids[0], text=",".join(map(str, ids)))], schema=pa.schema([*[(c, pa.int64()) for c in NODE], ("first", pa.int64()), ("text", pa.string())]))

    for batch in batches:
        for *now, conv in zip(*[batch.column(c).to_pylist() for c in (*NODE, "conv_id")]):
            if now != key or len(ids) == PIECE:
                if ids:
                    yield piece()
                key, ids = now, []
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each sequence, which come in order; one state at a time."""
    key, state = None, None

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(NODE, key), ends_sha256=state.hexdigest())], schema=pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())]))

    for batch in batches:
        for *now, text in zip(*[batch.column(c).to_pylist() for c in (*NODE, "text")]):
            if now != key:
                if key is not None:
                    yield result()
                key, state = now, hashlib.sha256(text.encode())
            else:
                state.update(b",")
                state.update(text.encode())
    if key is not None:
        yield result()


def end_lists(of: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of every sequence."""
    dealt = of.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = dealt.mapInArrow(_pieces, "depth long, a long, b long, first long, text string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def _parent_of(owned: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth and parent_conv_id of each conversation's first own node."""
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    keys = ["depth", "up_a", "up_b"]
    limit = nodes.count() // PARENTS + 1
    many = F.broadcast(parents.filter(F.col("n_children") > limit).drop("n_children"))  # fewer than PARENTS, as their children are different nodes
    firsts = owned.filter("depth > 0")
    hot = firsts.join(many, keys)
    rest = firsts.join(many, keys, "left_anti").join(parents.filter(F.col("n_children") <= limit).drop("n_children"), keys)
    return hot.union(rest).select("conv_id", "depth", "parent_conv_id")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    rows, every = rebuilt(turns_of(conversations))
    ranges, found = prefixes(rows)
    of, whole = sequences(every, found)

    # prefixes of one conversation of each sequence; the root is a prefix of each
    none = F.lit(0).cast("long")
    chosen = ranges.with_facts(found, whole.select("conv_id", "weight", "total", F.col("depth").alias("length"))).filter("weight IS NOT NULL")
    names = [*NODE, "up_a", "up_b", "conv_id", "chars", "upto", "weight", "length"]
    roots = whole.select(*[none.alias(c) for c in (*NODE, "up_a", "up_b")], "conv_id", none.alias("chars"), none.alias("upto"), "weight", F.col("depth").alias("length"))
    weighted = chosen.select(*names).unionByName(roots)
    nodes = weighted.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
        F.max(F.col("upto") - F.col("chars")).alias("before"), F.max(F.col("depth") < F.col("length")).alias("inner"),
    )
    nodes = staged(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", none)), "nodes")

    leaves = whole.join(nodes.filter("inner"), NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owned = staged(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "up_a", "up_b")).alias("x")).select("conv_id", "x.*"), "owned")
    facts = whole.join(leaves, "conv_id", "left").join(owned.select("conv_id", F.col("before").alias("counted")), "conv_id", "left")
    facts = staged(facts.select("conv_id", "weight", "total", F.coalesce("leaf", none).alias("leaf"), F.coalesce("counted", "total").alias("counted")), "facts")
    passing = ranges.with_facts(found, facts).filter("weight IS NOT NULL").select(*NODE, (F.col("upto") - F.col("chars")).alias("before"), "weight", "total", "leaf", "counted")
    passing = passing.union(facts.select(none, none, none, none, "weight", "total", "leaf", "counted"))
    saved = F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", "counted"))
    below = passing.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    out = nodes.join(below, NODE).join(end_lists(of), NODE, "left").join(_parent_of(owned, nodes), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
