"""Near duplicates by SimHash fingerprints that differ in few bits, found with BK-trees.

A fingerprint bit is the majority of that bit over the hashes of the text's word shingles. Texts with equal
fingerprints are one node. A shard is the set of fingerprints that agree in one of PARTS 16-bit parts: two that differ
in at most 3 bits agree in at least one of 4 parts, so every link lies in some shard, and only fingerprints of the same
shard are ever compared. A shard's fingerprints go one by one through a BK-tree, whose children are keyed by their
Hamming distance to the parent: a search follows only edges within the radius of the distance to the node it stands
on. A shard emits at most one edge for each fingerprint, to the smallest of its component there, never all pairs.
Shards over HOT fingerprints are cut again by parts of the bits that are left (12, then 9 of them), which is exact for the
same reason, so a family of many fingerprints that differ little is spread over shards that agree in 37 bits. Components
over all shards come from alternating star steps.

A shard's tree travels to its task with its shard by one shuffle; trees of all shards together grow with the corpus
and can't be broadcast.

`near_duplicates` links by one fingerprint alone. `one_of_each` is for dropping documents: it makes TABLES independent
fingerprints of each text's distinct words, which a few scattered edits hardly move; a passage that was added or cut out
in one piece moves them more, and many such pairs share no link. The exact rest comes from `shared_shingles`, which
connects all pairs whose word shingles have a Jaccard similarity of at least SIMILAR. The components of all these links
are candidates, and inside each only links of that similarity are kept (`near_copies`), so no pair is missed. Texts are
read once for fingerprints and shingles; the graph is one of row numbers, and members find their texts again by id and
two hashes of the text.

Defined cases: null text is empty; a text with fewer words than a shingle is one shingle; one without words has
fingerprint 0 and links like any other in `near_duplicates`, and is no near copy in `one_of_each`. In `near_duplicates`
an id that repeats is one document in its component, and null ids never become a component's name unless all its ids
are null. In `one_of_each` ids may be of any type that can be ordered, null ids and ids that repeat with different texts are
documents of their own, rows that share id and text stay or go together, the smallest id of a group stays, null last,
and of its rows the one that reads first. An empty table gives an empty table; extra columns aren't carried by
`near_duplicates` and stay untouched in `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, few_parts, join_keys, row_key, slices, small, staged, without
from .components import connected_components
from .near_copies import SIMILAR, near_groups, shingles_of, word_hashes
from .shared_shingles import beginning, pairs_by_shingles

SHINGLE, RADIUS, PARTS, HOT, SALTS, SEED = 3, 3, 4, 4096, 64, 42
TABLES = 8
#: Bits of a part at each level: of 64, of the 48 that are left, of the 36 that are left.
WIDTHS = (16, 12, 9)


def majority(hashes: np.ndarray) -> int:
    """Number whose bits are set where more than half of the hashes have them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # eight counters in a 64-bit number, which hold up to 255 rows
        sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text; bytes are lower-cased and split as ASCII only."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = (starts + sizes)[shingle - 1 :].tolist()
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends)), "<u8", len(ends))
    return majority(hashes)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints as a tree: a node's child at key d has distance d to it, and so has everything below that child."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, own = 0, len(self.values) - 1
        while own:
            d = (value ^ self.values[at]).bit_count()
            if (child := self.children[at].get(d)) is None:
                self.children[at][d] = own
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at most `radius` bits away."""
        found, open_ = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_:
            at = open_.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                low, high = d - radius, d + radius
                open_ += [child for key, child in below.items() if low <= key <= high]
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(place, first place of its component in this shard) of the values, without those that stand alone."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
        tree.add(value)
    return [(i, r) for i in range(len(values)) if (r := find(i)) != i]


def _cut(level: int, key: str, rest: str) -> Column:
    """Array of (key, rest) for the parts of the bits that are left: the part joins the key, the other bits go on."""
    width, out = WIDTHS[level], []
    for j in range(PARTS):
        low = width * j
        part = F.shiftrightunsigned(rest, low).bitwiseAND((1 << width) - 1)
        left = F.shiftleft(F.shiftrightunsigned(rest, low + width), low).bitwiseOR(F.col(rest).bitwiseAND((1 << low) - 1))
        out.append(F.struct((F.shiftleft(key, width + 2) + F.lit(j << width) + part).alias("key"), left.alias("rest")))
    return F.array(*out)


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges a, b over column node that connect all pairs of rows whose fp is within `radius` bits, at most 3.

    With a column table, only rows of the same table are linked. Each (table, fp) stands once.
    """
    if radius >= PARTS:
        raise ValueError(f"{PARTS} parts find links of up to {PARTS - 1} bits")
    table = F.col("table").cast("long") if "table" in fps.columns else F.lit(0).cast("long")
    rows = fps.select("fp", "node", table.alias("key"), F.col("fp").alias("rest"))
    done: list[DataFrame] = []
    for level in range(len(WIDTHS)):
        keyed = rows.select("fp", "node", F.explode(_cut(level, "key", "rest")).alias("c")).select("fp", "node", "c.key", "c.rest")
        if level + 1 == len(WIDTHS):
            done.append(keyed)
            break
        large = staged(few_parts(keyed.groupBy("key").count().filter(F.col("count") > hot).select("key"), 0), "simhash-large")
        if not large.limit(1).count():
            done.append(keyed)
            break
        done.append(keyed.join(small(large), "key", "left_anti"))
        rows = staged(keyed.join(small(large), "key", "left_semi").select("fp", "node", "key", "rest"), "simhash-hot")
    shards = done[0].select("fp", "node", "key")
    for level, more in enumerate(done[1:], 1):  # negative below the first level, so that no two levels share a key
        shards = shards.unionByName(more.select("fp", "node", (-F.col("key") * 2 - (level - 1) - 1).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            held.sort()
            return [(held[i][1], held[r][1]) for i, r in shard_links([v for v, _ in held], radius)]

        def pack(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            found = []
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            nodes = batch.column("node").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if start < stop and (k := int(keys[start])) != key:
                    found += done()
                    key, held = k, []
                held += zip(values[start:stop], nodes[start:stop])
            if found:
                yield pack(found)
        if found := done():
            yield pack(found)

    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links reach, of every document."""
    own = staged(fingerprints(docs, id_column, text, shingle).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "fingerprints")
    # one row for each (fingerprint, salt), then one for each fingerprint: a fingerprint that many share is spread out
    salted = staged(own.groupBy("fp", "salt").agg(F.min("doc_id").alias("first")), "fingerprint-salts")
    nodes = staged(salted.groupBy("fp").agg(F.min("first").alias("first")), "fingerprint-nodes")
    parts = staged(connected_components(staged(links(nodes.select("fp", F.col("fp").alias("node")), radius), "simhash-links")), "simhash-components")
    named = nodes.join(parts, nodes["fp"] == parts["node"]).groupBy("component").agg(F.min("first").alias("component_id"))
    named = small(staged(named, "simhash-names"))  # a component may have very many nodes
    linked = parts.join(named, "component").select(F.col("node").alias("fp"), F.col("component_id"))
    all_ = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    spread = salted.select("fp", "salt").join(all_, "fp")
    return own.join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def word_prints(words: np.ndarray, tables: int = TABLES) -> list[int]:
    """Independent SimHashes of a text's distinct words, from the words' hashes; signed 64-bit numbers."""
    own, out = np.unique(words), []
    for t in range(tables):
        # a fixed mixing of the word hashes, another one in each table
        h = (own + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        out.append(majority(h))
    return np.array(out, np.uint64).view(np.int64).tolist()


def signatures(rows: DataFrame, tables: int = TABLES, similar: float = SIMILAR) -> DataFrame:
    """The columns of rows but t, the text's bytes, and prints, tokens and need of each text that has words."""
    keep = [f for f in rows.schema if f.name != "t"]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "prints array<long>", "tokens binary", "need int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            prints, tokens, needs, kept = [], [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                words = word_hashes(t)
                if len(words):
                    some, need = beginning(shingles_of(words), similar)
                    prints.append(word_prints(words, tables))
                    tokens.append(some.tobytes())
                    needs.append(need)
                    kept.append(i)
            own = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(prints, pa.list_(pa.int64())), pa.array(tokens, pa.binary()), pa.array(needs, pa.int32())], [*names, "prints", "tokens", "need"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other work

    return rows.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tables: int = TABLES, similar: float = SIMILAR) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, with all its columns; others stay as they are."""
    key = row_key(id_column, text)
    t = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")
    own = staged(signatures(docs.select(*key, t), tables, similar).withColumn("row", F.monotonically_increasing_id()), "word-prints")
    long = own.select("row", F.posexplode("prints").alias("table", "fp"))
    nodes = staged(long.groupBy("table", "fp").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "word-print-nodes")
    shared = nodes.filter("n > 1").select("table", "fp", "node")
    edges = long.join(shared, ["table", "fp"]).filter("row <> node").select(F.col("row").alias("x"), F.col("node").alias("y"))
    edges = edges.union(links(nodes)).union(pairs_by_shingles(own.select(F.col("row").alias("doc_id"), "tokens", "need")))
    parts = small(staged(connected_components(edges, "x", "y"), "candidate-groups").withColumnRenamed("node", "row"))
    # rows that share id and text are one member
    members = own.select("row", *KEY).join(parts, "row").groupBy(*KEY).agg(F.min("row").alias("row"), F.min("component").alias("component"))
    members = staged(members, "candidate-members")
    texts = join_keys(docs.select(*key, t), small(members), "inner").select(F.col("row").alias("doc_id"), "component", "t")
    grouped = staged(members.join(near_groups(texts, similar).withColumnRenamed("doc_id", "row"), "row"), "near-groups")
    stay = grouped.groupBy("label").agg(F.min_by("row", F.struct(F.col("_key_id").isNull(), "_key_id", "row")).alias("row")).select("row")
    gone = staged(grouped.join(stay, "row", "left_anti").select(*KEY), "near-copies")
    return without(docs, gone, id_column, text)
