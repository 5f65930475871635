"""A Merkle manifest of a dataset: a hash for each record, each source and the whole, with a proof for each record.

Leaves are ranked by id in their source, and every node carries the interval [low, high) of leaf ranks that it covers.
Going up, the RUN nodes whose intervals lie in one bucket of RUN ** level ranks become one node, until a source has one.
Going down, a node finds its parent by a join on (source, bucket of the parent's level) with its interval inside the
parent's; a parent holds the intervals and hashes of its children, so the parent's interval less the node's own tells the
siblings on its left and right. Nodes hand their siblings down to the children, so a record gets the siblings of all its
ancestors from its parent alone. The sources' roots are the leaves of a second tree of the same kind.

Ranks come from running counts over ranges of (source, id) (`operators/scan.py`), runs have at most RUN members, and joins
are on (source, bucket), so a source with any share of all rows is spread like the others. Levels are written one by one,
each a RUNth of the one before. Texts are hashed where they are read and don't shuffle.

Defined cases: null fields count as `-`; null sources are a source of their own, before the others; null ids come first and
leaves of equal ids go by their hash, so repeated rows are leaves of their own with one order; a source with one record has
its leaf as root; an empty table gives an empty table; extra columns aren't read; texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Blocks
from .common import ascii_lower, staged

RUN, TAMPERED = 16, 5
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field as it is hashed: its byte count and value, or a mark for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None, fields: list[str] = FIELDS) -> Column:
    """The hash of a record, or of the record with another text."""
    return F.sha2(F.concat(*[field(text if text is not None and c == fields[-1] else F.col(c)) for c in fields]), 256)


def _grouped(nodes: DataFrame, level: int) -> DataFrame:
    """src, bucket and kids: the nodes in each bucket of RUN ** level ranks, by interval. At most RUN each."""
    bucket = F.floor(F.col("low") / RUN**level).cast("long").alias("bucket")
    extra = [c for c in nodes.columns if c != "src"]
    return nodes.groupBy("src", bucket).agg(F.sort_array(F.collect_list(F.struct(*extra))).alias("kids"))


def _parents(grouped: DataFrame) -> DataFrame:
    """Groups that are nodes: a source's only node stays the root and has no parent."""
    return grouped.filter((F.size("kids") > 1) | (F.col("kids")[0]["low"] > 0))


def _as_nodes(parents: DataFrame) -> DataFrame:
    joined = F.concat_ws("", F.transform("kids", lambda k: k["hash"]))
    return parents.select("src", F.col("kids")[0]["low"].alias("low"), F.element_at("kids", -1)["high"].alias("high"), F.sha2(joined, 256).alias("hash"))


def levels(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The groups of each level, written, and src and hash of each root.

    `leaves` has src, low, high, hash, and may have more columns, which the lowest level's kids carry.
    """
    found, nodes, roots = [], leaves, []
    while True:
        grouped = staged(_grouped(nodes, len(found) + 1), f"level-{len(found) + 1}")
        single = grouped.filter((F.size("kids") == 1) & (F.col("kids")[0]["low"] == 0))
        roots.append(single.select("src", F.col("kids")[0]["hash"].alias("hash"), F.lit(len(found)).alias("height")))
        found.append(grouped)
        nodes = _as_nodes(_parents(grouped))
        if nodes.isEmpty():
            return found, staged(reduce(DataFrame.union, roots), "roots")


def siblings(kids: Column, low: Column, high: Column) -> Column:
    """What lies in the parent's interval and not in the node's: hashes on the left, and on the right."""
    left = F.concat_ws("", F.transform(F.filter(kids, lambda k: k["high"] <= low), lambda k: k["hash"]))
    right = F.concat_ws("", F.transform(F.filter(kids, lambda k: k["low"] >= high), lambda k: k["hash"]))
    return F.struct(left.alias("left"), right.alias("right"))


def leaves_with_paths(grouped: list[DataFrame], above: DataFrame) -> DataFrame:
    """src, the leaf's columns and path: its siblings on each level, from its own up to those of `above` (src, path)."""
    known = None  # src, low, high, path of the nodes one level up
    for level in range(len(grouped), 0, -1):
        groups = grouped[level - 1]
        # a source whose only node is of this level's kids: what is above its root
        alone = groups.filter((F.size("kids") == 1) & (F.col("kids")[0]["low"] == 0)).join(above.withColumnRenamed("src", "_src"), (F.col("src") == F.col("_src"))).select("src", "kids", "path", F.lit(True).alias("root"))
        every = alone
        if known is not None:
            parent = known.select(F.col("src").alias("_src"), F.floor(F.col("low") / RUN**level).cast("long").alias("_bucket"), F.col("low").alias("_low"), F.col("high").alias("_high"), "path")
            inside = (F.col("kids")[0]["low"] >= F.col("_low")) & (F.element_at("kids", -1)["high"] <= F.col("_high"))
            on = (F.col("src") == F.col("_src")) & (F.col("bucket") == F.col("_bucket")) & inside
            every = alone.union(_parents(groups).join(parent, on).select("src", "kids", "path", F.lit(False)))
        each = every.select("src", "kids", "path", "root", F.explode("kids").alias("kid"))
        own = F.array(siblings(F.col("kids"), F.col("kid.low"), F.col("kid.high"))).cast(_PATH)
        path = F.when(F.col("root"), F.col("path")).otherwise(F.concat(own, "path")).alias("path")
        known = each.select("src", "kid.*", path)
        if level > 1:
            known = staged(known.select("src", "low", "high", "path"), "paths")
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda now, at: F.sha2(F.concat(at["left"], now, at["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: list[str] = FIELDS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root and verified of every record.

    The first of `fields` is the id, the second the source, the last the text. `tampered` is what the text has become, for
    the check of each record against the untampered tree.
    """
    now = F.when(tampered.isNotNull(), leaf_hash(tampered, fields)) if tampered is not None else F.lit(None).cast("string")
    source = F.coalesce(F.concat(F.lit("="), F.col(fields[1]).cast("string")), F.lit(""))  # null is before all
    light = docs.select(F.col(fields[0]).alias("doc_id"), source.alias("src"), leaf_hash(None, fields).alias("hash"), now.alias("now"))
    ranked = Blocks(staged(light, "leaves"), ["src"], [F.col("doc_id").asc_nulls_first(), "hash"])
    leaves = ranked.numbered(ranked.rows, "low").select("src", "low", (F.col("low") + 1).alias("high"), "hash", "doc_id", "now")
    grouped, subroots = levels(leaves)

    order = Blocks(subroots.select(F.lit("").alias("all"), F.col("src").alias("name"), "hash"), ["all"], ["name"])
    tops = order.numbered(order.rows, "low").select(F.col("all").alias("src"), "low", (F.col("low") + 1).alias("high"), "hash", "name")
    top_groups, root = levels(tops)
    nothing = root.select("src", F.array().cast(_PATH).alias("path"))
    above = leaves_with_paths(top_groups, nothing).select(F.col("name").alias("src"), "path", F.col("hash").alias("subroot"))
    above = staged(above.crossJoin(F.broadcast(root.select(F.col("hash").alias("root")))), "above")  # one row

    # subroot and root go down with the path, as its last entry
    tail = F.array(F.struct(F.col("subroot").alias("left"), F.col("root").alias("right"))).cast(_PATH)
    rows = leaves_with_paths(grouped, above.select("src", F.concat("path", tail).alias("path")))
    path = F.slice("path", F.lit(1), F.size("path") - 1)
    last = F.element_at("path", -1)
    rows = rows.select("doc_id", F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"), F.col("hash").alias("leaf"), last["left"].alias("subroot"), last["right"].alias("root"), path.alias("path"), "now")
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256)
    rows = rows.withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return rows.select("doc_id", "source", "leaf", "subroot", "root", "path", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_cased_fifth(id_column: str = "doc_id", text: str = "text") -> Column:
    """The tampering of the check: every TAMPEREDth id's text, by its crc32, in lower case; null for the others."""
    return F.when(F.crc32(F.col(id_column).cast("string").cast("binary")) % TAMPERED == 0, ascii_lower(F.col(text)))
