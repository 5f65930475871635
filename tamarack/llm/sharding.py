"""Sharding by fixed virtual slots: records hash into SLOTS slots, slots have bytes, a versioned map gives slots to shards.

A record's slot follows from its id alone and never changes. The bytes of each slot are summed over all records, and the
map deals slots to shards by size, the largest first, each to the shard that has the fewest bytes so far. A slot with more
than PART of a shard's fair share, of bytes or of rows, and several rows (an id that very many rows have, or null) is dealt
in parts, rows going to a part by the number that the scan gave them. Maps are small tables, at most SLOTS + 2 * SHARE_PARTS
rows for each of the shards, written as version=N below a folder. `rebalanced` edits a map for new sizes or another
number of shards: shards that are over their fair share by SLACK let go of their smallest slots until they are down to it, and only what they
let go moves.

Everything is DataFrame functions; also the dealing, which is a fold over one row's array of slots. Texts are read once
and don't shuffle, except where `write` puts them into their shards' files.

Defined cases: a null text has no bytes and so the size OVERHEAD; null ids share a slot, which is dealt in parts when it is
large; repeated rows are rows of their own and may lie in different parts; fewer records than shards leave shards empty;
an empty table gives an empty table and an empty map; ids may be of any type; extra columns are left alone by `place` and
`write`, whose own columns replace columns of the same names; texts of any length count whole, and one that is larger than
a fair share makes its shard larger than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import Blocks
from .common import staged

SHARDS, SLOTS, OVERHEAD, SEED = 24, 6144, 8, 13
#: A slot with more than a PARTth of a shard's fair share, and several rows, is dealt in parts of about that size.
PART = 8
#: A shard with at most so many fair shares keeps all its slots when a map is edited.
SLACK = 1.01
MAP = "slot int, part int, parts int, shard int, bytes long, rows long"


def slot_of(id_column: str, slots: int = SLOTS) -> Column:
    """A record's slot; the id is its only input."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.col(id_column).cast("string")), F.lit(slots)).cast("int")


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _light(docs: DataFrame, id_column: str, text: str, slots: int) -> DataFrame:
    """What is needed of each row: doc_id, size, text_crc32, slot and the number that the scan gave it."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")
    return docs.select(F.col(id_column).alias("doc_id"), size_of(text).alias("size"), crc, slot_of(id_column, slots).alias("slot"), F.monotonically_increasing_id().alias("row"))


def _part(parts: Column) -> Column:
    """A row's part of its slot."""
    return F.when(parts > 1, F.pmod(F.xxhash64(F.lit(SEED + 1), "row"), parts)).otherwise(0).cast("int")


def measure(light: DataFrame, shards: int = SHARDS) -> DataFrame:
    """slot, part, parts, bytes and rows over all records: at most SLOTS rows, and PART * shards * 2 parts more."""
    sums = staged(light.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).coalesce(1), "slots")
    fair = sums.agg((F.sum("bytes") / (shards * PART)).alias("fair_bytes"), (F.sum("rows") / (shards * PART)).alias("fair_rows"))
    need = F.greatest(F.ceil(F.col("bytes") / F.col("fair_bytes")), F.ceil(F.col("rows") / F.col("fair_rows")))
    sized = sums.crossJoin(F.broadcast(fair)).withColumn("parts", F.least(need, F.col("rows")).cast("int"))  # one row
    large = sized.filter("parts > 1").select("slot", "parts")  # each has more than a 1 / (shards * PART)th of all
    whole = sized.filter("parts = 1").select("slot", F.lit(0).alias("part"), "parts", "bytes", "rows")
    cut = light.join(F.broadcast(large), "slot").withColumn("part", _part(F.col("parts")))
    cut = cut.groupBy("slot", "part", "parts").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return whole.union(cut.select(whole.columns))


def dealt(parts: DataFrame, shards: int = SHARDS, kept: DataFrame | None = None) -> DataFrame:
    """Gives each part to the shard with the fewest bytes, the largest first, on top of what `kept` already gives.

    Both tables are of the size of a map, so they are one row's array.
    """
    largest = F.struct((-F.col("bytes")).alias("order"), "slot", "part", "parts", "bytes", "rows")
    items = parts.agg(F.sort_array(F.collect_list(largest)).alias("items"))
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    if kept is None:
        start = items.withColumn("loads", F.transform(numbers, lambda i: F.lit(0).cast("long")))
    else:
        loads = kept.groupBy("shard").agg(F.sum("bytes").alias("load")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("of"))
        start = items.crossJoin(loads).withColumn("loads", F.transform(numbers, lambda i: F.coalesce(F.element_at("of", i), F.lit(0).cast("long"))))  # one row each

    def step(state: Column, item: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"]))
        loads = F.transform(state["loads"], lambda load, i: load + F.when(i + 1 == at, item["bytes"]).otherwise(F.lit(0).cast("long")))
        return F.struct(loads.alias("loads"), F.array_append(state["owners"], (at - 1).cast("int")).alias("owners"))

    zero = F.struct(F.col("loads"), F.array().cast("array<int>").alias("owners"))
    owners = F.aggregate("items", zero, step, lambda state: state["owners"])
    rows = start.select(F.explode(F.arrays_zip("items", owners.alias("owners"))).alias("x"))
    new = rows.select("x.items.slot", "x.items.part", "x.items.parts", F.col("x.owners").alias("shard"), "x.items.bytes", "x.items.rows")
    return new if kept is None else kept.select(new.columns).union(new)


def rebalanced(old: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map edited for the sizes that `measure` gives now: what needn't move stays where it is.

    A slot that is dealt in another number of parts than before counts as new; a slot that is gone leaves the map.
    """
    now = sizes.select("slot", "part", "parts", "bytes", "rows").join(old.select("slot", "part", "parts", "shard"), ["slot", "part", "parts"], "left")
    fair = now.agg((F.sum("bytes") / shards).alias("fair"))
    own = Window.partitionBy("shard")  # a shard's slots
    held = now.filter(F.col("shard") < shards).crossJoin(F.broadcast(fair))  # one row
    held = held.withColumns({"load": F.sum("bytes").over(own), "upto": F.sum("bytes").over(own.orderBy(F.desc("bytes"), "slot", "part"))})
    # down to the slot that reaches the fair share, so that what is let go is no more than new shards need
    stays = held.filter((F.col("load") <= F.col("fair") * SLACK) | (F.col("upto") - F.col("bytes") < F.col("fair")))
    stays = staged(stays.select("slot", "part", "parts", "shard", "bytes", "rows"), "kept-slots")
    free = now.drop("shard").join(stays.select("slot", "part"), ["slot", "part"], "left_anti")
    return dealt(free, shards, stays)


def write_map(table: DataFrame, directory: str) -> int:
    """Writes a map as the next version; earlier ones stay. Two writers of one version can't both succeed."""
    spark = table.sparkSession
    version = max([0, *versions(spark, directory)]) + 1
    table.select("slot", "part", "parts", "shard", "bytes", "rows").coalesce(1).write.mode("errorifexists").parquet(f"{directory}/version={version}")
    return version


def versions(spark: SparkSession, directory: str) -> list[int]:
    """The finished versions in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()[8:]) for p in names if p.getName().startswith("version=") and fs.exists(path(p, "_SUCCESS")))


def read_map(spark: SparkSession, directory: str, version: int | None = None) -> DataFrame:
    """A version of the map, or the newest one."""
    return spark.read.schema(MAP).parquet(f"{directory}/version={version or versions(spark, directory)[-1]}")


def with_shard(light: DataFrame, table: DataFrame) -> DataFrame:
    """Adds part and shard by the map, whose size doesn't grow with the records. Slots that the map doesn't have go by their number."""
    parts = table.select("slot", "parts").distinct()
    rows = light.join(F.broadcast(parts), "slot", "left").withColumn("part", _part(F.coalesce("parts", F.lit(1)))).drop("parts")
    rows = rows.join(F.broadcast(table.select("slot", "part", "shard")), ["slot", "part"], "left")
    shards = F.broadcast(table.agg((F.coalesce(F.max("shard"), F.lit(0)) + 1).alias("_shards")))  # one row
    return rows.crossJoin(shards).withColumn("shard", F.coalesce("shard", F.pmod("slot", "_shards")).cast("int")).drop("_shards")


def place(docs: DataFrame, directory: str, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (the row's place in its shard, gapless from 0) of every row.

    The map is the newest in `directory`; where there is none, it is made for these rows and written there. Rows of a shard
    are numbered by virtual slot and id over ranges, so no shard is one task.
    """
    spark = docs.sparkSession
    light = staged(_light(docs, id_column, text, slots), "records")
    if not versions(spark, directory):
        write_map(dealt(measure(light, shards), shards), directory)
    rows = with_shard(light, read_map(spark, directory)).withColumnRenamed("slot", "virtual_slot")
    ranges = Blocks(rows, ["shard"], ["virtual_slot", "doc_id"])
    return ranges.numbered(ranges.rows, "slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot")


def write(docs: DataFrame, map_directory: str, path: str, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text", slots: int = SLOTS, file_bytes: int = 256 << 20) -> None:
    """Writes all rows with all their columns into folders shard=N, in files of about `file_bytes` of text, in slot order.

    A shard's rows go to as many tasks as it has files. The map is the newest in `map_directory`, or made for these rows.
    """
    spark = docs.sparkSession
    if not versions(spark, map_directory):
        write_map(dealt(measure(staged(_light(docs, id_column, text, slots), "records"), shards), shards), map_directory)
    table = read_map(spark, map_directory)
    total, most = table.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("shard"), F.lit(0)) + 1).first()
    files = total // most // file_bytes + 1
    taken = {"virtual_slot", "shard"}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in taken])
    light = own.select(F.struct("*").alias("record"), slot_of(id_column, slots).alias("slot"), F.monotonically_increasing_id().alias("row"))
    rows = with_shard(light, table).withColumn("file", F.pmod(F.xxhash64("slot", "row"), F.lit(files)))
    rows = rows.repartition(most * files, "shard", "file").sortWithinPartitions("shard", "slot", "row")
    rows.select("record.*", F.col("slot").alias("virtual_slot"), "shard").write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard; other folders aren't listed."""
    return spark.read.parquet(f"{path}/shard={shard}")
