"""Streaming jobs: pairing announcements with their frames, and resumable ingest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.crawl import upsert
from ..workspace import file_system, fresh, written


def use_rocksdb(spark: SparkSession) -> None:
    """State lives in RocksDB, so it may outgrow an executor's heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def speech_pairs(events: DataFrame, frames: DataFrame, delay: str = "1 minute", session: str = "session_id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Each announced segment with the frame of its number: a stream-stream join, both sides forgotten after `delay`."""
    left = events.filter("type = 'speech_segment'").select(session, seq, F.col(ts).alias("announced"), "text").withWatermark("announced", delay)
    right = frames.select(F.col(session).alias("_session"), F.col(seq).alias("_seq"), F.col(ts).alias("arrived"), "frame").withWatermark("arrived", delay)
    near = (F.col("arrived") >= F.col("announced") - F.expr(f"interval {delay}")) & (F.col("arrived") <= F.col("announced") + F.expr(f"interval {delay}"))
    return left.join(right, (F.col(session) == F.col("_session")) & (F.col(seq) == F.col("_seq")) & near).drop("_session", "_seq")


def windowed_levels(frames: DataFrame, key: str, level: str, ts: str = "ts", window: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """Root mean square level of each key and window; rows later than `late` are dropped by the watermark."""
    rows = frames.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key)
    return rows.agg(F.sqrt(F.avg(F.col(level) * F.col(level))).alias("rms"), F.count(F.lit(1)).alias("n")).select("w.start", key, "rms", "n")


def run_available(out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there and stops; called again with the same checkpoint it goes on from there."""
    query = out.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: Parts of a table by the hash of its key, and generations that stay readable.
PARTS, KEPT = 64, 2
_COMMIT = "part int, generation long"


def upsert_into(spark: SparkSession, path: str, key: str, order: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key in a table of parts, by the hash of the key.

    A batch reads the parts that its keys fall into and writes only these anew, under its own number, and then a commit that
    says which number each part has now. A batch that runs twice after a failure starts from the commit before it and
    writes the same again. Parts that the last KEPT commits don't name are removed.
    """

    def sink(batch: DataFrame, number: int) -> None:
        before = latest_generation(spark, f"{path}/commits", number)
        known = {} if before is None else _parts(spark, path, before)
        name = fresh(batch.columns, "part")
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
        rows = written(upsert(batch, key, order).drop("first_order").withColumn(name, part), "upsert-batch")
        touched = sorted(r[0] for r in rows.select(name).distinct().collect())  # at most `parts`
        old = [f"{path}/rows/g={known[p]}/{name}={p}" for p in touched if p in known]
        both = rows
        if old:
            stored = [spark.read.schema(batch.schema).parquet(at) for at in old]
            both = rows.drop(name).unionByName(reduce(DataFrame.unionByName, stored)).withColumn(name, part)
            both = upsert(both, key, order).drop("first_order")
        both.repartition(name).write.mode("overwrite").partitionBy(name).parquet(f"{path}/rows/g={number}")
        now = known | {p: number for p in touched}
        spark.createDataFrame(sorted(now.items()), _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/g={number}")
        _remove_unnamed(spark, path, name)

    return sink


def _parts(spark: SparkSession, path: str, generation: int) -> dict[int, int]:
    return {r["part"]: r["generation"] for r in spark.read.schema(_COMMIT).parquet(f"{path}/commits/g={generation}").collect()}  # a row a part


def _remove_unnamed(spark: SparkSession, path: str, name: str) -> None:
    newest = latest_generation(spark, f"{path}/commits")
    last = [newest]
    while len(last) < KEPT and (g := latest_generation(spark, f"{path}/commits", last[-1])) is not None:
        last.append(g)
    named = {(p, g) for commit in last for p, g in _parts(spark, path, commit).items()}
    fs, at = file_system(spark, f"{path}/rows")
    for generation in fs.listStatus(at):
        number = int(generation.getPath().getName()[2:])
        for status in fs.listStatus(generation.getPath()):
            found = status.getPath().getName()
            if found.startswith(f"{name}=") and (int(found[len(name) + 1 :]), number) not in named and number <= newest:
                fs.delete(status.getPath(), True)


def upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that `upsert_into` keeps, at its newest commit."""
    newest = latest_generation(spark, f"{path}/commits")
    if newest is None:
        return spark.createDataFrame([], schema)
    name = fresh([f.name for f in schema], "part")
    return spark.read.schema(schema).parquet(*[f"{path}/rows/g={g}/{name}={p}" for p, g in _parts(spark, path, newest).items()])


def latest_generation(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The newest finished generation, or the newest below a number."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("g=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return max((g for g in found if below is None or g < below), default=None)
