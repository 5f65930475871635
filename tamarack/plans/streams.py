"""Queries that run a stream over `events` until all of it is read, and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.framing import frames
from ..streaming.jobs import run_available, upsert_into, upserted, use_rocksdb
from ..streaming.playback import current_only, in_order, stream_frames
from ..streaming.utterances import stream_utterances
from ..tables import load
from ..workspace import new_path, shared_dir
from . import signals
from .signals import MOST, SILENCE, THRESHOLD


def source(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the source wants a folder or a pattern


def streaming_utterances(spark, d):
    """Finished utterances of the stream; those still running at its end aren't there."""
    use_rocksdb(spark)
    at = f"{shared_dir(spark)}/utterances-{uuid.uuid4().hex[:8]}"
    found = stream_utterances(source(spark, d), "user_id", ["ts", "event_id"], "value", THRESHOLD, None, SILENCE, MOST)
    run_available(found, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/b={n}"), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").filter("type = 'final'").select("user_id", "start", F.col("n").alias("end"), "frames")


def streaming_upsert(spark, d):
    at = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex[:8]}"
    rows = source(spark, d).select("event_id", "user_id", "event_type", "value")
    run_available(rows, upsert_into(spark, f"{at}/table", "user_id", "event_id"), f"{at}/checkpoint")
    return upserted(spark, f"{at}/table", rows.schema)


#: Rows of a file of a batch.
FILE_ROWS = 2_000


def in_batches(spark: SparkSession, rows: DataFrame, batch: str, n: int, at: str) -> DataFrame:
    """A stream that brings the rows of batch 0, then those of batch 1 and so on. All batches have as many files, which are read
    in the order of their writing: one for about FILE_ROWS rows of the smallest batch, so none is empty."""
    sizes = [r[0] for r in rows.groupBy(batch).count().filter(F.col(batch).between(0, n - 1)).select("count").collect()]  # a row a batch
    files = min(sizes) // FILE_ROWS if len(sizes) == n else 0
    for i in range(n):
        part = rows.filter(F.col(batch) == i).drop(batch)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.drop(batch).schema).option("maxFilesPerTrigger", max(files, 1)).parquet(at)


def played(spark: SparkSession, found: DataFrame, at: str) -> DataFrame:
    """What a stream writes until its input is read."""
    run_available(found, lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/b={n}"), f"{at}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{at}/out")


def playback_order(spark, d):
    """Turns as parts that come in three batches, some early and some never, and a fourth batch that ends every conversation."""
    use_rocksdb(spark)
    at, turns = new_path(spark, "playback"), load(spark, d, "conversations")
    batch = (F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 3).cast("int")
    parts = turns.filter("(conv_id + turn) % 7 <> 3").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("part"), F.lit(False).alias("done"), batch.alias("batch"))
    ends = turns.groupBy("conv_id").agg(F.lit(-1).cast("long").alias("seq"), F.lit("").alias("part"), F.lit(True).alias("done"), F.lit(3).alias("batch"))
    found = in_order(in_batches(spark, parts.union(ends), "batch", 4, f"{at}/in"), "conv_id", "seq", "part", "done")
    return played(spark, found, at).select("conv_id", "seq", F.md5("part").alias("digest"), "skipped")


def cancelled_results(spark, d):
    """Users' turns open epochs; assistants' turns are results, every fifth of an epoch too old."""
    use_rocksdb(spark)
    at, turns = new_path(spark, "epochs"), load(spark, d, "conversations")
    asked = F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn"))
    late = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, 1).otherwise(0)
    rows = turns.select("conv_id", "turn", (F.col("role") == "user").alias("opens"), (asked - late).alias("epoch"), F.least(F.floor(F.col("turn") / 2), F.lit(2)).cast("int").alias("batch"))
    found = current_only(in_batches(spark, rows, "batch", 3, f"{at}/in"), "conv_id", ["turn"], "opens", "epoch")
    return played(spark, found, at).select("conv_id", "turn", "current", "dropped")


SIZE = 64


def messages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("payload"))


def message_frames(spark, d):
    return frames(messages(spark, d), "conv_id", ["turn"], "payload", SIZE).select("conv_id", "n", F.md5("frame").alias("digest"))


def streaming_frames(spark, d):
    """The same frames from a stream of three batches."""
    use_rocksdb(spark)
    at = new_path(spark, "frames")
    rows = messages(spark, d).withColumn("batch", F.least(F.floor(F.col("turn") / 2), F.lit(2)).cast("int"))
    found = stream_frames(in_batches(spark, rows, "batch", 3, f"{at}/in"), "conv_id", ["turn"], "payload", SIZE)
    return played(spark, found, at).select("conv_id", "n", F.md5("frame").alias("digest"))


QUERIES = {f.__name__: f for f in (streaming_utterances, streaming_upsert, playback_order, cancelled_results, message_frames, streaming_frames)}
_FRAMES = f"""SELECT conv_id, n, md5(unhex(substring(h, n * {2 * SIZE} + 1, {2 * SIZE}))) AS digest
        FROM (SELECT conv_id, h, unnest(range(0, length(h) // {2 * SIZE})) AS n FROM (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn))) AS h FROM conversations GROUP BY conv_id))"""
ORACLE_SQL = {
    "streaming_utterances": 'SELECT user_id, start, "end", frames FROM (' + signals.ORACLE_SQL["utterance_sessions"].replace("AND (ends OR n = total)", "AND ends") + ")",
    "streaming_upsert": "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "playback_order": """SELECT conv_id, turn AS seq, md5(text) AS digest, turn - coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS skipped FROM conversations WHERE (conv_id + turn) % 7 <> 3""",
    "cancelled_results": """WITH e AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS now, CASE WHEN (conv_id + turn) % 5 = 0 THEN 1 ELSE 0 END AS late FROM conversations)
        SELECT conv_id, turn, now AS current, dropped FROM (SELECT *, count(*) FILTER (role <> 'user' AND late = 1) OVER (PARTITION BY conv_id ORDER BY turn) AS dropped FROM e) WHERE role <> 'user' AND late = 0""",
    "message_frames": _FRAMES,
    "streaming_frames": _FRAMES,
}
