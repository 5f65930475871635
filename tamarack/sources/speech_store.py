"""Speech stored under the hash of its text: one file for each text, however often and by however many tasks it is written.

A task writes a file under a name of its own attempt and moves it to <sha256(text)>.pcm unless that is there, so a file is
whole or not there at all, and the first one stays. The manifest is a table of commits: a commit lists what its write found
or stored, and `stored` is one row a text over all of them. A lost task's second attempt, or a second write of the same
rows, changes nothing.

Defined cases: null texts, other rates, and empty or odd payloads (samples have two bytes) aren't stored and come back with an
error; of texts that repeat with different payloads the smallest is kept, of a later write the one that is there; an empty table stores nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import VOICE_RATE

_SCHEMA = "text string, name string, bytes long, rate int"


def speech_error(text: Column, pcm: Column, rate: Column) -> Column:
    """null for speech that may be stored, else what is wrong."""
    size = F.coalesce(F.octet_length(pcm), F.lit(0))
    return F.when(text.isNull(), "no text").when(~rate.eqNullSafe(F.lit(VOICE_RATE)), "rate").when((size == 0) | (size % 2 == 1), "no samples")


def write(speech: DataFrame, folder: str) -> DataFrame:
    """Stores rows of text, pcm and rate; returns the rows that aren't fit, with their error."""
    from pyarrow import fs

    spark = speech.sparkSession
    checked = speech.select("text", "pcm", "rate").withColumn("error", speech_error(F.col("text"), F.col("pcm"), F.col("rate")))
    at = folder if "://" in folder else "file://" + folder

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(at)
        files.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            rows = []
            for text, pcm, rate in zip(*[batch.column(c).to_pylist() for c in ("text", "pcm", "rate")]):
                name = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() + ".pcm"
                found = files.get_file_info(f"{base}/{name}")
                if found.type == fs.FileType.NotFound:
                    own = f"{base}/_{attempt}-{uuid.uuid4().hex[:8]}"
                    with files.open_output_stream(own) as out:
                        out.write(pcm)
                    files.move(own, f"{base}/{name}")
                    found = files.get_file_info(f"{base}/{name}")
                rows.append((text, name, found.size, rate))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int32()))], ["text", "name", "bytes", "rate"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("text", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("rate", pa.int32())]))

    fit = checked.filter("error IS NULL").select("text", "pcm", F.col("rate").cast("int").alias("rate"))
    # one row a text before anything shuffles, so that two tasks don't write the same and a frequent text is no burden
    once = fit.groupBy("text").agg(F.min(F.struct("pcm", "rate")).alias("s")).select("text", "s.*")
    once.mapInArrow(store, _SCHEMA).write.parquet(f"{folder}/_manifest/c={uuid.uuid4().hex[:12]}")
    return checked.filter("error IS NOT NULL").select("text", "rate", "error")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """text, name, bytes and rate of what is stored, a row a text."""
    rows = spark.read.schema(_SCHEMA + ", c string").parquet(f"{folder}/_manifest")
    return rows.groupBy("text").agg(F.first("name").alias("name"), F.max("bytes").alias("bytes"), F.max("rate").alias("rate"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """text, rate and pcm of what is stored."""
    files_ = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcm").load(folder)
    found = files_.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("pcm"))
    return stored(spark, folder).join(found, "name").select("text", "rate", "pcm")
