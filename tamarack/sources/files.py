"""Readers of the archive's own files, each with a fixed schema, and the sinks that pair with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.speech import wav_samples

DOCUMENT = "id string, url string, title string, text string, fetchedAt timestamp, publisher string, type string, page int, image string, transcription string"
ASSET = "id:string,url:string,filename:string,mime:string,category:string,bytes:bigint,sha256:string,from:string,status:string,savedAt:timestamp"
VOICE_RATE = 24_000


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array, or of one JSON object a line; no file gives no rows."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("ignoreMissingFiles", True).json(path)


def media_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each asset of a manifest whose `files` is an object keyed by address."""
    read = spark.read.schema(f"files map<string,struct<{ASSET}>>").option("multiLine", True).json(path)
    return read.select(F.explode("files").alias("key", "asset")).select("key", "asset.*")


def crawl_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The queue, the visited addresses, the failures and the skipped ones as tables."""
    read = spark.read.schema("queue array<string>, visited array<string>, failures array<struct<url:string,error:string>>, skipped array<struct<url:string,reason:string>>").option("multiLine", True).json(path)
    return {
        "queue": read.select(F.posexplode("queue").alias("ord", "url")), "visited": read.select(F.explode("visited").alias("url")),
        "failures": read.select(F.inline("failures")), "skipped": read.select(F.inline("skipped")),
    }


def import_status(spark: SparkSession, path: str) -> DataFrame:
    """documents and updatedAt of the last import, always one row: without a file both are null."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "documents long, updatedAt timestamp"
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.range(1).select(F.lit(None).cast("long").alias("documents"), F.lit(None).cast("timestamp").alias("updatedAt"))
    return spark.read.schema(schema).option("multiLine", True).json(path)


def metered_files(spark: SparkSession, path: str, most: int = 500_000_000) -> DataFrame:
    """path, bytes, sha256 and error of stored files; those over the limit are listed with an error and never read."""
    files = spark.read.format("binaryFile").load(path)
    read = files.filter(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    large = files.filter(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit("too large").alias("error"))
    return read.unionByName(large)


def save(rows: DataFrame, path: str) -> None:
    """Replaces a table in one commit of the job."""
    rows.write.mode("overwrite").parquet(path)


def tesseract_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of a Tesseract table: level 5, not blank, with their confidence."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
    return rows.filter((F.col("level") == "5") & (F.trim("text") != "")).select("text", F.col("conf").cast("double").alias("conf"))


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """path and samples of WAV files."""
    return spark.read.format("binaryFile").load(path).select("path", wav_samples("content").alias("pcm"))


def voice_cache(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """text, rate and pcm of stored phrases: files are named by the SHA-256 of their text; odd, empty and other-rate ones are left out."""
    listed = spark.read.schema("text string, rate int").option("multiLine", True).json(manifest).filter((F.col("rate") == VOICE_RATE) & F.col("text").isNotNull())
    listed = listed.groupBy("text").agg(F.first("rate").alias("rate")).withColumn("name", F.concat(F.sha2("text", 256), F.lit(".pcm")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcm").load(folder).filter("length > 0 AND length % 2 = 0")
    return listed.join(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("pcm")), "name").drop("name")


def image_bytes(data_url: Column, most: int = 14_000_000) -> Column:
    """Content of an image data address; null if it is none or too long."""
    fits = data_url.rlike(r"^data:image/(?:png|jpeg|webp);base64,[A-Za-z0-9+/=]+$") & (F.length(data_url) <= most)
    return F.when(fits, F.try_to_binary(F.substring_index(data_url, ",", -1), F.lit("base64")))


def draft(new: Column, old_transcript: Column) -> Column:
    """The stored draft, else one made from the older form, which held the transcript only."""
    return F.coalesce(F.nullif(new, F.lit("")), F.when(old_transcript != "", F.to_json(F.struct(old_transcript.alias("transcript")))))
