"""What the operators of this subpackage share: the shared work folder, written tables, text batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The letters that are lower-cased, and the white space that separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which driver and executors share.

    Where that setting is unset in a local session, as in tests, a temporary folder of this machine is used; on a cluster
    that is an error. The folder goes when the Python driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        # with its scheme, so that Spark and the tasks' own readers mean the same store
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        _made[app] = f"{_local(base).rstrip('/')}/tamarack-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _made[app])
    return _made[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the cluster's own cleaning takes the folder
        pass


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is made there yet."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends there, and lost executors cost no rerun."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """pyarrow's file system and the path in it; works for local and for object or HDFS stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_local(uri))


def _local(uri: str) -> str:
    """Local paths in the one form that Spark and pyarrow both read."""
    path = uri.removeprefix("file:") if uri.startswith("file:") else uri
    return "file:///" + path.lstrip("/") if path.startswith("/") else uri


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A batch's texts; null counts as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most about `most` bytes of text, or one row."""
    for batch in batches:
        size = batch.column(column).nbytes
        if size <= most or batch.num_rows < 2:
            yield batch
            continue
        at, weight = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if weight and weight + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, weight = i, 0
            weight += n or 0
        yield batch.slice(at)


def with_text(df: DataFrame, text: str) -> DataFrame:
    """Null texts become empty."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, broadcast if it has at most `most` rows and joined by a shuffle beyond."""
    return F.broadcast(table) if table.count() <= most else table


def few_parts(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """Fewer partitions where about `rows` rows don't fill the shuffle's: as many as there are cores, or rows of `each`."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // each + 1))


KEY = ["_key_id", "_key_h", "_key_g"]


def row_key(id_column: str, text: str) -> list[Column]:
    """A row's id and two hashes of its text: what tells rows apart, also where ids are null or repeat."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.col(id_column).alias("_key_id"), F.xxhash64(t).alias("_key_h"), F.xxhash64(F.lit(42), t).alias("_key_g")]


def recorded(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct, `record`, beside other columns, so that no column name of the row can clash with theirs."""
    return docs.select(F.struct("*").alias("record"), *more)


def join_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Joins rows that have `record` and the KEY columns with a table that has the KEY columns and others; nulls are equal."""
    other = keys.withColumnsRenamed({k: f"_of{k}" for k in KEY})
    on = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in KEY]
    return rows.join(other, on, how).drop(*[f"_of{k}" for k in KEY])


def without(docs: DataFrame, keys: DataFrame, id_column: str, text: str) -> DataFrame:
    """The rows whose key isn't in a table of keys, with all their columns."""
    return join_keys(recorded(docs, *row_key(id_column, text)), small(keys.select(*KEY)), "left_anti").select("record.*")
