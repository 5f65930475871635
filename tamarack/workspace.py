"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; where that is unset in a local session, as in tests, a temporary folder.

    On a cluster without that setting it is an error: executors don't see each other's local folders. The folder goes when
    the Python driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        _own[app] = f"{base.rstrip('/')}/work-{app}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; the cluster's own cleaning takes the folder
        pass


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path, if anything is."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: lineage ends there, and lost executors cost no rerun."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
    """As `written`, with the path; the rows at the path `old`, which only these were made from, are removed, so rounds hold one state."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if old:
        remove(df.sparkSession, old)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that isn't taken, in any case of its letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
