"""The tables that queries read, and inline tables for cases that the data don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of short rows that a task takes where each row is much work.
ROWS = 5_000


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as they give work; such a table's files are too small to be split."""
    return rows.repartition(rows.count() // ROWS + 1)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: list[str]) -> str:
    """The same constant table as SQL."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, int):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"
