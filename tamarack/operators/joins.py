"""Joins of rows with what is known of their key, where one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import fresh

MOST, SALTS = 100_000, 16


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of a written table that has one row a key; null keys are equal.

    The table is broadcast while it has at most MOST rows. Beyond that rows meet it by (key, salt), the salt from the columns
    `spread_by`, so a key's rows go to SALTS tasks; the hint keeps Spark from a broadcast because its compressed files are small.
    """
    names = {c: fresh([*rows.columns, *facts.columns], f"{c}_of_key") for c in keys}
    table = facts.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    if facts.count() <= MOST:
        return rows.join(F.broadcast(table), same, how).drop(*names.values())
    salt, other = fresh([*rows.columns, *table.columns], "salt"), fresh([*rows.columns, *table.columns], "salt_of_key")
    salted = table.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), [*same, F.col(salt) == F.col(other)], how).drop(salt, other, *names.values())
