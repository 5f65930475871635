"""Running values along ordered rows of a key, where one key may hold any share of all rows.

A window over the key would put all of a key's rows into one task. Here rows are dealt by ranges of (key, order) into
blocks; a value runs inside its block, and what a key brings along from earlier blocks is one row a block at most, as a
block starts in the middle of one key only. So tasks stay of a block's size, however large a key is, and the table that is
broadcast has at most as many rows as there are blocks.

Rows that are equal in key and order are told apart by a number that is written with them, so blocks can part them too. It
is the row's place in its partition, so the rows given should come from a scan or a written table, whose partitions are the
same when a lost task runs again; what comes from a shuffle is written first.
Null keys are a key of their own. An empty table gives an empty table. Column names of any kind may be in the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import fresh, written

#: How rows of a block are folded, and how a block's value continues what came before.
FOLDS = {
    "sum": (F.sum, lambda before, here: before + here),
    "xor": (F.bit_xor, lambda before, here: before.bitwiseXOR(here)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


class Blocks:
    """`rows` has the rows given, and two columns for the block and for the place among equal rows."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column], blocks: int | None = None):
        self.keys = keys
        self.block, self.tie = fresh(df.columns, "_block"), fresh(df.columns, "_tie")
        self.order = [*order, self.tie]
        dealt = df.withColumn(self.tie, F.monotonically_increasing_id())
        by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in self.order)]
        dealt = dealt.repartitionByRange(blocks, *by) if blocks else dealt.repartitionByRange(*by)
        self.rows = written(dealt.withColumn(self.block, F.spark_partition_id()), "blocks")

    def _attach(self, rows: DataFrame, table: DataFrame, on: list[str], how: str, suffix: str = "_of_key") -> tuple[DataFrame, dict[str, str]]:
        """Joins a table by columns of the same names, nulls equal; gives the new names of its other columns too."""
        taken, names = list(rows.columns), {}
        for c in table.columns:
            names[c] = fresh(taken, c + suffix)
            taken.append(names[c])
        other = table.select(*[F.col(f"`{c}`").alias(new) for c, new in names.items()])
        same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{names[c]}`")) if c != self.block else F.col(c) == F.col(names[c]) for c in on]
        joined = rows.join(F.broadcast(other) if how == "broadcast" else other, same, "left")
        return joined.drop(*[names[c] for c in on]), {c: n for c, n in names.items() if c not in on}

    def carried(self, rows: DataFrame, folds: dict[str, tuple[str, Column]]) -> DataFrame:
        """Block, keys and each fold of the key's rows in earlier blocks; only where there are such."""
        sums = rows.groupBy(self.block, *self.keys).agg(*[FOLDS[how][0](c).alias(name) for name, (how, c) in folds.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(self.block).rowsBetween(Window.unboundedPreceding, -1)
        found = sums.select(self.block, *self.keys, F.count(F.lit(1)).over(earlier).alias("_earlier"), *[FOLDS[how][0](F.col(name)).over(earlier).alias(name) for name, (how, _) in folds.items()])
        return found.filter("_earlier > 0").drop("_earlier")

    def running(self, rows: DataFrame, folds: dict[str, tuple[str, Column]]) -> DataFrame:
        """Adds the folds of all rows of the key up to each row, itself included: name -> (one of FOLDS, value).

        `rows` comes from `self.rows` and still has the keys, the order, block and tie.
        """
        here = Window.partitionBy(self.block, *self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        local = rows.withColumns({name: FOLDS[how][0](c).over(here) for name, (how, c) in folds.items()})
        joined, names = self._attach(local, self.carried(rows, folds), [self.block, *self.keys], "broadcast")  # at most a row for each block
        whole = {}
        for name, (how, _) in folds.items():
            before, own = F.col(names[name]), F.col(name)
            whole[name] = F.when(before.isNull(), own).when(own.isNull(), before).otherwise(FOLDS[how][1](before, own))
        return joined.withColumns(whole).drop(*names.values())

    def numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds each row's place in its key, from 0."""
        found = self.running(rows, {name: ("sum", F.lit(1).cast("long"))})
        return found.withColumn(name, F.col(name) - 1)

    def with_facts(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Adds what a table says of each key (one row a key, names that rows don't have).

        Facts go to (block, key) first, so a large key's rows aren't gathered in one task.
        """
        known, names = self._attach(rows.select(self.block, *self.keys).distinct(), facts, self.keys, "left")
        joined, again = self._attach(rows, known, [self.block, *self.keys], "left")
        return joined.withColumnsRenamed({again[n]: c for c, n in names.items()})
