"""Running values over blocks against a plain loop, with one key that holds a third of all rows."""

import random

from pyspark.sql import functions as F

from tamarack.operators.scan import Blocks


def test_running_values_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(None if (k := rng.choice([None, 1, 2, 3, 4, 4, 4, 5])) is None else k, rng.choice([None, *range(50)]), rng.choice([None, *range(9)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "key int, at int, value long, _block int")
    cut = Blocks(df, ["key"], [F.col("at").asc_nulls_first(), "_block"], blocks=13)
    assert cut.block != "_block" and cut.rows.select(cut.block).distinct().count() == 13
    found = cut.running(cut.rows, {"total": ("sum", F.col("value")), "parity": ("xor", F.col("value")), "most": ("max", F.col("value"))})
    found = cut.numbered(found, "place")
    facts = spark.createDataFrame([(None, "none"), (1, "one"), (4, "four")], "key int, called string")
    got = sorted(map(tuple, cut.with_facts(found, facts).select("key", "at", "value", "_block", "total", "parity", "most", "place", "called").collect()), key=repr)
    want = []
    for key in {r[0] for r in rows}:
        total = parity = most = None
        for place, (_, at, value, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))):
            if value is not None:
                total, parity, most = (total or 0) + value, (parity or 0) ^ value, max(most or 0, value)
            want.append((key, at, value, i, total, parity, most, place, {None: "none", 1: "one", 4: "four"}.get(key)))
    assert got == sorted(want, key=repr)


def test_equal_rows_and_the_empty_table(spark):
    same = spark.range(100).select(F.lit("k").alias("key"), F.lit(1).alias("at"))
    cut = Blocks(same, ["key"], ["at"], blocks=7)
    assert sorted(r["n"] for r in cut.numbered(cut.rows, "n").collect()) == list(range(100))
    cut = Blocks(same.limit(0), ["key"], ["at"])
    assert cut.numbered(cut.rows, "n").count() == 0
