"""The boundary to models: an injected client answers rows in batches; without one every answer is empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import fixed_chunks, model_json
from .operators.checks import merge_parts


class Model(Protocol):
    def answer(self, system: str, contents: list[str]) -> list[str]:
        """One answer for each content."""


class NullModel:
    """Answers nothing: callers fall back to what they find without a model."""

    def answer(self, system: str, contents: list[str]) -> list[str]:
        return ["" for _ in contents]


def ask(rows: DataFrame, content: str, system: str, make: Callable[[], Model] = NullModel, schema: str = "evidence array<struct<sourceId:string,quote:string>>", name: str = "answer") -> DataFrame:
    """Adds the parsed answer; one client is made for each task, answers that are no JSON become null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for series in batches:
            yield pd.Series(client.answer(system, series.fillna("").tolist()), dtype=object)

    return rows.withColumn(name, F.from_json(model_json(run(content)), schema))


def ask_fields(rows: DataFrame, key: str, text: str, system: str, make: Callable[[], Model] = NullModel, size: int = 1400) -> DataFrame:
    """key, field, value: long texts are asked about piece by piece, and the pieces' answers (a JSON object) are merged in order."""
    parts = rows.select(key, F.posexplode(fixed_chunks(F.col(text))).alias("part", "piece"))
    found = ask(parts, F.col("piece"), system, make, "map<string,string>")
    return merge_parts(found.select(key, "part", F.explode("answer").alias("field", "value")), key, "field", "value", "part")
