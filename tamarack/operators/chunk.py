"""Documents into searchable chunks, as one fold over a document's paragraphs inside the JVM.

Paragraphs fill a buffer up to about SOFT characters. A paragraph over HARD is cut into windows of WINDOW characters
every STEP. A buffer under LEAST is never emitted: it joins the next paragraph, is replaced by a long one, and is lost
at the document's end. No row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, terms

SOFT, HARD, WINDOW, STEP, LEAST = 1500, 2200, 1600, 1400, 60

_STATE = "struct<buffer:string,done:array<string>>"


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), strip), lambda p: p != "")


def chunk_texts(text: Column) -> Column:
    """The chunks of one document, in order."""

    def emit(done: Column, more: Column) -> Column:
        return F.concat(done, F.filter(more, lambda c: F.length(c) >= LEAST))

    def step(state: Column, p: Column) -> Column:
        full = (F.length(state["buffer"]) + F.length(p) > SOFT) & (F.length(state["buffer"]) >= LEAST)
        done = F.when(full, F.concat(state["done"], F.array(state["buffer"]))).otherwise(state["done"])
        buffer = F.when(full, F.lit("")).otherwise(state["buffer"])
        windows = F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(STEP)), lambda i: F.substring(p, i + 1, F.lit(WINDOW)))
        last = F.element_at(windows, -1)
        long = F.struct(F.when(F.length(last) < LEAST, last).otherwise("").alias("buffer"), emit(done, windows).alias("done"))
        short = F.struct(F.when(buffer == "", p).otherwise(F.concat(buffer, F.lit("\n"), p)).alias("buffer"), done.alias("done"))
        return F.when(F.length(p) > HARD, long).otherwise(short).cast(_STATE)

    start = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("done")).cast(_STATE)
    return F.aggregate(paragraphs(text), start, step, lambda s: emit(s["done"], F.array(s["buffer"])))


def chunk(docs: DataFrame, id_column: str = "doc_id", text: str = "text", title: Column | None = None) -> DataFrame:
    """doc_id, chunk_no, text and tokens (of the title and the chunk) of every chunk."""
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.lit("") if title is None else title).alias("title"), F.posexplode(chunk_texts(F.col(text))).alias("chunk_no", "text"))
    return rows.select("doc_id", "chunk_no", "text", terms(F.concat_ws(" ", "title", "text")).alias("tokens"))
