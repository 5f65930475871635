"""A written search index: chunks in document order, postings in token order, figures of the corpus.

A question reads the postings of its own tokens only: they are sorted by token over ranges, so Parquet's statistics leave the
rest unread. They are written when they are first asked for: what needs the chunks or the figures only doesn't wait for them. Scores are summed by chunk, and the k best chunks' texts are then fetched by their document ids, which the
statistics of the chunk table narrow down in the same way. `refreshed` writes a new index when the source files have
changed (names, sizes, times), and removes the one before.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..workspace import file_system, shared_dir
from .search import LEAST_MATCHED, LEAST_SCORE, corpus_stats, postings, term_weight

#: Tokens of a range of postings, and how index files are compressed.
RANGE, CODEC = 1_500_000, "zstd"


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _has(self, name: str) -> bool:
        fs, at = file_system(self.spark, f"{self.path}/{name}/_SUCCESS")
        return fs.exists(at)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", "doc_id long, chunk_no int, text string, tokens array<string>")

    @property
    def postings(self) -> DataFrame:
        if not self._has("postings"):
            tokens = self.figures.select(F.col("chunks") * F.col("mean_tokens")).first()[0]
            write_sorted(postings(self.chunks), tokens, f"{self.path}/postings")
        return self._table("postings", "doc_id long, chunk_no int, token string, tf long, length int")

    @property
    def figures(self) -> DataFrame:
        return self._table("figures", "chunks long, mean_tokens double, documents long")


def write_sorted(rows: DataFrame, tokens: float, path: str) -> None:
    """Writes postings in token order over ranges of at most some RANGE tokens, so a task's sort has one size however large the corpus is."""
    # the document as a second key: a token of very many chunks spreads over several files
    ranges = rows.select("doc_id", "chunk_no", "token", "tf", "length").repartitionByRange(int(tokens // RANGE) + 1, "token", "doc_id")
    ranges.sortWithinPartitions("token", "doc_id", "chunk_no").write.mode("overwrite").option("compression", CODEC).parquet(path)


def write(chunks: DataFrame, path: str) -> SearchIndex:
    """Writes the index of a chunk table (doc_id, chunk_no, text, tokens), but for its postings."""
    spark = chunks.sparkSession
    index = SearchIndex(spark, path)
    chunks.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("int"), "text", "tokens").write.option("compression", CODEC).parquet(f"{path}/chunks")
    corpus_stats(index.chunks).coalesce(1).write.parquet(f"{path}/figures")  # one row
    return index


def best(index, question: str, k: int = 8) -> DataFrame:
    """The k best chunks of a written or a segmented index with matched and score; ties keep corpus order. The k keys come to
    the driver, to fetch their texts."""
    asked = query_terms(question)
    found = []
    if asked:
        rows = index.postings.filter(F.col("token").isin(asked))
        df = F.broadcast(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")))  # a row for each token of the question
        hits = rows.join(df, "token").crossJoin(F.broadcast(index.figures.select("chunks", "mean_tokens")))  # one row
        weight = term_weight(F.col("chunks"), F.col("df"), F.col("tf"), F.col("length"), F.col("mean_tokens"))
        scored = hits.groupBy("doc_id", "chunk_no").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).cast("int").alias("matched"))
        scored = scored.filter((F.col("matched") >= min(LEAST_MATCHED, len(asked))) & (F.col("score") > LEAST_SCORE))
        found = scored.orderBy(F.desc(F.round("score", 9)), "doc_id", "chunk_no").limit(k).select("doc_id", "chunk_no", "matched", "score").collect()
    keys = index.spark.createDataFrame(found, "doc_id long, chunk_no int, matched int, score double")
    texts = index.chunks.filter(F.col("doc_id").isin([r["doc_id"] for r in found])) if found else index.chunks.limit(0)
    rows = texts.join(F.broadcast(keys), ["doc_id", "chunk_no"])
    return rows.orderBy(F.desc(F.round("score", 9)), "doc_id", "chunk_no").limit(k)


_known: dict[tuple[str, str], tuple[list, SearchIndex]] = {}


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of the files at a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)


def refreshed(spark: SparkSession, source: str, chunks) -> SearchIndex:
    """The index of a source path in this application's shared folder; `chunks()` is called where it is new or has changed."""
    key, files = (spark.sparkContext.applicationId, source), _files(spark, source)
    if key not in _known or _known[key][0] != files:
        old = _known.get(key)
        _known[key] = files, write(chunks(), f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}")
        if old:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old[1].path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return _known[key][1]
