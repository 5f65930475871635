"""BM25 search over chunks.

One question is a single pass: its term frequencies are counted inside each chunk's row, the corpus figures it needs
(number of chunks, their mean length, the chunks with each term) are one small aggregate, and the top k come from a
bounded sort. Many questions at once use a postings table that is written once and joined by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms

K1, B, LEAST_SCORE, LEAST_MATCHED = 1.2, 0.75, 1.0, 2


def term_weight(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    """BM25 weight of one term in one chunk."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def score(chunks: DataFrame, question: str) -> DataFrame:
    """Chunks with matched (distinct question terms in them) and score, those under the thresholds left out."""
    asked = query_terms(question)
    if not asked:
        return chunks.limit(0).withColumns({"matched": F.lit(0), "score": F.lit(0.0)})
    tf = [_count(word) for word in asked]
    counted = chunks.withColumns({f"_tf{i}": c for i, c in enumerate(tf)} | {"_length": F.size("tokens")})
    figures = counted.agg(F.count(F.lit(1)).alias("_n"), F.sum("_length").alias("_sum"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))))
    figures = figures.withColumn("_mean", F.col("_sum") / F.greatest(F.col("_n"), F.lit(1)))
    hits = counted.filter(" OR ".join(f"_tf{i} > 0" for i in range(len(asked)))).crossJoin(F.broadcast(figures))  # one row
    weights = [F.when(F.col(f"_tf{i}") > 0, term_weight(F.col("_n"), F.col(f"_df{i}"), F.col(f"_tf{i}"), F.col("_length"), F.col("_mean"))).otherwise(0.0) for i in range(len(asked))]
    matched = sum((F.col(f"_tf{i}") > 0).cast("int") for i in range(len(asked)))
    out = hits.withColumns({"matched": matched, "score": sum(weights)})
    return out.filter((F.col("matched") >= min(LEAST_MATCHED, len(asked))) & (F.col("score") > LEAST_SCORE)).select(*chunks.columns, "matched", "score")


def _count(word: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == word))


def search(chunks: DataFrame, question: str, k: int = 8) -> DataFrame:
    """The k best chunks; ties keep corpus order. Scores are compared to 9 places, as sums depend on their order."""
    return score(chunks, question).orderBy(F.desc(F.round("score", 9)), "doc_id", "chunk_no").limit(k)


def postings(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, token, tf, length: counted inside each chunk's row, as runs of its sorted tokens; nothing is shuffled."""
    rows = chunks.select("doc_id", "chunk_no", F.size("tokens").alias("length"), F.sort_array("tokens").alias("_sorted"))
    token = lambda i: F.get("_sorted", i)
    starts = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (token(i) != token(i - 1)))
    rows = rows.filter("length > 0").withColumn("_starts", starts)
    run = lambda s, k: F.struct(token(s).alias("token"), (F.coalesce(F.get("_starts", k + 1), F.col("length")) - s).cast("long").alias("tf"))
    rows = rows.select("doc_id", "chunk_no", "length", F.explode(F.transform("_starts", run)).alias("_run"))
    return rows.select("doc_id", "chunk_no", "_run.token", "_run.tf", "length")


def document_frequency(chunks: DataFrame) -> DataFrame:
    """token, df: chunks that have the token."""
    return chunks.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, mean_tokens, documents with a chunk."""
    mean = F.sum(F.size("tokens")) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(mean, F.lit(0.0)).alias("mean_tokens"), F.countDistinct("doc_id").alias("documents"))


def search_many(index: DataFrame, figures: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """The k best chunks of each question (question_id, tokens): postings join the questions' tokens, which are few."""
    from pyspark.sql import Window

    asked = questions.select("question_id", F.size(F.array_distinct("tokens")).alias("asked"), F.explode(F.array_distinct("tokens")).alias("token"))
    df = index.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hits = index.join(F.broadcast(asked.join(df, "token")), "token").crossJoin(F.broadcast(figures.select("chunks", "mean_tokens")))
    weight = term_weight(F.col("chunks"), F.col("df"), F.col("tf"), F.col("length"), F.col("mean_tokens"))
    scored = hits.groupBy("question_id", "doc_id", "chunk_no").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("asked").alias("asked"))
    scored = scored.filter((F.col("matched") >= F.least(F.lit(LEAST_MATCHED), F.col("asked"))) & (F.col("score") > LEAST_SCORE))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "doc_id", "chunk_no"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("question_id", "rank", "doc_id", "chunk_no", "score")
