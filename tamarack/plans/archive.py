"""Queries on documents: terms, chunks, search, evidence, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, index, search, segments
from ..operators.chunk import chunk, chunk_texts
from ..tables import load
from ..workspace import new_path, written
from . import sql as S

QUESTION = "What is the tion of erin and heon"
TOKENS = T.query_terms(QUESTION)
REFUSED = "ering thon ouer erst hein"
MANY = [(1, QUESTION), (2, "that with from have this"), (3, "nterti thorreou ndernt"), (4, REFUSED)]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk(docs(spark, d))


def indexed(spark: SparkSession, d: str) -> index.SearchIndex:
    """The written index of the documents, as a user asks questions of it; it is made anew when the files change."""
    return index.refreshed(spark, f"{d}/documents.parquet", lambda: chunks(spark, d))


def tokenize_terms(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.terms(F.col("text"))).alias("n_terms"), F.md5(F.array_join(T.terms(F.col("text")), " ")).alias("digest"))


def term_frequency(spark, d):
    return search.postings(indexed(spark, d).chunks).select("doc_id", "chunk_no", "token", "tf")


def document_frequency(spark, d):
    return search.document_frequency(indexed(spark, d).chunks)


def corpus_stats(spark, d):
    return search.corpus_stats(indexed(spark, d).chunks).withColumn("mean_tokens", F.round("mean_tokens", 6))


def chunk_documents(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_no", F.length("text").alias("chars"), F.md5("text").alias("digest"), F.size("tokens").alias("n_tokens"))


def chunk_ordinals(spark, d):
    n = F.size(chunk_texts(F.col("text")))
    return docs(spark, d).select("doc_id", n.alias("n_chunks"), F.when(n > 0, n - 1).alias("last_chunk_no"))


def bm25_scores(spark, d):
    return search.score(indexed(spark, d).chunks, QUESTION).select("doc_id", "chunk_no", "matched", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    return index.best(indexed(spark, d), QUESTION).select("doc_id", "chunk_no", F.round("score", 6).alias("score"))


def search_threshold(spark, d):
    return search.score(indexed(spark, d).chunks, QUESTION).groupBy("matched").agg(F.count(F.lit(1)).alias("chunks"))


def search_many(spark, d):
    table = indexed(spark, d)
    asked = spark.createDataFrame(MANY, "question_id int, text string").select("question_id", T.terms(F.col("text")).alias("tokens"))
    return search.search_many(table.postings, table.figures, asked).withColumn("score", F.round("score", 6))


def sentence_split(spark, d):
    parts = T.sentences(T.clean(F.col("text")))
    return docs(spark, d).select("doc_id", F.size(parts).alias("n_sentences"), F.array_max(F.transform(parts, F.length)).alias("longest"), F.md5(F.array_join(parts, "|")).alias("digest"))


def _sources(spark, d, question=QUESTION):
    hits = index.best(indexed(spark, d), question)
    order = Window.orderBy(F.desc(F.round("score", 9)), "doc_id", "chunk_no")  # at most eight rows
    return hits.select(F.row_number().over(order).alias("ord"), F.concat_ws(":", "doc_id", "chunk_no").alias("id"), "text")


def extract_evidence(spark, d):
    return evidence.extract_evidence(_sources(spark, d), QUESTION).select("ord", "id", "quote", "overlap")


def extract_evidence_all(spark, d):
    """The best sentence of every chunk of the corpus."""
    words = F.array(*map(F.lit, TOKENS))
    table = indexed(spark, d).chunks.filter(F.size(F.array_intersect("tokens", words)) >= min(3, -(-len(TOKENS) // 2)))  # a sentence has no terms but its chunk's
    rows = evidence.with_best_sentence(table, TOKENS).filter("best IS NOT NULL")
    return rows.select("doc_id", "chunk_no", F.col("best.quote").alias("quote"), (-F.col("best.o")).alias("overlap"))


def validate_evidence(spark, d):
    """Of the first sources, their first 1,150 characters as proposed quotes, one of them altered."""
    sources = _sources(spark, d)
    quote = F.when(F.col("ord") == 2, F.replace(F.substring("text", 1, 1150), F.lit("e"), F.lit("x"))).otherwise(F.substring("text", 1, 1150))
    return evidence.validate_evidence(sources.select("ord", F.col("id").alias("source_id"), quote.alias("quote")), sources, QUESTION)


def citation_numbers(spark, d):
    quotes = evidence.extract_evidence(_sources(spark, d), QUESTION).withColumn("doc", F.substring_index("id", ":", 1))
    return evidence.citation_numbers(quotes, F.col("doc")).select("ord", "doc", "number")


def answer_policy(spark, d):
    table, out = indexed(spark, d), None
    for i, q in enumerate([QUESTION, REFUSED, "Saya nak buat aduan"]):
        one = evidence.answer(table, q).withColumn("question", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def changed_index(spark, d):
    """The best chunks after documents have come, changed and gone from an index of nine tenths of them."""
    n, text = F.col("doc_id"), F.col("text")
    table = segments.SegmentedIndex(spark, new_path(spark, "segments"))
    table.apply(docs(spark, d).filter(n % 10 != 3).select("doc_id", "text"))
    edited = docs(spark, d).filter((n % 10 == 3) | (n % 17 == 5)).select("doc_id", F.when(n % 17 == 5, F.concat(text, F.lit(". " + QUESTION + " anew."))).otherwise(text).alias("text"))
    table.apply(edited, docs(spark, d).filter(n % 23 == 7).select("doc_id"))
    return index.best(table, QUESTION).select("doc_id", "chunk_no", F.round("score", 6).alias("score"))


def quote_containment(spark, d):
    """Benchmark passages of at least 7 words that stand in a document, after normalising both.

    Words 2 to 6 of a passage are whole words wherever it stands, so their hash is the join key; the text decides.
    """
    key = 5
    words = F.split(T.normalize(F.col("text")), " ")
    quotes = load(spark, d, "benchmark").select("item_id", T.normalize(F.col("text")).alias("q"), words.alias("w")).filter(F.size("w") >= 7)
    quotes = written(quotes.select("item_id", "q", F.xxhash64(F.array_join(F.slice("w", 2, key), " ")).alias("k")), "quotes")

    def windows(w):
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - key + 1, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, key), " "))))

    # windows go without their text; only documents that share one with a passage are read again
    rows = docs(spark, d).select("doc_id", F.split(T.normalize(F.col("text")), " ").alias("w"))
    hits = written(rows.select("doc_id", F.explode(windows(F.col("w"))).alias("k")).join(quotes.select("item_id", "k"), "k").select("doc_id", "item_id").distinct(), "shared-windows")
    texts = docs(spark, d).select("doc_id", "text").join(hits, "doc_id").join(quotes.select("item_id", "q"), "item_id")
    return texts.filter(F.contains(T.normalize(F.col("text")), "q")).select("item_id", "doc_id").distinct()


_R = "WITH RECURSIVE " + S.CHUNKS
_TOP = _R + "," + S.scored(TOKENS) + ", hits AS (SELECT doc_id, chunk_no, score FROM scored ORDER BY round(score, 9) DESC, doc_id, chunk_no LIMIT 8)"
_ASKED = "[" + ", ".join(f"'{t}'" for t in TOKENS) + "]"
_NEED = min(3, -(-len(TOKENS) // 2))
_FURNITURE = "FaLang translation system|Subcategories Koleksi Poster Maya"


def _best(source: str, keys: str) -> str:
    """CTEs cand and best over a source CTE with keys and text."""
    return rf"""
split_ AS (SELECT {keys}, {S.sentences(S.clean("text"))} AS s FROM {source}),
cand AS (SELECT {keys}, i, CASE WHEN length(s[i]) >= 75 THEN s[i] ELSE s[i] || ' ' || coalesce(s[i + 1], '') END AS quote
         FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM split_)),
measured AS (SELECT *, list_distinct({S.terms("quote")}) AS present FROM cand),
fit AS (SELECT {keys}, i, quote, len(list_filter({_ASKED}, lambda t: list_contains(present, t))) AS overlap FROM measured
        WHERE length(quote) BETWEEN 75 AND 1000 AND NOT regexp_matches(quote, '(?i){_FURNITURE}')
          AND len(list_filter(present, lambda t: NOT list_contains({_ASKED}, t))) >= 5),
best AS (SELECT {keys}, quote, overlap FROM fit WHERE overlap >= {_NEED} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY overlap DESC, i) = 1)"""


_SRC = _TOP + ", src AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS ord, doc_id || ':' || chunk_no AS id, text FROM hits JOIN chunks USING (doc_id, chunk_no))"

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, term_frequency, document_frequency, corpus_stats, chunk_documents, chunk_ordinals, bm25_scores, bm25_topk, search_threshold, search_many,
        sentence_split, extract_evidence, extract_evidence_all, validate_evidence, citation_numbers, answer_policy, changed_index, quote_containment,
    )
}


def _many() -> str:
    out = []
    for i, q in MANY:
        t = T.query_terms(q)
        cte = S.scored(t)
        for name in ("figures", "asked", "tf", "df", "scored"):
            cte = cte.replace(f"\n{name} AS", f"\n{name}{i} AS").replace(f"FROM {name} ", f"FROM {name}{i} ").replace(f", {name} ", f", {name}{i} ").replace(f"JOIN {name} ", f"JOIN {name}{i} ")
        out.append((cte, f"SELECT {i} AS question_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS rank, doc_id, chunk_no, round(score, 6) AS score FROM scored{i} QUALIFY rank <= 8"))
    return _R + "," + ",".join(c for c, _ in out) + " " + " UNION ALL ".join(s for _, s in out)


ORACLE_SQL = {
    "tokenize_terms": f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.terms('text')} AS t FROM documents)",
    "term_frequency": _R + " SELECT doc_id, chunk_no, token, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest(tokens) AS token FROM chunks) GROUP BY ALL",
    "document_frequency": _R + " SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM chunks) GROUP BY token",
    "corpus_stats": _R + " SELECT count(*) AS chunks, round(sum(len(tokens)) / count(*), 6) AS mean_tokens, count(DISTINCT doc_id) AS documents FROM chunks",
    "chunk_documents": _R + " SELECT doc_id, chunk_no, length(text) AS chars, md5(text) AS digest, len(tokens) AS n_tokens FROM chunks",
    "chunk_ordinals": _R + " SELECT doc_id, len(cs) AS n_chunks, CASE WHEN len(cs) > 0 THEN len(cs) - 1 END AS last_chunk_no FROM texts",
    "bm25_scores": _R + "," + S.scored(TOKENS) + " SELECT doc_id, chunk_no, matched, round(score, 6) AS score FROM scored",
    "bm25_topk": _TOP + " SELECT doc_id, chunk_no, round(score, 6) AS score FROM hits",
    "changed_index": _TOP.replace("FROM documents", "FROM now_").replace("WITH RECURSIVE", """WITH RECURSIVE now_ AS (
        SELECT doc_id, CASE WHEN doc_id % 17 = 5 THEN text || '. """ + QUESTION + """ anew.' ELSE text END AS text FROM documents WHERE doc_id % 23 <> 7 OR doc_id % 10 = 3 OR doc_id % 17 = 5),""", 1) + " SELECT doc_id, chunk_no, round(score, 6) AS score FROM hits",
    "search_threshold": _R + "," + S.scored(TOKENS) + " SELECT matched, count(*) AS chunks FROM scored GROUP BY matched",
    "search_many": _many(),
    "sentence_split": f"SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {S.sentences(S.clean('text'))} AS s FROM documents)",
    "extract_evidence": _SRC + "," + _best("src", "ord, id") + " SELECT ord, id, quote, overlap FROM best ORDER BY ord LIMIT 3",
    "extract_evidence_all": _R + "," + _best("chunks", "doc_id, chunk_no") + " SELECT doc_id, chunk_no, quote, overlap FROM best",
    "validate_evidence": _SRC
    + rf""", prop AS (SELECT ord, id AS source_id, text, {S.clean("CASE WHEN ord = 2 THEN replace(substring(text, 1, 1150), 'e', 'x') ELSE substring(text, 1, 1150) END")} AS quote FROM src WHERE ord <= 5),
    m AS (SELECT *, list_distinct({S.terms("quote")}) AS mine FROM prop)
    SELECT ord, source_id, quote, len(list_filter({_ASKED}, lambda t: list_contains(mine, t))) AS overlap FROM m
    WHERE length(quote) BETWEEN 45 AND 1200 AND len(mine) >= 9 AND len(list_filter(mine, lambda t: NOT list_contains({_ASKED}, t))) >= 4
      AND len(list_filter({_ASKED}, lambda t: list_contains(mine, t))) >= least(2, len({_ASKED})) AND NOT regexp_matches(quote, '(?i){_FURNITURE}')
      AND contains({S.clean("text")}, quote)""",
    "citation_numbers": _SRC + "," + _best("src", "ord, id") + ", three AS (SELECT ord, split_part(id, ':', 1) AS doc FROM best ORDER BY ord LIMIT 3) SELECT ord, doc, dense_rank() OVER (ORDER BY first) AS number FROM (SELECT *, min(ord) OVER (PARTITION BY doc) AS first FROM three)",
    "quote_containment": f"SELECT item_id, doc_id FROM (SELECT item_id, {S.normal('text')} AS q FROM benchmark) b JOIN (SELECT doc_id, {S.normal('text')} AS t FROM documents) d ON contains(t, q) WHERE len(string_split(q, ' ')) >= 7",
}
