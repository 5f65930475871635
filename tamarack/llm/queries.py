"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, exact_dedup, merkle, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash, token_files, toxicity, warc
from .common import new_dir, staged


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    digests = staged(exact_dedup.with_digest(docs).select("doc_id", "text_sha256"), "digests")
    return exact_dedup.annotate(digests, digests.count())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_dir(spark, "token-files")
    shards = token_files.write(documents(spark, sf_dir), directory)
    return token_files.read(shards, directory, with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = staged(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    plan = mixing.plan_mix(sized)
    taken = (F.col("size") * F.col("_mix_times")).alias("taken")
    return plan.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken, F.col("_mix_times").alias("times"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null id has no label
    machine = toxicity.train(docs, labels, ~held_out)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.dedup_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.choose(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(documents(spark, sf_dir), new_dir(spark, "slot-map"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(documents(spark, sf_dir), tampered=merkle.lower_cased_fifth())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_token_files, op4_pii, op5_mixing, op6_toxicity, op7_simhash, op8_warc, op9_quality_rules, op10_quality_classifier, op11_sharding, op12_conversation_trie, op13_merkle_manifest)}



def _sql_crc32(x: str) -> str:
    """CRC-32 of a text of ASCII letters in SQL: its polynomial, bit by bit."""
    byte = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: {byte}), 4294967295)"


def _merkle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """Level by level: up to 16 ** levels records a source and 16 ** top_levels sources."""

    def field(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"

    def tree(name: str, leaves: str, n: int) -> str:
        parts = [f"{name}0 AS ({leaves})"]
        for k in range(n):
            parts.append(f"""
        {name}{k + 1} AS (
          SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, ceil(max(n) / 16)::BIGINT AS n
          FROM {name}{k} GROUP BY g, i // 16)""")
        return ",".join(parts)

    def climb(name: str, nodes: str, first: str, n: int) -> str:
        parts = [f"{name}0 AS ({first})"]
        for k in range(n):
            sides = f"""
          SELECT c.doc_id, c.g, c.r, c.proof, c.now, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < c.i) AS l, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > c.i) AS r_, c.i, c.source, c.leaf, max(m.n) AS n
          FROM {name}{k} c JOIN {nodes}{k} m ON m.g = c.g AND m.i = c.i LEFT JOIN {nodes}{k} s ON s.g = c.g AND s.i // 16 = c.i // 16 AND s.i <> c.i
          GROUP BY ALL"""
            parts.append(f"""
        {name}{k + 1} AS (
          SELECT doc_id, g, r, proof || coalesce(l, '') || coalesce(r_, '') AS proof, CASE WHEN n = 1 THEN now ELSE sha256(coalesce(l, '') || now || coalesce(r_, '')) END AS now, i // 16 AS i, source, leaf
          FROM ({sides}))""")
        return ",".join(parts)

    fields = " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", "text"))
    lowered = " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
    changed = f"text IS NOT NULL AND coalesce({_sql_crc32('doc_id::VARCHAR')} % 5 = 0, false)"
    return f"""
        WITH base AS (
          SELECT doc_id, coalesce('=' || source, '') AS g, source, sha256({fields}) AS h, CASE WHEN {changed} THEN sha256({lowered}) ELSE sha256({fields}) END AS now FROM documents),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, now) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM base),
        {tree("s", "SELECT g, i, h, n FROM ranked", levels)},
        tops AS (SELECT '' AS g, g AS src, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM s{levels}),
        {tree("t", "SELECT g, i, h, n FROM tops", top_levels)},
        {climb("c", "s", "SELECT doc_id, g, i AS r, '' AS proof, now, i, source, h AS leaf FROM ranked", levels)},
        {climb("u", "t", f"SELECT c.doc_id, '' AS g, c.r, c.proof, c.now, o.i, c.g AS source, c.leaf FROM c{levels} c JOIN tops o ON o.src = c.g", top_levels)}
        SELECT u.doc_id, u.leaf, o.h AS subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.now AS folded_root, u.now = t.h AS verified
        FROM u{top_levels} u JOIN tops o ON o.src = u.source, t{top_levels} t"""


_TRIE_SQL = f"""
        WITH own AS (
          SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n,
                 coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % 100 AS base, {_sql_crc32("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
        turns AS (
          SELECT convs.c, o.n, o.r, o.t FROM convs JOIN own o ON o.c = convs.base AND o.n <= h
          UNION ALL SELECT convs.c, o.n, o.r, o.t FROM convs JOIN own o ON o.c = convs.c AND o.n > h),
        keyed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n) AS d, sha256(strlen(r) || ':' || r || t) AS k FROM turns),
        paths AS (
          SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, length(t) AS chars FROM keyed
          UNION ALL SELECT c, 0, '', 0 FROM convs),
        lens AS (SELECT c, max(d) AS l FROM paths GROUP BY c),
        nodes AS (
          SELECT path, min(c) AS conv_id, d AS depth, count(*) AS n_convs, any_value(chars) AS chars,
                 coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = l), '') AS ends, bool_and(d = l) AS childless
          FROM paths JOIN lens USING (c) GROUP BY path, d),
        sums AS (
          SELECT a.path, count(*) FILTER (b.childless) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved, count(*) FILTER (b.depth = a.depth + 1) AS n_children
          FROM nodes a JOIN (SELECT *, unnest(list_transform(range(0, depth + 1), lambda k: left(path, 64 * k))) AS up FROM nodes) b ON b.up = a.path GROUP BY a.path)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth::BIGINT - 1))"""

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL = {
    "op12_conversation_trie": _TRIE_SQL,
    "op13_merkle_manifest": _merkle_sql(),
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM f""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
