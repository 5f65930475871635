"""Parts of the comparison SQL (DuckDB), written from the definitions and not from the Spark expressions."""

from ..functions.text import STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1))"


#: CTEs para, fold and chunks (doc_id, chunk_no, text, tokens); needs WITH RECURSIVE before it.
CHUNKS = rf"""
para AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps
  FROM documents),
fold AS (
  SELECT doc_id, ps, 0 AS i, '' AS buffer, []::VARCHAR[] AS done FROM para
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN length(p) > 2200 THEN CASE WHEN length(wins[-1]) < 60 THEN wins[-1] ELSE '' END
         WHEN full_ OR buffer = '' THEN p ELSE buffer || chr(10) || p END,
    list_concat(CASE WHEN full_ THEN list_append(done, buffer) ELSE done END,
                CASE WHEN length(p) > 2200 THEN list_filter(wins, lambda w: length(w) >= 60) ELSE [] END)
  FROM (SELECT *, length(buffer) + length(p) > 1500 AND length(buffer) >= 60 AS full_,
               list_transform(range(0, length(p), 1400), lambda s: substring(p, s + 1, 1600)) AS wins
        FROM (SELECT *, ps[i + 1] AS p FROM fold WHERE i < len(ps)))),
texts AS (
  SELECT doc_id, list_concat(done, CASE WHEN length(buffer) >= 60 THEN [buffer] ELSE [] END) AS cs FROM fold WHERE i = len(ps)),
chunks AS (
  SELECT doc_id, n - 1 AS chunk_no, cs[n] AS text, {terms("' ' || cs[n]")} AS tokens
  FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS n FROM texts))"""


def scored(tokens: list[str]) -> str:
    """CTEs figures and scored over chunks for one question."""
    asked = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    return rf"""
figures AS (SELECT count(*) AS n, sum(len(tokens)) / greatest(count(*), 1) AS mean FROM chunks),
asked AS (SELECT unnest({asked}) AS token),
tf AS (SELECT doc_id, chunk_no, token, len(list_filter(tokens, lambda t: t = token)) AS tf, len(tokens) AS l FROM chunks, asked WHERE list_contains(tokens, token)),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scored AS (
  SELECT doc_id, chunk_no, count(*) AS matched,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score
  FROM tf JOIN df USING (token), figures GROUP BY doc_id, chunk_no
  HAVING count(*) >= least(2, {len(tokens)}) AND score > 1)"""
