"""Queries on pages and manifests: addresses, page fields, crawl state, media catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import crawl, media
from ..operators.chunk import chunk_texts
from ..sources import pages as P
from ..tables import inline, load, sql_values
from . import sql as S

KEYS = ("page", "id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages")


def canonical_page_url(spark, d):
    url = F.col("url")
    return pages(spark, d).select("page_id", U.page_url(url, KEYS).alias("canonical"), U.is_page(url, U.origin(url), "/en").alias("is_page"))


#: What pages' addresses are followed by, in turn, to name files and queries.
ENDINGS = ["/a/b.PDF?x=1#p2", "/list?page=2#top", "/img/x.jpeg?size=3", "/media/a%20b+c.mp3", "/ms/a?view=x&tmpl=y", "/x.webm?d#e", "", "#part"]


def files(spark, d):
    """Addresses of pages with endings; some are none."""
    n = F.col("page_id")
    url = F.when(n % 13 == 6, "not an address").otherwise(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, ENDINGS)), (n % len(ENDINGS) + 1).cast("int"))))
    return pages(spark, d).select(n.alias("n"), url.alias("url"))


def canonical_media_url(spark, d):
    rows = files(spark, d)
    ext = U.extension(F.col("url"), F.lit("image/png"))
    return rows.select("n", U.media_url(F.col("url")).alias("media_url"), U.bare_url(F.col("url")).alias("bare_url"), U.last_segment(F.col("url")).alias("name"), ext.alias("ext"), U.category(ext).alias("category"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """A media manifest made from the pages: their address, digest and a file name."""
    url = F.col("url")
    sha = F.sha2("html", 256)
    ext = U.extension(url, F.lit("text/html"))
    status = F.when(F.col("page_id") % 7 == 0, "failed").otherwise("saved")
    return pages(spark, d).select(F.col("page_id").alias("ord"), url, sha.alias("sha256"), U.asset_id(url).alias("id"), F.concat(U.asset_id(url), ext).alias("filename"), F.octet_length("html").cast("long").alias("bytes"), U.category(ext).alias("category"), status.alias("status"))


def url_dedupe(spark, d):
    return media.dedupe(manifest(spark, d)).select("ord", "canonical", "action", "result_url")


def stable_ids(spark, d):
    return pages(spark, d).select("page_id", U.document_id(F.col("url"), F.col("page_id") % 3).alias("document_id"), U.asset_id(F.col("url")).alias("asset_id"), U.last_segment(F.col("url")).alias("name"))


def page_title(spark, d):
    return pages(spark, d).select("page_id", P.title(F.col("html")).alias("title"))


def page_links(spark, d):
    return P.links(pages(spark, d)).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def media_links(spark, d):
    return pages(spark, d).select("page_id", F.explode(F.array_distinct(P.media_references(F.col("html")))).alias("value"))


def frontier_antijoin(spark, d):
    found = P.links(pages(spark, d)).select(U.page_url(F.col("link"), KEYS).alias("url"))
    visited = pages(spark, d).select(U.page_url(F.col("url"), KEYS).alias("url"))
    return crawl.frontier(found, visited)


ROBOTS = [
    ("User-agent: other", 1), ("Disallow: /en/5", 2), ("User-agent: *", 3), ("Disallow: /de  # all of it", 4), ("Disallow:", 5), ("Disallow: /en/1", 6), ("Allow: /x", 7), ("User-Agent: last", 8), ("Disallow: /", 9),
]


def robots_filter(spark, d):
    lines = inline(spark, [(t, n, "all") for t, n in ROBOTS], "line string, n int, site string")
    rules = crawl.robots_rules(lines)
    urls = pages(spark, d).select("page_id", "url", F.lit("all").alias("site"))
    return crawl.allowed(urls, rules, U.path(F.col("url"))).select("page_id", "url")


def page_main_text(spark, d):
    text = P.main_text(F.col("html"))
    return pages(spark, d).select("page_id", F.length(text).alias("chars"), F.md5(T.tidy(text)).alias("digest"))


def page_main_text_parsed(spark, d):
    return pages(spark, d).select("page_id", F.length(P.main_text_parsed("html")).alias("chars"))


def content_hash_dedupe(spark, d):
    return media.content_duplicates(load(spark, d, "documents"), F.col("text"), "doc_id").select("doc_id", "digest", "copies", "first", (F.col("doc_id") == F.col("first")).alias("kept"))


def upsert_latest(spark, d):
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return crawl.upsert(rows, "user_id", "event_id")


def lastwins_dedupe(spark, d):
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return media.last_wins(rows, ["user_id", "event_type"], "event_id")


def set_union_seen(spark, d):
    a = pages(spark, d).filter("page_id % 2 = 0").select(U.bare_url(F.col("url")).alias("url"))
    b = P.links(pages(spark, d)).select(U.bare_url(F.col("link")).alias("url"))
    return a.union(b).distinct()


def media_catalog_page(spark, d):
    rows = manifest(spark, d).filter("status = 'saved'")
    found = media.page(rows, [F.col("ord")], 2, 24)
    return found.select("id", "bytes", "category", U.last_segment(F.col("url")).alias("name"), F.concat(F.lit("/api/archive/media/"), "id").alias("local_url"), "total")


def document_list_page(spark, d):
    rows = load(spark, d, "documents")
    return media.page(rows, [F.col("doc_id")], 3, 12).select("doc_id", F.substring("text", 1, 320).alias("text"), "total")


def archive_status(spark, d):
    n = F.col("n_chunks")  # counted in the documents' rows: a status writes no index
    sizes = load(spark, d, "documents").select("source", F.size(chunk_texts(F.col("text"))).alias("n_chunks"))
    docs = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(n.cast("long")).alias("n_chunks"))
    docs = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("chunks"), F.count("source").alias("sources"))
    files = manifest(spark, d).agg(F.count_if(F.col("status") == "saved").alias("media_saved"), F.count_if(F.col("status") != "saved").alias("media_pending"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("media_pages"))
    return docs.crossJoin(F.broadcast(files)).select("documents", "sources", *files.columns, "chunks")  # one row each


def failure_log_counts(spark, d):
    return crawl.log_counts(manifest(spark, d), "status").withColumnRenamed("status", "reason")


def local_source_join(spark, d):
    hits = pages(spark, d).select(F.col("page_id").cast("string").alias("id"), "url", F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("web").alias("type"), (F.col("page_id") % 3).alias("page"))
    return media.with_local_links(hits, manifest(spark, d)).select("id", "local_url")


MIMES = ["text/html", "image/svg+xml", "application/pdf", "image/png", "application/javascript", None]


def mime_safety(spark, d):
    """How files of pages would be served, by a type in turn; the name of every fifth isn't one of ours."""
    n = F.col("page_id")
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (n % len(MIMES) + 1).cast("int"))
    name = F.concat(F.when(n % 5 == 0, "../x").otherwise(U.asset_id(F.col("url"))), F.lit(".pdf"))
    return pages(spark, d).select("page_id", mime.alias("mime"), name.alias("name")).select("page_id", "mime", U.disposition(F.col("mime")).alias("serve"), U.safe_filename(F.col("name")).alias("safe"))


def queryable_documents(spark, d):
    """Documents that may be searched: no category pages, no pages of furniture only.

    The given pages have neither, so furniture is added to two fifths of them, before a short or the whole text, and a ninth gets a category's address.
    """
    n, text, furniture = F.col("page_id"), P.main_text(F.col("html")), "FaLang translation system by Faboba "
    text = F.when(n % 5 == 0, F.concat(F.lit(furniture), F.substring(text, 1, 100))).when(n % 5 == 1, F.concat(F.lit(furniture), text)).otherwise(text)
    url = F.when(n % 9 == 4, F.concat("url", F.lit("?view=category"))).otherwise(F.col("url"))
    rows = pages(spark, d).select("page_id", url.alias("url"), text.alias("text"))
    left = F.length(F.trim(F.regexp_replace("text", "(?i)FaLang translation system by Faboba", "")))
    bare = F.col("text").rlike("(?i)FaLang translation system by Faboba") & (left < 120)
    return rows.filter(~F.col("url").rlike(r"(?i)[?&]view=category|/component/osmap/") & ~bare).select("page_id", "url")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_page_url, canonical_media_url, url_dedupe, stable_ids, page_title, page_links, media_links, frontier_antijoin, robots_filter, page_main_text, page_main_text_parsed,
        content_hash_dedupe, upsert_latest, lastwins_dedupe, set_union_seen, media_catalog_page, document_list_page, archive_status, failure_log_counts, local_source_join, mime_safety, queryable_documents,
    )
}

_P = r"'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(\?[^#]*)?'"


def _origin(u):
    return f"lower(regexp_extract({u}, {_P}, 1))"


def _path(u):
    return f"(CASE WHEN regexp_extract({u}, {_P}, 2) = '' THEN '/' ELSE regexp_extract({u}, {_P}, 2) END)"


def _is(u):
    return f"regexp_matches({u}, {_P})"


def _bare(u):
    return f"CASE WHEN {_is(u)} THEN {_origin(u)} || {_path(u)} END"


def _page(u):
    kept = f"list_filter(string_split(substring(regexp_extract({u}, {_P}, 3), 2), '&'), lambda p: split_part(p, '=', 1) IN ('page', 'id'))"
    return f"CASE WHEN {_is(u)} THEN {_origin(u)} || {_path(u)} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


def _name(u):
    return f"url_decode(replace(string_split({_path(u)}, '/')[-1], '+', '%2B'))"


_MEDIA = r"'(?i)\.(?:pdf|epub|mobi|azw3?|djvu|jpe?g|png|webp|gif|tiff?|bmp|svg|docx?|xlsx?|pptx?|zip|rar|7z|mp3|mp4|m4a|wav|ogg|webm)$'"


def _unescape(x):
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{mark}')"
    return x


_HREFS = f"""links AS (
  SELECT page_id, url, {_unescape("h")} AS h FROM (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '<a\\s(?:[^>]*?\\s)?href="([^"]*)"', 1, 'is'))) AS h FROM pages)),
abs AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || h WHEN starts_with(h, '/') THEN {_origin("url")} || h
    WHEN starts_with(h, '?') OR starts_with(h, '#') THEN {_origin("url")} || {_path("url")} || h
    ELSE {_origin("url")} || regexp_replace({_path("url")}, '[^/]*$', '') || h END AS link FROM links)"""


def _ext(u, mime_ext):
    own = f"lower(regexp_extract({_path(u)}, '(\\.[^./]+)$', 1))"
    return f"coalesce(nullif({own}, ''), {mime_ext})"


def _category(e):
    return f"CASE WHEN regexp_matches({e}, 'pdf|epub|mobi|azw|djvu') THEN 'ebook / dokumen' WHEN regexp_matches({e}, 'jpg|jpeg|png|webp|gif|tif|bmp|svg') THEN 'imej' WHEN regexp_matches({e}, 'mp3|m4a|wav|ogg') THEN 'audio' WHEN regexp_matches({e}, 'mp4|webm') THEN 'video' ELSE 'fail' END"


_MANIFEST = f"""manifest AS (SELECT page_id AS ord, url, sha256(html) AS sha256, sha256(url)[1:24] AS id, sha256(url)[1:24] || {_ext("url", "'.bin'")} AS filename,
  strlen(html) AS bytes, {_category(_ext("url", "'.bin'"))} AS category, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'saved' END AS status FROM pages)"""


def _text():
    x = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for tag in P.DROPPED:
        x = f"regexp_replace({x}, '<{tag}(?:\\s[^>]*)?>.*?</{tag}>', '', 'gis')"
    x = f"regexp_replace({x}, '<head(?:\\s[^>]*)?>.*?</head>', '', 'gis')"
    x = f"regexp_replace({x}, '</(?:{'|'.join(P.BLOCKS)})>|<br\\s*/?>', chr(10), 'gi')"
    x = _unescape(f"regexp_replace({x}, '<[^>]*>', '', 'gs')")
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _inner(tag):
    inner = f"regexp_replace(regexp_extract(html, '<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1, 'is'), '<[^>]*>', '', 'g')"
    return S.clean(_unescape(inner))


_FILES = f"""(SELECT page_id AS n, CASE WHEN page_id % 13 = 6 THEN 'not an address' ELSE regexp_replace(url, '[?#].*$', '') || {ENDINGS}[page_id % {len(ENDINGS)} + 1] END AS url FROM pages) AS v"""


def _references() -> str:
    """Every value that may name a file, with its page."""
    parts = [rf"""SELECT page_id, unnest(regexp_extract_all(html, '<(?:a|img|source|video|audio|iframe|object)\s(?:[^>]*?\s)?{name}="([^"]*)"', 1, 'is')) AS h FROM pages""" for name in P.ATTRIBUTES]
    sets = r"""SELECT page_id, regexp_extract(trim(e), '^(\S*)', 1) FROM (SELECT page_id, unnest(string_split(s, ',')) AS e FROM (SELECT page_id, unnest(regexp_extract_all(html, '\s(?:data-)?srcset="([^"]*)"', 1, 'is')) AS s FROM pages))"""
    image = r"""SELECT page_id, unnest(regexp_extract_all(html, '<meta\s[^>]*property="og:image"[^>]*content="([^"]*)"', 1, 'is')) FROM pages"""
    return " UNION ALL ".join([*parts, sets, image])


ORACLE_SQL = {
    "canonical_page_url": rf"""SELECT page_id, {_page("url")} AS canonical,
        (starts_with({_path("url")}, '/en') OR regexp_matches({_path("url")}, '(?i)\.pdf$')) AND NOT regexp_matches(url, '(?i)/search|/carian|/login|/logout|/warga-arkib|format=|tmpl=|task=')
        AND NOT regexp_matches({_path("url")}, '(?i)\.(?:jpg|jpeg|png|zip|docx?|xlsx?|pptx?|mp[34]|css|js)$') AS is_page FROM pages""",
    "canonical_media_url": f"""SELECT n, CASE WHEN {_is("url")} THEN {_origin("url")} || {_path("url")} || CASE WHEN regexp_matches({_path("url")}, {_MEDIA}) THEN '' ELSE regexp_extract(url, {_P}, 3) END END AS media_url,
        {_bare("url")} AS bare_url, {_name("url")} AS name, {_ext("url", "'.png'")} AS ext, {_category(_ext("url", "'.png'"))} AS category FROM {_FILES}""",
    "url_dedupe": f"""WITH {_MANIFEST}, m AS (SELECT *, {_bare("url")} AS canonical FROM manifest),
        w AS (SELECT *, first_value(ord) OVER x AS wo, first_value(sha256) OVER x AS ws, first_value(filename) OVER x AS wf FROM m WINDOW x AS (PARTITION BY canonical ORDER BY ord))
        SELECT ord, canonical, CASE WHEN ord = wo THEN 'keep' WHEN sha256 = ws AND filename <> wf THEN 'remove' WHEN sha256 = ws THEN 'drop' ELSE 'keep_own' END AS action,
        CASE WHEN ord = wo THEN canonical WHEN sha256 <> ws THEN url END AS result_url FROM w""",
    "stable_ids": f"SELECT page_id, sha256(url || CAST(page_id % 3 AS VARCHAR))[1:16] AS document_id, sha256(url)[1:24] AS asset_id, {_name('url')} AS name FROM pages",
    "page_title": f"SELECT page_id, coalesce(nullif({_inner('h1')}, ''), {_inner('title')}) AS title FROM pages",
    "page_links": f"WITH {_HREFS} SELECT page_id, link, count(*) AS n FROM abs WHERE link IS NOT NULL GROUP BY ALL",
    "media_links": f"SELECT DISTINCT page_id, {_unescape('h')} AS value FROM ({_references()}) WHERE {_unescape('h')} <> ''",
    "frontier_antijoin": f"WITH {_HREFS} SELECT DISTINCT {_page('link')} AS url FROM abs WHERE link IS NOT NULL EXCEPT SELECT {_page('url')} FROM pages",
    "robots_filter": f"SELECT page_id, url FROM pages WHERE NOT starts_with({_path('url')}, '/de') AND NOT starts_with({_path('url')}, '/en/1')",
    "page_main_text": f"SELECT page_id, length(t) AS chars, md5(regexp_replace(regexp_replace(regexp_replace(t, '[\\t ]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM (SELECT page_id, {_text()} AS t FROM pages)",
    "content_hash_dedupe": "SELECT doc_id, sha256(text) AS digest, count(*) OVER w AS copies, min(doc_id) OVER w AS first, doc_id = min(doc_id) OVER w AS kept FROM documents WINDOW w AS (PARTITION BY text)",
    "upsert_latest": "SELECT event_id, user_id, event_type, value, first_order FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_order FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "lastwins_dedupe": "SELECT event_id, user_id, event_type, value, first_order FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_order FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "set_union_seen": f"WITH {_HREFS} SELECT {_bare('url')} AS url FROM pages WHERE page_id % 2 = 0 UNION SELECT {_bare('link')} FROM abs WHERE link IS NOT NULL",
    "media_catalog_page": f"WITH {_MANIFEST}, s AS (SELECT *, count(*) OVER () AS total FROM manifest WHERE status = 'saved') SELECT id, bytes, category, {_name('url')} AS name, '/api/archive/media/' || id AS local_url, total FROM s ORDER BY ord LIMIT 24 OFFSET 24",
    "document_list_page": "SELECT doc_id, substring(text, 1, 320) AS text, count(*) OVER () AS total FROM documents ORDER BY doc_id LIMIT 12 OFFSET 24",
    "archive_status": f"WITH RECURSIVE {S.CHUNKS}, {_MANIFEST} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, count(*) AS media_pages, (SELECT count(DISTINCT source) FROM documents) AS sources, count(*) FILTER (status = 'saved') AS media_saved, count(*) FILTER (status <> 'saved') AS media_pending, sum(bytes) AS bytes FROM manifest",
    "failure_log_counts": f"WITH {_MANIFEST} SELECT status AS reason, count(*) AS n FROM manifest GROUP BY status",
    "local_source_join": f"""WITH {_MANIFEST}, saved AS (SELECT url, min(id) AS asset FROM manifest WHERE status = 'saved' GROUP BY url)
        SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 2 <> 0 THEN '/api/archive/document/' || page_id WHEN asset IS NOT NULL THEN '/api/archive/media/' || asset || CASE WHEN page_id % 3 <> 0 THEN '#page=' || (page_id % 3) ELSE '' END END AS local_url
        FROM pages LEFT JOIN saved USING (url)""",
    "mime_safety": f"SELECT page_id, mime, CASE WHEN regexp_matches(mime, 'html|svg|xml|javascript') THEN 'sandbox' WHEN mime = 'application/pdf' THEN 'attachment' ELSE 'inline' END AS serve, page_id % 5 <> 0 AS safe FROM (SELECT page_id, {[m or 'none' for m in MIMES]}[page_id % {len(MIMES)} + 1] AS mime FROM pages)".replace("page_id, mime,", "page_id, nullif(mime, 'none') AS mime,"),
    "queryable_documents": f"""WITH t AS (SELECT page_id, url, {_text()} AS body FROM pages),
        p AS (SELECT page_id, url || CASE WHEN page_id % 9 = 4 THEN '?view=category' ELSE '' END AS url, CASE WHEN page_id % 5 < 2 THEN 'FaLang translation system by Faboba ' ELSE '' END AS head,
          CASE WHEN page_id % 5 = 0 THEN substring(body, 1, 100) ELSE body END AS body FROM t)
        SELECT page_id, url FROM p WHERE NOT regexp_matches(url, '(?i)[?&]view=category|/component/osmap/') AND NOT (head <> '' AND length(trim(body)) < 120)""",
}
