"""The media manifest: duplicates, catalog pages, status figures, links to local copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import bare_url, local_link


def dedupe(manifest: DataFrame, order: str = "ord") -> DataFrame:
    """Every manifest row with canonical, action and result_url.

    The first row of a canonical address wins ("keep"). A later one with the winner's digest is a copy: its file is
    removed ("remove"), or, if it is the same file, only its row goes ("drop"). One with another digest stays under its own address ("keep_own").
    """
    key = bare_url(F.col("url"))
    # the winner's fields come from an aggregate; a join brings them back, which a hot address can be split for
    first = manifest.groupBy(key.alias("_key")).agg(F.min_by(F.struct("sha256", "filename", order), F.col(order)).alias("_win"))
    rows = manifest.withColumn("canonical", key).join(first, F.col("canonical").eqNullSafe(F.col("_key")))
    own = F.col(order) == F.col(f"_win.{order}")
    same = F.col("sha256").eqNullSafe(F.col("_win.sha256"))
    action = F.when(own, "keep").when(same & (F.col("filename") != F.col("_win.filename")), "remove").when(same, "drop").otherwise("keep_own")
    url = F.when(own, F.col("canonical")).when(~same, F.col("url"))
    return rows.withColumns({"action": action, "result_url": url}).drop("_key", "_win")


def last_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row of each key, with first_order, where the key first stood."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(whole, F.col(order)).alias("row"), F.min(order).alias("first_order")).select("row.*", "first_order")


def content_duplicates(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """Rows with digest, copies and first (the smallest order with that content), by a two-step count that spreads frequent contents."""
    salts = 32
    marked = rows.withColumn("digest", F.sha2(content, 256)).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = marked.groupBy("digest", "_salt").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("m"))
    whole = part.groupBy(F.col("digest").alias("_d")).agg(F.sum("n").alias("copies"), F.min("m").alias("first"))
    spread = part.select("digest", "_salt").join(whole, F.col("digest") == F.col("_d")).drop("_d")
    return marked.join(spread, ["digest", "_salt"]).drop("_salt")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a listing with `total`, the rows of all pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def saved(manifest: DataFrame, category: str | None = None) -> DataFrame:
    """Assets that are stored, of one category where it is given."""
    rows = manifest.filter("status = 'saved'")
    return rows.filter(F.col("category") == category) if category else rows


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none; where keys repeat, the smallest row by its columns in order."""
    one = rows.filter(F.col(key) == F.lit(value)).agg(F.min(F.struct(*rows.columns)).alias("row"))
    return one.filter("row IS NOT NULL").select("row.*")


def with_local_links(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds local_url: the document's own page, or the stored file of a PDF page, null while it isn't stored."""
    saved = manifest.filter("status = 'saved'").select(F.col("url").alias("_url"), F.col("id").alias("_asset"))
    saved = saved.groupBy("_url").agg(F.min("_asset").alias("_asset"))
    joined = hits.join(saved, (F.col("url") == F.col("_url")) & (F.col("type") == "pdf"), "left")
    return joined.withColumn("local_url", local_link(F.col("id"), F.col("type"), F.col("_asset"), F.col("page"))).drop("_url", "_asset")


def byte_bounded_cache(items: DataFrame, order: str, key: str, size: str, most: int, group: Window | None = None) -> DataFrame:
    """First-in first-out cache after all insertions: each key counts once, at its first place; the newest that fit stay.

    Equal to evicting one by one as long as no evicted key comes again.
    """
    by = [] if group is None else [group]
    first = items.groupBy(*by, key).agg(F.min_by(F.struct(order, size), F.col(order)).alias("f")).select(*by, key, f"f.{order}", f"f.{size}")
    newest = Window.partitionBy(*by).orderBy(F.desc(order)) if by else Window.orderBy(F.desc(order))
    return first.withColumn("held", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("held") <= most)
