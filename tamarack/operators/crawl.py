"""Crawl state as tables: robots rules, frontier, upserts, logs, the queue of a mirror."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_rules(lines: DataFrame, order: str = "n", text: str = "line", site: str = "site") -> DataFrame:
    """site, rule: Disallow prefixes that apply to every agent. The last User-agent line before a rule decides."""
    key = F.lower(F.trim(F.substring_index(text, ":", 1)))
    value = F.trim(F.substring_index(F.regexp_replace(F.col(text), r"^[^:]*:", ""), "#", 1))
    rows = lines.filter(F.contains(F.col(text), F.lit(":"))).select(site, order, key.alias("k"), value.alias("v"))
    agent = F.last(F.when(F.col("k") == "user-agent", F.col("v")), ignorenulls=True).over(Window.partitionBy(site).orderBy(order))
    return rows.withColumn("a", agent).filter("a = '*' AND k = 'disallow' AND v <> ''").select(site, F.col("v").alias("rule")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, path: Column, site: str = "site") -> DataFrame:
    """Addresses that no rule of their site forbids: rules are gathered into one row for each site, so sites join by equality."""
    of_site = rules.groupBy(F.col(site).alias("_site")).agg(F.collect_set("rule").alias("_rules"))
    joined = urls.join(of_site, urls[site] == F.col("_site"), "left")
    barred = F.exists(F.coalesce("_rules", F.array().cast("array<string>")), lambda r: path.startswith(r))
    return joined.filter(~barred).drop("_site", "_rules")


def frontier(found: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Addresses found and not yet visited, each once."""
    return found.select(url).distinct().join(visited.select(url).distinct(), url, "left_anti")


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the one with the largest order, and `first_order`, the place that it keeps.

    An aggregate of structs: rows are combined before they are shuffled, so a key with very many versions is no burden.
    """
    whole = F.struct(*rows.columns)
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(order)).alias("row"), F.min(order).alias("first_order"))
    return best.select("row.*", "first_order")


def log_counts(log: DataFrame, reason: str) -> DataFrame:
    return log.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


#: Downloads at a time, and the error after which nothing more is fetched.
WAYS, DISK_FULL = 4, "disk reserve"


def fetch_all(queue: DataFrame, fetch: Callable[[str], None], ways: int = WAYS) -> DataFrame:
    """url, error (null if it was stored) of each address that was tried; a task that meets a full disk tries no more.

    Fetching must bear a second try of the same address, as a lost task runs again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = False
        for pdf in batches:
            out = []
            for url in pdf["url"]:
                if full:
                    break
                error = None
                try:
                    fetch(url)
                except Exception as e:  # whatever it is, it is logged as this address's failure
                    error = str(e) or type(e).__name__
                    full = DISK_FULL in error
                out.append((url, error))
            yield pd.DataFrame(out, columns=["url", "error"])

    return queue.select("url").repartition(ways).mapInPandas(run, "url string, error string")


def settle(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds state (saved, failed, requeued, waiting) and error to the queue (ord, url); requeued ones failed too, but stay at its head.

    An address that was tried several times is saved if one try stored it.
    """
    stored = F.bool_or(F.col("error").isNull())
    done = outcomes.groupBy(F.col("url").alias("_url")).agg(F.when(~stored, F.min("error")).alias("error"))
    rows = pending.join(done, F.col("url") == F.col("_url"), "left")
    state = F.when(F.col("_url").isNull(), "waiting").when(F.col("error").isNull(), "saved").when(F.contains("error", F.lit(DISK_FULL)), "requeued").otherwise("failed")
    return rows.withColumn("state", state).drop("_url")


def queue_after(settled: DataFrame) -> DataFrame:
    """What is still to be fetched: requeued addresses first, then the waiting ones in order."""
    return settled.filter("state IN ('requeued', 'waiting')").orderBy(F.col("state") == "waiting", "ord").select("ord", "url")


def phase(pending: Column, page_index: Column, pages: Column, now: Column) -> Column:
    """Phase of a mirror: what is pending comes first, then pages are looked through for more, then it is complete."""
    return F.when(pending > 0, now).when(page_index < pages, "discover").otherwise("complete")
