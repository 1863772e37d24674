"""Web pages: URL identity, merging, breadth-first crawling."""

from __future__ import annotations

import urllib.robotparser
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import strip
from ..sources.html import links_udf


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment; null if it's no http(s) URL."""
    u = strip(url)
    parts = r"^(?i:(https?))://([^/?#]+)([^#]*)"
    host = F.regexp_extract(u, parts, 2)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(u, parts, 1)), F.lit("://"), F.lower(host), F.regexp_extract(u, parts, 3)))


def host(url: Column) -> Column:
    """Host with port, of a normalised URL."""
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def url_source_id(url: Column) -> Column:
    return identity.source_id(normalize_url(url))


def merge_counts(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """added, updated, unchanged of crawled records against old manifests; of
    several old rows for a URL the first (by ordinal) counts."""
    first = manifests.withColumn("n", F.row_number().over(Window.partitionBy("source_path").orderBy("ordinal"))).filter("n = 1")
    old = first.select("source_path", F.col("content_hash").alias("old_hash"), F.col("ingestion_fingerprint").alias("old_fp"), F.lit(True).alias("known"))
    met = records.join(old, "source_path", "left")
    same = F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("ingestion_fingerprint").eqNullSafe(F.col("old_fp"))
    known = F.col("known").isNotNull()
    return met.agg(F.count_if(~known).alias("added"), F.count_if(known & ~same).alias("updated"), F.count_if(known & same).alias("unchanged"))


def merge_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of pages not crawled this time, and all new rows."""
    crawled = new.select("source_path").distinct()
    return old.join(crawled, "source_path", "left_anti").unionByName(new, allowMissingColumns=True)


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Offsets of blocks in the page's text, which joins them by a blank line."""
    before = Window.partitionBy("doc_id").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return blocks.withColumn("normalized_char_start", start).withColumn("normalized_char_end", F.col("normalized_char_start") + F.length("text"))


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 10
    max_depth: int = 1
    delay_seconds: float = 1.0
    same_domain: bool = True
    respect_robots: bool = True


def crawl(pages: DataFrame, start_url: str, config: CrawlConfig = CrawlConfig(), allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Breadth first over a stored set of pages (url, html), a join per depth.

    Returns url, depth, pos (order of visit), status: fetched, missing or
    robots-disallowed. Failures use no page budget. ``allowed`` is a predicate
    of the URL; the depth and the budget bound the loop.
    """
    spark = pages.sparkSession
    stored = pages.select(normalize_url(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    start = spark.range(1).select(normalize_url(F.lit(start_url)).alias("url"), F.lit(0).cast("long").alias("at"))
    first_host = host(normalize_url(F.lit(start_url)))
    ok = allowed(F.col("url")) if allowed and config.respect_robots else F.lit(True)
    seen = None
    frontier, fetched = start, 0
    for depth in range(config.max_depth + 1):
        met = frontier.join(stored, "url", "left").withColumn("status", F.when(~ok, "robots-disallowed").when(F.col("html").isNull(), "missing").otherwise("fetched"))
        good = F.sum((F.col("status") == "fetched").cast("int")).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        # The frontier is bounded by the page budget times links a page.
        here = met.withColumn("before", F.coalesce(good, F.lit(0))).filter(F.col("before") < config.max_pages - fetched).withColumn("depth", F.lit(depth)).cache()
        fetched += here.filter("status = 'fetched'").count()
        rows = here.select("url", "depth", "at", "status")
        seen = rows if seen is None else seen.union(rows)
        if depth == config.max_depth or fetched >= config.max_pages:
            break
        out = here.filter("status = 'fetched'").select("at", F.posexplode(links_udf(F.col("html"), F.col("url"))).alias("pos", "url"))
        if config.same_domain:
            out = out.filter(host(F.col("url")) == first_host)
        order = F.row_number().over(Window.orderBy("at", "pos")).cast("long")
        frontier = out.groupBy("url").agg(F.min(F.struct("at", "pos")).alias("p")).select("url", "p.*").join(seen.select("url"), "url", "left_anti").withColumn("at", order).drop("pos")
    return seen.withColumn("pos", F.row_number().over(Window.orderBy("depth", "at"))).drop("at")


def offline_pages(spark: SparkSession, fetcher: Callable[[str], str], urls: list[str]) -> DataFrame:
    """A pages table from an injected fetcher; failures have null html and a message."""
    rows = []
    for u in urls:
        try:
            rows.append((u, fetcher(u), None))
        except Exception as e:  # noqa: BLE001  an injected fetcher may raise anything
            rows.append((u, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "url string, html string, error string")


def crawl_counts(visited: DataFrame, queued: int) -> DataFrame:
    """pages, failures, links_found of a crawl; ``queued``: links put on the queue."""
    fetched = F.col("status") == "fetched"
    seen = visited.agg(F.count_if(fetched).alias("pages"), F.count_if(~fetched).alias("failures"))
    return seen.withColumn("links_found", F.greatest(F.lit(queued) - F.col("pages") - F.col("failures"), F.lit(0)))


def with_robots(pages: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """Pages (url) with allowed and crawl_delay by the rules (host, robots) of their
    host; a host without rules allows all."""
    met = pages.withColumn("host", host(F.col("url"))).join(rules, "host", "left")
    got = robots_rule(F.col("url"), F.col("robots"), user_agent)
    return met.withColumn("rule", got).select("*", "rule.allowed", "rule.crawl_delay").drop("rule", "robots", "host")


def robots_rule(url: Column, robots: Column, user_agent: str) -> Column:
    def judge(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows, parsed = [], {}
        for u, t in zip(urls, texts, strict=True):
            if t is None:
                rows.append((True, 0.0))
                continue
            if t not in parsed:
                parsed[t] = urllib.robotparser.RobotFileParser()
                parsed[t].parse(t.splitlines())
            p = parsed[t]
            rows.append((p.can_fetch(user_agent, u), float(p.crawl_delay(user_agent) or p.crawl_delay("*") or 0)))
        return pd.DataFrame(rows, columns=["allowed", "crawl_delay"])

    judge.__annotations__ = {"urls": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(judge, "struct<allowed:boolean,crawl_delay:double>")(url, robots)
