"""Crawls of many sites at once, breadth first and polite, in executors.

A site is a start page's. Each step takes the next pages of every site's frontier, as many as its
budget still allows, and visits them by host: one task has all of a host's pages in turn and waits
between them for the larger of the crawl's delay and the host's own. What was visited is
written before links are followed, so a lost executor repeats the pages of its hosts in one step at most. A page's place in
breadth-first order is the path of link numbers that first led to it, so no order needs a global
window; windows are by site (budget times links of a page) and by host.

Defined cases: failures and pages that robots rules forbid use no budget; a page that several links of a
site lead to belongs to the first; two starts of one site are two crawls; a URL that is none fails at once; no starts
give no rows; a host whose robots file can't be had allows all.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.html import links_udf
from .web import CrawlConfig, host, normalize_url, with_robots

#: What a visit gives: status is fetched, failed or robots-disallowed.
VISIT = "site string, url string, key array<long>, host string, wait double, status string, html string, final_url string, error string"
#: Hosts that one task visits in a step, one after the other.
HOSTS_A_TASK = 8


def live(fetch: Callable[[str], object], sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """Visits by a client: ``fetch`` takes a URL and gives an object with text and final_url, or raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                row = {c.split()[0]: r.get(c.split()[0]) for c in VISIT.split(", ")} | {"html": None, "final_url": None, "error": None}
                if r["allowed"]:
                    sleep(r["wait"])
                    try:
                        page = fetch(r["url"])
                        row |= {"status": "fetched", "html": page.text, "final_url": page.final_url}
                    except Exception as e:  # noqa: BLE001  a client may fail in any way
                        row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
                else:
                    row |= {"status": "robots-disallowed"}
                yield pd.DataFrame([row])

    def visit(todo: DataFrame) -> DataFrame:
        hosts = todo.select(F.count_distinct("host")).first()[0]
        return todo.repartition(max(1, -(-hosts // HOSTS_A_TASK)), "host").sortWithinPartitions("host", "key").mapInPandas(run, VISIT)

    return visit


def live_robots(fetch: Callable[[str], object]) -> Callable[[DataFrame], DataFrame]:
    """robots.txt of hosts (origin, host): (host, robots)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for o, h in zip(f["origin"], f["host"], strict=True):
                try:
                    out.append((h, fetch(f"{o}/robots.txt").text))
                except Exception:  # noqa: BLE001
                    out.append((h, None))
            yield pd.DataFrame(out, columns=["host", "robots"])

    return lambda hosts: hosts.mapInPandas(run, "host string, robots string")


def stored(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Visits of stored pages (url, html); one that isn't there fails."""
    have = pages.select(normalize_url(F.col("url")).alias("url"), "html").dropDuplicates(["url"])

    def visit(todo: DataFrame) -> DataFrame:
        met = todo.join(have, "url", "left")
        there = F.col("allowed") & F.col("html").isNotNull()
        status = F.when(~F.col("allowed"), "robots-disallowed").when(there, "fetched").otherwise("failed")
        return met.select("site", "url", "key", "host", "wait", status.alias("status"), F.when(there, F.col("html")).alias("html"), F.when(there, F.col("url")).alias("final_url"), F.when(status == "failed", "missing").alias("error"))

    return visit


def crawl_sites(spark: SparkSession, starts: list[str], visit: Callable[[DataFrame], DataFrame], folder: str, config: CrawlConfig = CrawlConfig(), robots: Callable[[DataFrame], DataFrame] | None = None, agent: str = "*") -> DataFrame:
    """Every page visited: site, url, host, depth, pos (order of visit in its site), status, html, final_url, error,
    wait (seconds before it) and start (seconds after its host's first page, if pages took no time);
    and links_found, the site's links that were never visited. ``folder``: a new one that all machines see."""
    folder = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    step = 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{folder}/{step:05d}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step:05d}")

    first = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(starts))], "start string, i long")
    url = normalize_url(F.col("start"))
    frontier = written(first.select(F.col("start").alias("site"), F.coalesce(url, F.col("start")).alias("url"), F.array(F.lit(0).cast("long")).alias("key")))
    home = written(first.select(F.col("start").alias("site"), host(url).alias("home")))
    seen, rules, hosts_seen = frontier.select("site", "url"), None, None
    visited, tables = None, []

    def together(dfs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, dfs)

    for depth in range(config.max_depth + 1):
        here = []
        while True:
            pending = frontier.join(together(here).select("site", "url"), ["site", "url"], "left_anti") if here else frontier
            read = F.count_if(F.col("status") == "fetched").alias("read")
            good = home.select("site").join(together(tables).groupBy("site").agg(read), "site", "left") if tables else home.select("site", F.lit(0).alias("read"))
            place = F.row_number().over(Window.partitionBy("site").orderBy("key"))
            todo = pending.join(good, "site").withColumn("place", place).filter(F.col("place") <= config.max_pages - F.coalesce("read", F.lit(0))).drop("place", "read")
            todo = written(todo.withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))))
            n = todo.count()
            if not n:
                break
            last = n == pending.count()  # nothing of the frontier is left for another round
            if robots and config.respect_robots:
                hosts = todo.select(F.regexp_extract("url", "^[^/]*//[^/?#]+", 0).alias("origin"), "host").groupBy("host").agg(F.min("origin").alias("origin"))
                fresh = written(robots(hosts if rules is None else hosts.join(rules.select("host"), "host", "left_anti")))
                rules = fresh if rules is None else rules.unionByName(fresh)
                asked = with_robots(todo.drop("host"), rules, agent).withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))).select(*todo.columns, "allowed", "crawl_delay")
            else:
                asked = todo.withColumns({"allowed": F.lit(True), "crawl_delay": F.lit(0.0)})
            # The first page of a host is not waited for.
            in_host = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("allowed"), "key", "site"))
            new_host = F.lit(True) if hosts_seen is None else F.col("old").isNull()
            if hosts_seen is not None:
                asked = asked.join(hosts_seen.distinct().withColumn("old", F.lit(True)), "host", "left")
            wait = F.when(~F.col("allowed") | ((in_host == 1) & new_host), 0.0).otherwise(F.greatest(F.lit(float(config.delay_seconds)), F.col("crawl_delay")))
            done = written(visit(asked.withColumn("wait", wait).select(*todo.columns, "allowed", "wait")))
            touched = done.filter("status <> 'robots-disallowed'").select("host")
            hosts_seen = touched if hosts_seen is None else hosts_seen.union(touched)
            here.append(done)
            tables.append(done)
            if last:
                break
        if not here:
            break
        rows = together(here).withColumn("depth", F.lit(depth))
        visited = rows if visited is None else visited.unionByName(rows)
        if depth == config.max_depth:
            break
        links = rows.filter("status = 'fetched'").select("site", "key", F.posexplode(links_udf(F.col("html"), F.col("final_url"))).alias("at", "url"))
        if config.same_domain:
            links = links.join(home, "site").filter(host(F.col("url")) == F.col("home"))
        found = links.groupBy("site", "url").agg(F.min(F.concat("key", F.array(F.col("at").cast("long")))).alias("key"))
        frontier = written(found.join(seen, ["site", "url"], "left_anti").select("site", "url", "key"))
        seen = seen.unionByName(frontier.select("site", "url"))
    none = spark.createDataFrame([], VISIT).withColumn("depth", F.lit(0))
    visited = none if visited is None else visited
    pos = F.row_number().over(Window.partitionBy("site").orderBy("depth", "key"))
    start = F.sum("wait").over(Window.partitionBy("host").orderBy("depth", "key", "site").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = seen.groupBy("site").agg(F.count("*").alias("queued")).join(visited.groupBy("site").agg(F.count("*").alias("n")), "site", "left")
    left = queued.select("site", (F.col("queued") - F.coalesce("n", F.lit(0))).alias("links_found"))
    return visited.withColumns({"pos": pos.cast("long"), "start": start}).join(left, "site").drop("key")
