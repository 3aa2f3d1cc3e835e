"""Crawling in rounds: the frontier is a table, fetching runs on the executors host by host, and filters are joins.

A fetcher maps a URL to (status, mime, body, location); it is injected, so tests need no network.
"""

from __future__ import annotations

import http.client
import time
from collections.abc import Callable
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import html, urls
from lexigrove.operators import links

Fetched = tuple[int, str, str, str]
FETCH = "url string, status int, mime string, html string, location string, visited_at timestamp"


def http_fetch(url: str, agent: str = "lexigrove", timeout: float = 20.0) -> Fetched:
    """One GET on a connection of its own, so no redirect is followed; a failed connection has status 0."""
    parts = urlsplit(url)
    kind = {"http": http.client.HTTPConnection, "https": http.client.HTTPSConnection}.get(parts.scheme)
    if kind is None or not parts.netloc:
        return 0, "", "", ""
    connection = None
    try:
        connection = kind(parts.netloc.rpartition("@")[2], timeout=timeout)
        line = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~") + (f"?{quote(parts.query, safe='/%:@!$&()*+,;=~?')}" if parts.query else "")
        connection.request("GET", line, headers={"User-Agent": agent})
        r = connection.getresponse()
        return r.status, (r.headers.get_content_type() or ""), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.headers.get("Location") or ""
    except (http.client.HTTPException, OSError, ValueError, LookupError):
        return 0, "", "", ""
    finally:
        if connection is not None:
            connection.close()


def action(status: Column, mime: Column) -> Column:
    """What follows a response: redirect, skip or store."""
    return F.when(status.between(300, 307), "redirect").when((status == 0) | (status == 204) | status.between(400, 598), "skip").when(mime == "text/html", "store").otherwise("skip")


def parse_robots(host: str, text: str) -> list[tuple[str, str, bool, str]]:
    """(host, agent, allow, path_prefix) of the rules of a robots.txt."""
    out, agents, fresh = [], [], True
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [value.lower()] if fresh is False or not agents else [*agents, value.lower()]
            fresh = True
        elif key in ("allow", "disallow") and agents:
            fresh = False
            if value:
                out += [(host, a, key == "allow", value) for a in agents]
    return out


def fetch(frontier: DataFrame, fetcher: Callable[[str], Fetched] = http_fetch, polite: float = 2.0) -> DataFrame:
    """Fetches each URL once; URLs of a host share a task and wait ``polite`` seconds between two."""

    def run(batches):
        last: dict[str, float] = {}
        for batch in batches:
            rows = []
            for url in batch["url"]:
                name = urlsplit(url).netloc
                wait = last.get(name, 0.0) + polite - time.monotonic()
                if name in last and wait > 0:
                    time.sleep(wait)
                rows.append((url, *fetcher(url), pd.Timestamp.now("UTC").tz_localize(None)))
                last[name] = time.monotonic()
            yield pd.DataFrame(rows, columns=["url", "status", "mime", "html", "location", "visited_at"])

    return frontier.select("url", urls.host(F.col("url")).alias("host")).repartition("host").select("url").mapInPandas(run, FETCH)


def robots_rules(fetched: DataFrame) -> DataFrame:
    """host, agent, allow, path_prefix of fetched robots files; what could not be fetched has no rules."""

    def parse(batches):
        for batch in batches:
            yield pd.DataFrame([r for u, status, body in zip(batch["url"], batch["status"], batch["html"], strict=True) if status == 200 for r in parse_robots(urlsplit(u).netloc, body)], columns=["host", "agent", "allow", "path_prefix"])

    return fetched.select("url", "status", "html").mapInPandas(parse, "host string, agent string, allow boolean, path_prefix string")


def crawl(spark: SparkSession, seed: str, domains: list[str], path: str, fetcher: Callable[[str], Fetched] = http_fetch, *, polite: float = 2.0, rounds: int = 50, agent: str = "*", suffixes: list[str] | None = None) -> DataFrame:
    """Crawls from a seed within the whitelist; each round is written under ``path``. Returns url, title, text, html, visited_at of stored pages.

    A round first fetches the robots files of hosts that are new, as politely and by the same executors as pages.
    With ``suffixes``, the public suffixes, a registered domain is one label more than a suffix; without, the last two labels.
    """
    frontier = spark.createDataFrame([(seed,)], "url string").select(urls.normalize(F.col("url")).alias("url"))
    start = frontier.first()["url"]
    white = links.expand_whitelist(spark.createDataFrame([(d,) for d in [urlsplit(start).hostname or "", *domains]], "host string"))
    domain = None if suffixes is None else links.registered_domain(urls.host(F.col("url")), suffixes)
    visited, asked = spark.createDataFrame([], "url string"), spark.createDataFrame([], "url string")

    def written(kind: str, n: int) -> DataFrame:
        return spark.read.schema(FETCH).parquet(*[f"{path}/{kind}={k}" for k in range(n + 1)])

    for n in range(rounds):
        inside = links.internal(frontier, white, domain)
        files = inside.select(F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/robots.txt")).alias("url")).distinct().join(asked, "url", "left_anti")
        fetch(files, fetcher, polite).write.mode("overwrite").parquet(f"{path}/robots={n}")
        robots = written("robots", n)
        asked = robots.select("url")
        todo = links.allowed(inside, robots_rules(robots).distinct(), agent).join(visited, "url", "left_anti").dropDuplicates(["url"])
        fetch(todo, fetcher, polite).write.mode("overwrite").parquet(f"{path}/round={n}")
        got = spark.read.schema(FETCH).parquet(f"{path}/round={n}").withColumn("action", action(F.col("status"), F.col("mime")))
        visited = written("round", n).select("url").distinct()
        found = got.where("action = 'store'").select("url", F.explode(html.parsed(F.col("html"))["links"]).alias("href")).unionByName(got.where("action = 'redirect'").select("url", F.col("location").alias("href")))
        frontier = found.where(urls.crawlable(F.col("href"))).select(urls.absolute(F.col("href"), F.col("url")).alias("url")).distinct().join(visited, "url", "left_anti")
        if not frontier.limit(1).count():
            break
    pages = written("round", n)
    pages = pages.where(action(F.col("status"), F.col("mime")) == "store")
    return pages.select("url", F.coalesce(html.parsed(F.col("html"))["title"], F.lit("")).alias("title"), html.body_text(F.col("html")).alias("text"), "html", "visited_at")


def write_log(pages: DataFrame, path: str) -> None:
    """(timestamp, url, file) as CSV."""
    pages.select(F.date_format("visited_at", "yyyy-MM-dd HH:mm:ss").alias("visited_at"), "url", urls.file_name(F.col("url")).alias("file")).write.mode("overwrite").csv(path)
