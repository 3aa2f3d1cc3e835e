"""Link filters as joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import urls


def expand_whitelist(hosts: DataFrame) -> DataFrame:
    """Each host with its www. variant: without it if it begins so, with it otherwise; addresses and single labels have none."""
    h = F.col("host")
    variant = F.when(h.startswith("www."), F.substring(h, 5, 10_000)).otherwise(F.concat(F.lit("www."), h))
    plain = h.rlike(r"^[0-9.:]+$") | ~h.contains(".")
    return hosts.select(F.explode(F.when(plain, F.array(h)).otherwise(F.array(h, variant))).alias("host")).where("host != ''").distinct()


def registered_domain(host: Column, suffixes: list[str]) -> Column:
    """One label more than the longest of the public suffixes given."""
    known = {s.strip(".").lower() for s in suffixes}

    @F.pandas_udf(T.StringType())
    def of(names: pd.Series) -> pd.Series:
        def one(name):
            labels = (name or "").split(":")[0].lower().split(".")
            for k in range(len(labels)):
                if ".".join(labels[k:]) in known:
                    return ".".join(labels[max(0, k - 1) :])
            return ".".join(labels[-2:])

        return names.map(one)

    return of(host)


def internal(found: DataFrame, whitelist: DataFrame, domain: Column | None = None) -> DataFrame:
    """URLs whose host or registered domain is whitelisted. Both names of a URL are keys of one equi-join; hosts repeat, so they are joined once each."""
    host = urls.host(F.col("url"))
    keyed = found.withColumns({"_host": host, "_domain": urls.domain(host) if domain is None else domain})
    names = keyed.select("_host", "_domain").distinct().select("_host", F.explode(F.array_distinct(F.array("_host", "_domain"))).alias("_name"))
    white = whitelist.select(F.col("host").alias("_name")).distinct()
    inside = names.join(white, "_name", "left_semi").select("_host").distinct()
    return keyed.join(inside, "_host", "left_semi").select(*found.columns)


def allowed(found: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """URLs that no rule denies: of the rules of the agent, or else of *, that the path begins with, the longest counts, and an allowing one of equal length wins."""
    own = robots.where(F.lower("agent") == agent.lower()).select("host").distinct()
    rules = robots.where(F.lower("agent") == agent.lower()) if agent == "*" else robots.where(F.lower("agent") == agent.lower()).unionByName(robots.where("agent = '*'").join(own, "host", "left_anti"))
    rules = rules.select(F.col("host").alias("_h"), F.col("path_prefix").alias("_p"), "allow")
    keyed = found.select("url").distinct().withColumns({"_host": urls.host(F.col("url")), "_path": F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url")))})
    hits = keyed.join(rules, (F.col("_h") == F.col("_host")) & F.col("_path").startswith(F.col("_p")))
    denied = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("_p"), F.col("allow").cast("int"))).alias("allow")).where(~F.col("allow"))
    return found.join(denied, "url", "left_anti")


def unknown(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("url"), "url", "left_anti").dropDuplicates(["url"])
