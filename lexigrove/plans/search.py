"""Free, boolean and phrase search on an index; each is one plan of filters, broadcast joins of the query and aggregations by document."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.analyze import Analyzer, query_tokens, tokens_of
from lexigrove.plans.boolean import Node, parse
from lexigrove.sources.tables import Index, pruned

# What a terminal is told.
FOUND, NOTHING = "Suchergebnisse für Ihre Suche:", "Nichts gefunden."


def tfidf_cells(index: Index, tokens: list[str]) -> DataFrame:
    """token, doc_id, tfidf by the decimal logarithm."""
    stats = pruned(index, "terms", tokens).crossJoin(F.broadcast(index.n)).select("token", F.log10(F.col("n") / F.col("df")).alias("idf"))
    return pruned(index, "postings", tokens).join(F.broadcast(stats), "token").select("token", "doc_id", (F.col("norm_tf") * F.col("idf")).alias("tfidf"))


def free_search(index: Index, tokens: list[str], k: int | None = None) -> DataFrame:
    """doc_id, score of the documents that score above 0; a token counts as often as it is asked for."""
    spark = index.postings.sparkSession
    if not tokens:
        return index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    asked = spark.createDataFrame(sorted(Counter(tokens).items()), "token string, times long")
    scored = tfidf_cells(index, sorted(set(tokens))).join(F.broadcast(asked), "token").groupBy("doc_id").agg(F.sum(F.col("times") * F.col("tfidf")).alias("score")).where("score > 0")
    ordered = scored.orderBy(F.desc("score"), "doc_id")
    return ordered if k is None else ordered.limit(k)


def _compiled(node: Node, flags: dict[str, Column]) -> Column:
    if node.op == "TERM":
        return flags[node.term]
    parts = [_compiled(p, flags) for p in node.parts]
    return ~parts[0] if node.op == "NOT" else parts[0] & parts[1] if node.op == "AND" else parts[0] | parts[1]


def boolean_search(index: Index, node: Node) -> DataFrame:
    """doc_id, ascending. One aggregation by document; the universe is joined only if a document without any of the terms would match."""
    leaves = node.leaves()
    hits = pruned(index, "postings", leaves).groupBy("doc_id").agg(*(F.bool_or(F.col("token") == t).alias(f"has{i}") for i, t in enumerate(leaves)))
    if node.holds(set()):
        hits = index.docs.join(hits, "doc_id", "left")
    flags = {t: F.coalesce(F.col(f"has{i}"), F.lit(False)) for i, t in enumerate(leaves)}
    return hits.where(_compiled(node, flags)).select("doc_id").orderBy("doc_id")


def boolean_by_sets(index: Index, node: Node) -> DataFrame:
    """The same by set operations."""
    if node.op == "TERM":
        return index.postings.where(F.col("token") == node.term).select("doc_id").distinct()
    parts = [boolean_by_sets(index, p) for p in node.parts]
    if node.op == "NOT":
        return index.docs.exceptAll(parts[0])
    return parts[0].intersect(parts[1]) if node.op == "AND" else parts[0].union(parts[1]).distinct()


def phrase_candidates(index: Index, tokens: list[str]) -> DataFrame:
    """Documents that have all tokens."""
    wanted = sorted(set(tokens))
    return pruned(index, "postings", wanted).groupBy("doc_id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def phrase_search(index: Index, tokens: list[str]) -> DataFrame:
    """doc_id, first_pos: where the phrase first begins, in that order. A token at offset o of the phrase votes for the start pos - o, with bit o."""
    if not tokens:
        return index.tokens.select("doc_id", F.col("pos").alias("first_pos")).limit(0)
    spark = index.tokens.sparkSession
    phrase = spark.createDataFrame(list(enumerate(tokens)), "off int, token string")
    votes = pruned(index, "tokens", sorted(set(tokens))).join(F.broadcast(phrase), "token").select("doc_id", (F.col("pos") - F.col("off")).alias("start"), "off").where("start >= 0")
    if len(tokens) < 63:
        full = votes.groupBy("doc_id", "start").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))).alias("mask")).where(F.col("mask") == (1 << len(tokens)) - 1)
    else:
        full = votes.groupBy("doc_id", "start").agg(F.count_distinct("off").alias("n")).where(F.col("n") == len(tokens))
    return full.groupBy("doc_id").agg(F.min("start").alias("first_pos")).orderBy("first_pos", "doc_id")


def search(index: Index, query: str | list[str], mode: str = "free", k: int | None = None, config: Analyzer | None = None) -> DataFrame:
    """Free text (several arguments are joined, each counted once, quotes removed), a boolean expression, or a phrase; k limits the result."""
    spark = index.postings.sparkSession
    if mode == "free":
        text = " ".join(dict.fromkeys([query] if isinstance(query, str) else query)).replace('"', "").replace("'", "")
        return free_search(index, query_tokens(spark, text, config), k)
    text = query if isinstance(query, str) else query[0]
    if mode == "boolean":
        tree = parse(text)
        names = {}
        for leaf, found in zip(tree.leaves(), tokens_of(spark, tree.leaves(), config), strict=True):
            if not found:
                warnings.warn(f"{leaf!r} has no token and matches no document", stacklevel=2)
            names[leaf] = found[0] if found else ""
        out = boolean_search(index, tree.renamed(names))
    elif mode == "phrase":
        out = phrase_search(index, query_tokens(spark, text, config))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out if k is None else out.limit(k)


def show(found: DataFrame) -> Iterator[str]:
    """Lines for a terminal: a heading and the documents in their order, fetched a partition at a time, or that there are none."""
    empty = True
    for row in found.toLocalIterator():
        if empty:
            yield FOUND
            yield ""
            empty = False
        yield str(row["doc_id"])
    if empty:
        yield NOTHING
