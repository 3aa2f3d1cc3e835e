"""Index tables from tokens(doc_id, pos, word, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.analyze import Analyzer, analyze
from lexigrove.sources.tables import TABLES, Index, load_index, save_dealt, save_docs, save_table

#: Postings of a token, as a part of all, from which on it is frequent; so at most so many tokens are.
FREQUENT = 1 << 18


def term_freq(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def postings(tokens: DataFrame, relative: bool = False) -> DataFrame:
    """token, doc_id, tf, norm_tf (by the document's largest tf) and, if asked for, rel_tf (by its length)."""
    w = Window.partitionBy("doc_id")
    tf = term_freq(tokens)
    out = tf.withColumn("norm_tf", F.col("tf") / F.max("tf").over(w))
    if relative:
        out = out.withColumn("rel_tf", F.col("tf") / F.sum("tf").over(w))
    return out.select("token", "doc_id", "tf", "norm_tf", *(["rel_tf"] if relative else []))


def terms(posted: DataFrame) -> DataFrame:
    """token, cf (all occurrences), df (documents)."""
    return posted.groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def positions(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def positional_index(tokens: DataFrame) -> DataFrame:
    """token, doc_id, tf, norm_tf, positions, of one aggregation by document and token."""
    w = Window.partitionBy("doc_id")
    rows = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.withColumn("norm_tf", F.col("tf") / F.max("tf").over(w)).select("token", "doc_id", "tf", "norm_tf", "positions")


def universe(posted: DataFrame) -> DataFrame:
    return posted.select("doc_id").distinct()


def idf(stats: DataFrame, n: DataFrame, base: str = "log10") -> DataFrame:
    """stats with idf; n has one row with the number of documents."""
    log = F.log10 if base == "log10" else F.log
    return stats.crossJoin(F.broadcast(n.select(F.col("n")))).withColumn("idf", log(F.col("n") / F.col("df"))).drop("n")


def with_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """posted with the columns of stats(token, df, ...). Statistics of frequent tokens are broadcast, so that only the rows of rare ones are dealt out by token, none of which has many."""
    every = stats.agg(F.sum("df").alias("every"))
    stats = stats.crossJoin(F.broadcast(every)).withColumn("often", F.col("df") * FREQUENT >= F.col("every")).drop("every")
    often, seldom = stats.where("often").drop("often"), stats.where("not often").drop("often")
    rare = posted.join(F.broadcast(often.select("token")), "token", "left_anti")
    return posted.join(F.broadcast(often), "token").unionByName(rare.join(seldom, "token"))


def lemma_words(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.array_sort(F.collect_set("word")).alias("words"))


def index_of(tokens: DataFrame) -> Index:
    posted = postings(tokens)
    docs = universe(posted)
    return Index(tokens, posted, terms(posted), docs, docs.agg(F.count("*").alias("n")))


def build_index(docs: DataFrame, config: Analyzer | None = None, path: str | None = None, buckets: int = 16, names: tuple[str, ...] = (*TABLES, "docs")) -> Index:
    """The index of documents. With a path the saved index is returned, without it a plan. Texts are dealt out by their id and analysed for tokens and again for postings, which costs less than to deal out tokens; terms and documents are made from the written postings. Of a saved index only the tables named may be built."""
    tokens = analyze(docs, config, together=1)
    if path is None:
        return index_of(tokens)
    spark = docs.sparkSession
    if "tokens" in names:
        save_dealt(tokens, "tokens", path, buckets)
    if "postings" in names:
        save_dealt(postings(tokens), "postings", path, buckets)
    if "terms" in names:
        save_table(terms(spark.read.parquet(f"{path}/postings")), "terms", path, buckets)
    if "docs" in names:
        save_docs(universe(spark.read.parquet(f"{path}/postings")), path, buckets)
    return load_index(spark, path, names, buckets)


def nested(posted: DataFrame, per_row: int = 10_000) -> DataFrame:
    """token, cf, block and a map of doc_id to norm_tf (and positions): the shape of the JSON export. A token of more than ``per_row`` documents has several rows, dealt by a hash of the document."""
    value = F.struct("norm_tf", "positions") if "positions" in posted.columns else F.col("norm_tf")
    stats = terms(posted).select("token", "cf", F.ceil(F.col("df") / per_row).alias("blocks"))
    rows = posted.join(stats, "token").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    return rows.groupBy("token", "cf", "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("doc_id"), value.alias("value"))))).alias("docs"))
