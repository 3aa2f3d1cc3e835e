"""Documents and index tables on disk."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("tokens", "postings", "terms")


def nonempty(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("text") > 0)


def save_documents(docs: DataFrame, path: str) -> None:
    nonempty(docs).write.mode("overwrite").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset in a temporary folder, if Spark runs in one process, and else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lexigrove-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass
class Index:
    tokens: DataFrame | None  # doc_id, pos, word, token
    postings: DataFrame | None  # token, doc_id, tf, norm_tf
    terms: DataFrame | None  # token, cf, df
    docs: DataFrame | None  # doc_id of each document with a posting
    n: DataFrame | None  # one row: n, the number of those
    buckets: int | None = None  # into which saved tables are partitioned by token


def bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets))


def save_table(table: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Writes a table partitioned by a hash of the token and reads it back; a bucket with a very frequent token is split over tasks by adaptive execution."""
    rows = table.withColumn("bucket", bucket("token", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    return table.sparkSession.read.parquet(f"{path}/{name}")


def save_dealt(table: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The same of a table whose tasks are small: each writes its own rows of each bucket, so no row is dealt out again and a very frequent token stays spread over files. Rows are sorted by bucket alone, which takes no comparisons of tokens."""
    table.withColumn("bucket", bucket("token", buckets)).sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    return table.sparkSession.read.parquet(f"{path}/{name}")


def save_docs(docs: DataFrame, path: str, buckets: int) -> None:
    """Writes the documents of an index, their number and the number of buckets."""
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    written = docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/docs")
    written.agg(F.count("*").alias("n")).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def save_index(index: Index, path: str, buckets: int = 16) -> None:
    """Tables partitioned by a hash of the token, so a query on a few tokens reads a few of the folders."""
    for name in TABLES:
        save_table(getattr(index, name), name, path, buckets)
    save_docs(index.docs, path, buckets)


def load_index(spark: SparkSession, path: str, names: tuple[str, ...] = (*TABLES, "docs"), buckets: int | None = None) -> Index:
    """A saved index; of one that has only the tables named, the others are None, and without documents the number of buckets is to be given."""
    found = (spark.read.parquet(f"{path}/{n}") if n in names else None for n in (*TABLES, "docs"))
    if "docs" not in names:
        return Index(*found, None, buckets)
    meta = spark.read.parquet(f"{path}/meta")
    return Index(*found, meta.select("n"), meta.first()["buckets"])


def pruned(index: Index, name: str, tokens: list[str]) -> DataFrame:
    """Rows of the tokens; of a saved index only their buckets are read, as the hashes of literals are folded before files are listed."""
    table = getattr(index, name)
    rows = table.where(F.col("token").isin(tokens))
    if index.buckets is None or not tokens:
        return rows
    own = [F.col("bucket") == bucket(F.lit(t), index.buckets) for t in sorted(set(tokens))]
    some = own[0]
    for one in own[1:]:
        some = some | one
    return rows.where(some)
