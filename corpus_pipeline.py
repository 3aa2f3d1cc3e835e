"""The corpus pipeline: toxic documents go, one of each near-duplicate class stays, sources are mixed to their weights, and what is taken is packed into bins.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of documents. A document that the mix takes
twice has two rows.

Defined cases: null and empty texts are scored as texts of no words, are near duplicates of
each other, are taken no words of by the mix and so go there; a null source is a source of its own
in the mix and conflicts with none in a bin; null and repeated doc_ids are rows of their own, of
which equal texts are near duplicates; ties are settled as the operators say; an empty table gives no
rows; further columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm._store import keep
from lexigrove.llm.minhash import without_near_duplicates
from lexigrove.llm.mixing import drawn, mixed
from lexigrove.llm.packing import packed
from lexigrove.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixed(keep(drawn(docs), "mix")).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the classifier nor the signatures; tests/llm hold their operators against brute force or held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
