"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.fingerprint import edited_pairs

    return edited_pairs(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexigrove.llm.token_store import token_round_trip

    return token_round_trip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm._store import keep
    from lexigrove.llm.mixing import drawn, mixed

    rows = mixed(keep(drawn(_table(spark, sf_dir, "documents"), ["doc_id"]), "mix"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.sharding import sharded

    return sharded(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.packing import clustered, packed

    return packed(clustered(_table(spark, sf_dir, "documents")), size=F.col("size"), cluster=F.col("cluster"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.warc import archive_round_trip

    return archive_round_trip(spark, _table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.toxicity import fitted, held_out, scored

    docs = _table(spark, sf_dir, "documents")
    model = fitted(docs, _table(spark, sf_dir, "labels"))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrove.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_store": op3_token_store,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_licenses": op7_licenses,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_search": op10_search,
}


def oracle_sql() -> dict[str, str]:
    from lexigrove.llm import mixing

    return {"op4_mixing": mixing.ORACLE_SQL}
