"""Index upkeep from a stream of documents: each micro-batch appends its postings, and term statistics are sums over batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrove.operators.analyze import Analyzer, analyze
from lexigrove.operators.index import postings, terms, universe
from lexigrove.sources.tables import Index


def ingest(docs: DataFrame, path: str, checkpoint: str, config: Analyzer | None = None, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Starts the query. A document whose id was indexed by another batch, or comes again in its own, is dropped, so counts add up; with a watermark such rows go before that, within it. A batch that is run twice overwrites its own folder, and each table is made from the written one before it, so a text is analysed once."""
    if watermark:
        docs = docs.withWatermark(*watermark).dropDuplicatesWithinWatermark(["doc_id"])

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates(["doc_id"])
        if n:
            try:
                rows = rows.join(spark.read.parquet(f"{path}/docs").where(F.col("batch") != n).select("doc_id"), "doc_id", "left_anti")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise

        def written(name: str, table: DataFrame) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
            return spark.read.schema(table.schema).parquet(f"{path}/{name}/batch={n}")

        posted = written("postings", postings(written("tokens", analyze(rows, config))))
        written("terms", terms(posted))
        written("docs", universe(posted))

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def ingested(spark: SparkSession, path: str) -> Index:
    """The index of all batches: counts of terms add up, as no document is in two batches."""
    tokens, posted, counted, docs = (spark.read.parquet(f"{path}/{n}") for n in ("tokens", "postings", "terms", "docs"))
    docs = docs.select("doc_id")
    return Index(tokens, posted, counted.groupBy("token").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")), docs, docs.agg(F.count("*").alias("n")))
