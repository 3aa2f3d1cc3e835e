"""Term matrices and JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.operators.index import idf, nested, with_stats


def tfidf_long(posted: DataFrame, stats: DataFrame, n: DataFrame) -> DataFrame:
    """token, doc_id, norm_tf, idf (natural logarithm over all documents), tfidf."""
    rows = idf(with_stats(posted.select("token", "doc_id", "norm_tf"), stats.select("token", "df")), n, "ln")
    return rows.select("token", "doc_id", "norm_tf", "idf", (F.col("norm_tf") * F.col("idf")).alias("tfidf"))


def tfidf_matrix(posted: DataFrame, stats: DataFrame, n: DataFrame, doc_ids: list) -> DataFrame:
    """A row a token, a column a document of the given ones; 0 where it does not occur."""
    ids = sorted(doc_ids)
    wide = posted.where(F.col("doc_id").isin(ids)).groupBy("token").pivot("doc_id", ids).agg(F.first("norm_tf")).na.fill(0.0)
    stats = idf(stats, n, "ln")
    return stats.join(wide, "token").select("token", "cf", *(F.col(f"`{d}`").alias(f"tf_{d}") for d in ids), "idf", *((F.col(f"`{d}`") * F.col("idf")).alias(f"tfidf_{d}") for d in ids))


@F.pandas_udf(T.StringType())
def comma_number(x: pd.Series) -> pd.Series:
    """Up to twelve digits, with a decimal comma."""
    return x.map(lambda v: ("%.12g" % v).replace(".", ","), na_action="ignore")


def _number(name: str) -> Column:
    return comma_number(F.col(f"`{name}`").cast("double")).alias(name)


def matrix_csv(matrix: DataFrame, words: DataFrame, path: str) -> None:
    """A line a token and surface word, by falling cf and then token; ;-separated."""
    rows = matrix.join(words.select("token", F.explode("words").alias("word")), "token").orderBy(F.desc("cf"), "token", "word")
    numbers = [c for c in matrix.columns if c not in ("token", "cf")]
    rows.select(F.col("word").alias("TOKEN"), F.col("token").alias("LEMMA"), F.col("cf").alias("Collection Frequency"), *map(_number, numbers)).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def index_json(posted: DataFrame, path: str) -> None:
    nested(posted).write.mode("overwrite").json(path)
