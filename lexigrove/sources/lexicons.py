"""Lexicon files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.text import casefold


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value); a missing file has no lines."""
    try:
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "line_no long, value string")


def pairs_of(lines: DataFrame) -> DataFrame:
    """(key, value, line_no) of lines of two ;-separated parts; the value is stripped, the key is not, and the last line of a key counts."""
    parts = F.split("value", ";")
    rows = lines.where(F.size(parts) == 2).select(parts[0].alias("key"), F.trim(parts[1]).alias("value"), "line_no")
    return rows.groupBy("key").agg(F.max_by("value", "line_no").alias("value"), F.min("line_no").alias("line_no"))


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    return pairs_of(_lines(spark, path))


def stopwords_of(lines: DataFrame) -> DataFrame:
    return lines.select(casefold(F.trim("value")).alias("word")).where("word != ''").distinct()


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    return stopwords_of(_lines(spark, path))


def corpus_lemmata(lines: DataFrame, columns: int = 15, word: int = 1, lemma: int = 2) -> DataFrame:
    """(word, lemma) of a column corpus: lines of exactly so many fields, words that differ from their lemma, first one first, no lemma that begins with --."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(parts) == columns).select("line_no", parts[word].alias("word"), parts[lemma].alias("lemma"))
    rows = rows.where((F.col("word") != F.col("lemma")) & ~F.col("lemma").startswith("--"))
    return rows.groupBy("word").agg(F.min_by("lemma", "line_no").alias("lemma"))


def merged_lemmata(maps: list[DataFrame], dropped: tuple[str, ...] = ("unknown", "-")) -> DataFrame:
    """(word, lemma) of several maps; a later map overrides an earlier one."""
    ranked = [m.select("word", "lemma", F.lit(k).alias("priority")) for k, m in enumerate(maps)]
    every = ranked[0]
    for m in ranked[1:]:
        every = every.unionByName(m)
    return every.where(~F.col("lemma").isin(*dropped)).groupBy("word").agg(F.max_by("lemma", "priority").alias("lemma"))
