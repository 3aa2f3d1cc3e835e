"""From texts to tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators import verbs


@dataclass
class Analyzer:
    """Lexicons and switches of the chain; all empty means tokens and case folding alone. With a tagger, words are tagged, separable verbs merged (and compound nouns joined, if asked for) where ``is_word`` knows the result, and excluded tags dropped."""

    abbreviations: list[tuple[str, str]] = field(default_factory=list)
    stopwords: list[str] = field(default_factory=list)
    lemmata: DataFrame | dict[str, str] | None = None
    hyphens: bool = False
    case_insensitive_abbreviations: bool = False
    tagger: Callable[[list[str]], list[str]] | None = None
    is_word: Callable[[str], bool] = field(default=lambda word: False)
    compounds: bool = False

    def cleaned(self, text: Column) -> Column:
        text = X.expand_abbreviations(text, self.abbreviations, self.case_insensitive_abbreviations)
        return X.normalize_hyphens(text) if self.hyphens else text

    def words(self, text: Column) -> Column:
        """The words that are indexed, in order: stop words go before positions are given."""
        found = X.tokens(self.cleaned(text))
        if self.tagger is not None:  # a tagger sees all words; what it excludes goes before stop words
            sentences = F.transform(X.sentences(self.cleaned(text), [a for a, _ in self.abbreviations]), X.tokens)
            found = verbs.indexed_words(sentences, self.tagger, self.is_word, self.compounds)
        if self.stopwords:
            stop = sorted({w.casefold() for w in self.stopwords})
            found = F.filter(found, lambda w: ~X.casefold(w).isin(stop))  # a hash set from eleven words on
        return found


#: Bytes of a table's files that one task has the texts of, so that what a task holds does not grow with the table.
TASK_BYTES = 8 << 20


def tasks_for(df: DataFrame) -> int:
    """Tasks to which a table in files is dealt: a multiple of the cores, by the bytes of the files; 0 for a table without files."""
    if not df.inputFiles():
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-sum(x for x in sizes if x < 2**62) // (cores * TASK_BYTES)))  # what is not in files may have no known size


def spread(df: DataFrame, by: str | None = None, share: int = 1) -> DataFrame:
    """A table of so few files that cores would idle is dealt out before costly expressions; by a column, any table in files is, to so many times the tasks, so that grouping by that column deals out no tokens."""
    tasks = share * tasks_for(df)
    if by is not None:
        return df.repartition(tasks, by) if tasks else df
    return df.repartition(tasks) if 0 < len(df.inputFiles()) < 4 * df.sparkSession.sparkContext.defaultParallelism else df


def with_lemma(words: DataFrame, lemmata: DataFrame | dict[str, str] | None) -> DataFrame:
    """Adds token: the folded lemma of the word, or of itself; exact and case-sensitive, one hop."""
    if lemmata is None:
        return words.withColumn("token", X.casefold(F.col("word")))
    if isinstance(lemmata, dict):
        # a local relation, whose size Spark knows and broadcasts if it is small
        lemmata = words.sparkSession.createDataFrame(pa.table({"word": pa.array(list(lemmata), pa.string()), "lemma": pa.array(list(lemmata.values()), pa.string())}))
    return words.join(lemmata.select("word", "lemma"), "word", "left").withColumn("token", X.casefold(F.coalesce("lemma", "word"))).drop("lemma")


def analyze(docs: DataFrame, config: Analyzer | None = None, id_col: str = "doc_id", together: int = 0) -> DataFrame:
    """tokens(doc_id, pos, word, token); positions are dense and count indexed words only. ``together`` deals out texts by their id, for tokens that are then grouped by it: 1 to the usual tasks, 2 to twice as many, of half the size."""
    config = config or Analyzer()
    arrays = spread(docs.select(id_col, "text"), id_col if together else None, together or 1).select(id_col, config.words(F.col("text")).alias("words"))
    # an inner explode would add a filter on the array's size, for which the whole chain is evaluated once more, before rows are dealt out
    rows = arrays.select(id_col, F.posexplode_outer("words").alias("pos", "word")).where("pos is not null").withColumn("pos", F.col("pos").cast("long"))
    return with_lemma(rows, config.lemmata).select(id_col, "pos", "word", "token")


def tokens_of(spark: SparkSession, queries: list[str], config: Analyzer | None = None) -> list[list[str]]:
    """The tokens of each query, by the same chain, in one job."""
    out: list[list[str]] = [[] for _ in queries]
    for r in analyze(spark.createDataFrame(list(enumerate(queries)), "doc_id int, text string"), config).orderBy("doc_id", "pos").collect() if queries else []:
        out[r["doc_id"]].append(r["token"])
    return out


def query_tokens(spark: SparkSession, query: str, config: Analyzer | None = None) -> list[str]:
    return tokens_of(spark, [query], config)[0]


def ambiguous(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Words with more than one token in a document: none, as a token depends on the word alone."""
    return tokens.groupBy(id_col, "word").agg(F.count_distinct("token").alias("n")).where("n > 1")


def context_features(tokens: DataFrame, sequence: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Features of a tagger for each word of a sequence (a document, or a document's sentence); those of earlier tags too, if there is a column ``tag``. What there is not is 'None' in a pair."""
    w = Window.partitionBy(*sequence).orderBy("pos")
    word = F.col("word")
    rows = tokens.withColumns({"prevword": F.lag("word", 1).over(w), "prevprevword": F.lag("word", 2).over(w)})
    pair = lambda c: F.concat(F.coalesce(c, F.lit("None")), F.lit("+"), word).alias(f"{c}+word")
    out = [F.lower(word).alias("lower"), F.right(F.lower(word), F.lit(3)).alias("suffix3"), F.left(word, F.lit(1)).alias("prefix1"), "prevword", "prevprevword", pair("prevword"), X.shape(word).alias("shape")]
    if "tag" in tokens.columns:
        rows = rows.withColumns({"prevtag": F.lag("tag", 1).over(w), "prevprevtag": F.lag("tag", 2).over(w)})
        out += ["tag", "prevtag", "prevprevtag", pair("prevtag"), pair("prevprevtag")]
    return rows.select(*sequence, "pos", "word", *out)


def spelling_suggestions(words: DataFrame, vocabulary: DataFrame, most: int = 1) -> DataFrame:
    """(word, suggestion): the vocabulary word within ``most`` edits, nearest first and then by spelling. Candidates share a deletion form, so no pair of all words is made; ``most`` is 1."""
    if most != 1:
        raise ValueError("only one edit is supported")

    def forms(c: str) -> Column:
        w = F.col(c)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.explode(F.array_distinct(F.concat(F.array(w), cut)))

    missing = words.select("word").distinct().join(vocabulary.select("word").distinct(), "word", "left_anti")
    left = missing.select("word", forms("word").alias("form"))
    right = vocabulary.select(F.col("word").alias("known")).distinct().select("known", forms("known").alias("form"))
    near = left.join(right, "form").select("word", "known", F.levenshtein("word", "known").alias("d")).where(F.col("d") <= most)
    return near.groupBy("word").agg(F.min(F.struct("d", "known")).alias("best")).select("word", F.col("best.known").alias("suggestion"))
