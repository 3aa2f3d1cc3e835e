"""Mixing sources to target weights by Pareto order sampling.

The words to take are shared among the sources by weight; a source that would
give more than ``most`` times its own words gives just that, and what it cannot
give is shared anew among the others. A source that is asked for r times its
words takes each of its documents floor(r) whole times for certain. For the words that are
left, each document has an inclusion probability in proportion to its words, p = min(1, c * size) with c
such that the expected words are those wanted; documents of p = 1 are one more certain copy. Of the
others the rank is the Pareto variable u(1-p)/(p(1-u)), with u a fixed hash of the document, and
those of lowest rank are taken once more. The sample's size is fixed in words: the order is cut where
the source's words are spent, and the document that the target falls into is taken if that comes nearer.

Nothing is sorted over a source: c comes from the counts of its sizes (of which there are at most the root of
twice its words), and documents are counted into RANKS classes of rank, which are
summed before any shuffle; only documents in the one class that the target falls into are
put in order. What is known of the sources is a written table, which Spark broadcasts
if its size is below the session's threshold and joins by shuffle beyond.

Defined cases: a null text has no words, is taken no words of and counts for
nothing; a null source is a source of its own, after all others; rows that
repeat a doc_id are separate documents, and equal rows share a rank and are told
apart by number; a corpus without words takes nothing; an empty table gives no
rows; all columns are kept, whatever their names, in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm._store import forget, keep

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANKS = 65536
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    A source is capped exactly if its cap is at most its share of what the
    sources with a lower cap per weight leave, so one pass in that order finds the
    level.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything))
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.col("total") * share - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))))
    w = w.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free).alias("target"))


def drawn(docs: DataFrame, columns: Sequence[str] | None = None, *, size: Column | None = None, seed: str = SEED) -> DataFrame:
    """row (the columns, all by default), doc_id, source, size and u, the fixed draw in (0, 1) of each document: 52 bits of an MD5, at the middle of their step."""
    size = n_words(F.col("text")) if size is None else size
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")), 1, 13)
    row = F.struct(*(docs.columns if columns is None else columns)).alias("row")
    return docs.select(row, "doc_id", "source", size.alias("size"), ((F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**52).alias("u"))


def _of_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by source, null being one."""
    return rows.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def rates(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """source, c, certain_above (sizes that are certain) and left (words for the others) of sources (source, rest) with words left to draw."""
    sizes = _of_source(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), per_source.where("rest > 0").select("source", "rest"))
    of, up = Window.partitionBy("source"), Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("n")
    sizes = sizes.withColumn("left", F.col("rest") - (F.sum(words).over(of) - F.sum(words).over(up))).withColumn("c", F.col("left") / F.sum(squares.cast("decimal(38,0)")).over(up).cast("double"))
    # the largest size that is not certain, given that all larger ones are
    best = sizes.where("c * size < 1").groupBy("source").agg(F.max(F.struct("size", "c", "left")).alias("top"))
    return best.select("source", F.col("top.c").alias("c"), F.col("top.size").alias("certain_above"), F.col("top.left").alias("left"))


def mixed(sized: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """row, size, source_size, target and copies (how often it is taken) of rows of drawn(), best written before as they are read several times."""
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    asked = keep(per_source.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    rated = keep(_of_source(asked, rates(sized, asked), "left"), "rates")

    p = F.col("c") * F.col("size")
    open_rows = (F.col("size") > 0) & (F.col("size") <= F.col("certain_above"))
    rank = F.when(open_rows, F.col("u") * (1 - p) / (p * (1 - F.col("u"))))
    klass = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * RANKS), F.lit(RANKS - 1)).cast("int")
    ranked = _of_source(sized.select("source", "size", "u"), rated.select("source", "c", "certain_above")).withColumn("rank", rank).where("rank is not null")
    classes = ranked.groupBy("source", klass.alias("class")).agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    classes = _of_source(classes.withColumn("before", F.sum("words").over(so_far) - F.col("words")), rated.select("source", "left"))
    cut = classes.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).groupBy("source").agg(F.min(F.struct("class", "before")).alias("cut"))
    known = keep(_of_source(rated, cut, "left"), "cuts")
    forget(asked, rated)

    rows = _of_source(sized, known).withColumn("rank", rank).withColumn("class", klass)
    within = F.coalesce(F.col("class") == F.col("cut.class"), F.lit(False))
    # without a cut the ranked documents have fewer words than are left, if only by rounding, and all are taken
    extra = (F.col("size") > F.col("certain_above")) | (F.col("class") < F.col("cut.class")) | (F.col("cut").isNull() & F.col("rank").isNotNull())
    sure = rows.where(~within).withColumn("extra", F.coalesce(extra, F.lit(False)).cast("int"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(within).withColumn("spent", F.col("cut.before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("spent") + F.col("size") / 2 <= F.col("left")).cast("int")).drop("spent")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int")
    return sure.unionByName(edge).select("row", "size", "source_size", "target", copies.alias("copies"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
r AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT source, source_size, weight, source_size * 2 AS cap,
         (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5 - CAST(coalesce(sum(source_size * 2) OVER below, 0) AS DOUBLE))
         / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER below, 0) AS DOUBLE) AS level
  FROM s WINDOW below AS (ORDER BY CAST(source_size * 2 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, cap <= level * weight AS capped,
         CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
              ELSE weight * (SELECT arg_min(level, CAST(cap AS DOUBLE) / weight) FROM l WHERE NOT cap <= level * weight) END AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
g AS (
  SELECT source, source_size, target, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest FROM p),
q AS (
  SELECT r.doc_id, r.source, r.size, r.u, g.source_size, g.target, g.whole, g.rest
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
h AS (
  SELECT source, rest, size, count(*) AS n FROM q WHERE size > 0 AND rest > 0 GROUP BY ALL),
c AS (
  SELECT source, size, rest - CAST(sum(size * n) OVER (PARTITION BY source) - sum(size * n) OVER up AS DOUBLE) AS left_over,
         CAST(sum(CAST(size AS HUGEINT) * size * n) OVER up AS DOUBLE) AS squares
  FROM h WINDOW up AS (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (
  SELECT source, max(size) AS certain_above, arg_max(left_over / squares, size) AS c, arg_max(left_over, size) AS left_over
  FROM c WHERE left_over / squares * size < 1 GROUP BY source),
x AS (
  SELECT q.*, k.certain_above, k.left_over, q.size > 0 AND q.size <= k.certain_above AS ranked,
         u * (1 - k.c * q.size) / (k.c * q.size * (1 - u)) AS rank
  FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, ranked ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM x)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > certain_above THEN 1 WHEN ranked AND spent + size / 2.0 <= left_over THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
