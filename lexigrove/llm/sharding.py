"""Reproducible sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in an order that depends only on their content (a hash
class, then doc_id and text hash): hash classes are counted first, so a row's number is its
class's offset plus its place in the class, and no window spans the table. A
row's number is permuted over [0, n) by a Feistel network on a x b >= n whose
left and right halves are numbers below a and b and are moved by keyed hashes of
each other; a number that leaves [0, n) is permuted again until it falls back
(cycle walking). As a cycle passes at most a*b - n numbers outside, and a and b are chosen
so that these are at most WALK, the walk is bounded and exact. The permuted number p
gives the shard p mod shards and the slot p div shards: shard sizes differ by one
row at most, slots have no gaps, and both can be computed from the number alone.

Only DataFrame functions are used. Defined cases: null text has no bytes; rows that repeat a doc_id are
separate rows, and equal rows take adjacent numbers in any order; a null doc_id
is a key like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
ROUNDS = 6
WALK = 16
KEY = 20240229
ROWS_PER_CLASS = 4096


def halves(n: int, walk: int = WALK) -> tuple[int, int]:
    """(a, b), about square, with n <= a*b <= n + walk."""
    a = max(1, math.isqrt(max(n, 1)))
    while -n % a > walk:
        a += 1
    return a, max(1, -(-n // a))


def _div(x: Column, d: int) -> Column:
    """Whole quotient of longs; exact, as the dividend is a multiple."""
    return F.call_function("div", x, F.lit(d))


def permuted(x: Column, n: int, key: int = KEY) -> Column:
    """The image of x in [0, n)."""
    a, b = halves(n)
    spare = a * b - n

    def network(y: Column) -> Column:
        left, right = y % a, _div(y, a)
        for r in range(ROUNDS):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(key), F.lit(r), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(key), F.lit(r), right), F.lit(a)), F.lit(a))
        return right * a + left

    once = network(x.cast("long"))
    if not spare:
        return once
    return F.aggregate(F.sequence(F.lit(1), F.lit(spare)), once, lambda y, _: F.when(y < n, y).otherwise(network(y)))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``number`` 0..n-1 and n, in an order of hash classes and then of the given columns."""
    n = rows.count()
    classes = max(1, min(1 << 20, n // ROWS_PER_CLASS))
    rows = rows.withColumn("class", F.pmod(F.xxhash64(*order), F.lit(classes)))
    sizes = rows.groupBy("class").agg(F.count("*").alias("rows"))
    before = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # a row a class, at most 2^20
    offsets = sizes.select("class", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(offsets, "class").withColumn("number", F.col("offset") + F.col("place")).drop("class", "place", "offset"), n


def sharded(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and number of each document."""
    text = F.coalesce("text", F.lit(""))
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("tie"),
    )
    rows, n = numbered(light, ["doc_id", "tie", "text_crc32"])
    p = permuted(F.col("number"), n, key)
    return rows.withColumn("p", p).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        _div(F.col("p"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "number",
    )
