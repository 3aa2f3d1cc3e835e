"""Document fingerprints: a quartile bucket digest.

Every run of three bytes of a text is hashed into one of 256 buckets; the
digest keeps, for each bucket, in which quarter of the bucket counts its own
count lies (two bits), along with the logarithmic length and the two quartile
ratios. Two digests are compared by a weighted count of differing quarters plus
bounded length and ratio terms, scaled to a likeness from 0 to 1.

Defined cases: a null text is an empty text; an empty text, and one of fewer
than three bytes, has the digest of no triplets and its length; equal texts
have equal digests; a corpus of one document is its own next document; rows
that repeat a doc_id are ordered by the hash of their text; further columns
are ignored; a null doc_id is below all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm import _text
from lexigrove.llm._store import bound_batches, id_back, id_of

BUCKETS = 256
#: The distance at and beyond which two digests count as wholly unlike.
FULL_DISTANCE = 600.0
#: Distance of two quarter codes by their difference 0..3; opposite quarters weigh double.
CODE_STEP = np.array([0, 1, 2, 6], dtype=np.float64)

_TABLES = [_text.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(7919 + 2 * k)).astype(np.uint8) for k in range(3)]


def digests(raw: np.ndarray, at: np.ndarray) -> list[str]:
    """The digest of each text as lower-case hex: length, two ratios, then 256 two-bit codes."""
    rows = len(at) - 1
    length = np.diff(at)
    counts = np.zeros((rows, BUCKETS), dtype=np.int64)
    if len(raw) >= 3:
        a, b, c = (_TABLES[k][raw[k : len(raw) - 2 + k]] for k in range(3))
        row = np.repeat(np.arange(rows), length)
        whole = row[:-2] == row[2:]
        key = row[:-2].astype(np.int64) * BUCKETS + (a ^ b ^ c)
        counts = np.bincount(key[whole], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(rows, -1, 4)
    packed = (codes[..., 0] << 6 | codes[..., 1] << 4 | codes[..., 2] << 2 | codes[..., 3]).astype(np.uint8)
    head = np.zeros((rows, 3), dtype=np.uint8)
    head[:, 0] = np.minimum(255, np.round(np.log1p(length) * 10))
    top = np.maximum(q3[:, 0], 1)
    head[:, 1], head[:, 2] = q1[:, 0] * 15 // top, q2[:, 0] * 15 // top
    return [x.tobytes().hex() for x in np.hstack([head, packed])]


def _unpacked(digest: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digest)), dtype=np.uint8).reshape(len(digest), -1)
    codes = np.stack([raw[:, 3:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digest), -1)
    return raw[:, :3].astype(np.float64), codes.astype(np.int8)


def likeness(a: pd.Series, b: pd.Series) -> np.ndarray:
    """1 for equal digests, down to 0 at FULL_DISTANCE and beyond."""
    if not len(a):
        return np.zeros(0)
    (head_a, a_codes), (head_b, b_codes) = _unpacked(a), _unpacked(b)
    distance = CODE_STEP[np.abs(a_codes - b_codes)].sum(axis=1)
    off = np.abs(head_a - head_b)
    distance += np.minimum(off[:, 0], 40) + np.minimum(off[:, 1:].sum(axis=1), 10)
    return np.maximum(0.0, 1.0 - distance / FULL_DISTANCE)


@F.pandas_udf(T.StringType())
def _digest(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in text:
        yield pd.Series(_digests_of(pa.array(s, pa.large_string(), from_pandas=True)), index=s.index)


def _digests_of(texts: pa.Array) -> list[str]:
    out: list[str] = []
    for part in _text.chunks(pa.record_batch([texts], ["text"]), "text"):
        out += digests(*_text.buffers(part.column("text")))
    return out


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likeness(a, b), index=a.index)


def fingerprint(text: Column) -> Column:
    """The digest of a text column."""
    return _digest(F.coalesce(text, F.lit("")))


def compare(a: Column, b: Column) -> Column:
    """Likeness of two digest columns."""
    return _likeness(a, b)


def with_next(docs: DataFrame, value: str = "text", *, rows_per_range: int = 2048) -> DataFrame:
    """(doc_id, value, range, guest) so that, in each range in the order (guest, doc_id descending), each row but a guest is followed by the next document.

    Only doc_ids are gathered to find the ranges: quantiles of them and the highest one of each range, which are as many values as there are ranges. The highest row of a range is sent along to the range above it as its guest, and that of the topmost to the lowest, so texts are moved once and no window spans more than a range.
    """
    rows = docs.count()
    parts = max(1, min(100_000, -(-rows // rows_per_range)))
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    cuts = np.array(cuts, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32), index=ids.index)

    tops = {r["range"]: r["top"] for r in docs.select(place("doc_id").alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    ranges = sorted(tops)
    above = {tops[low]: high for low, high in zip(ranges, [*ranges[1:], ranges[0]] if ranges else [], strict=True)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(), side="right")
        return pd.Series([[int(r), above[i]] if i in above else [int(r)] for r, i in zip(own, ids.tolist(), strict=True)], index=ids.index)

    return docs.select("doc_id", value, places("doc_id").alias("places")).select("doc_id", value, F.posexplode("places").alias("guest", "range"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document.

    The edited text has the last floor(n/2) code points of the text's n replaced
    by as many of the first of the next document, in descending doc_id order and
    round from the last to the first.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(id_of(F.col("doc_id")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by_range = Window.partitionBy("range").orderBy("guest", F.desc("doc_id"), "tie")
    rows = with_next(docs).withColumn("tie", F.xxhash64("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(by_range)).select(
        "doc_id", "range", "guest", "tie", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"),
    )
    rows = rows.select("doc_id", "range", "guest", "tie", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(by_range)).where("guest = 0")
    return rows.select(
        id_back(F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        compare(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        compare(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
