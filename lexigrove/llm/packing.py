"""Conflict-constrained best-fit packing.

Documents go into bins of CAPACITY words. A document longer than a bin fills whole bins of
its own, and its rest is packed like a short one. No bin holds two pieces of one
source or of one duplicate cluster: each bin carries a bitmap of its sources and one of its
clusters. Open bins are ordered by what is left of them; a piece, the longest
first, takes the compatible bin with the least room that holds it, the search
going on from one bin to its successor until a compatible one is found, and opens
a bin if there is none.

Documents are dealt into groups of GROUP by a permutation of global row
numbers, so no source, cluster or key can fill a group, and each group is
packed by itself in one task's bounded memory.

Defined cases: a null text and one without words take a piece of no words, which needs no room and
goes where it does not conflict; a null source conflicts with none; rows that
repeat a doc_id are packed each; clusters are near-duplicate classes with ``clustered``, and
equal texts where none are given; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm._store import keep
from lexigrove.llm.minhash import near_duplicates
from lexigrove.llm.mixing import n_words
from lexigrove.llm.sharding import numbered, permuted

CAPACITY = 4096
GROUP = 4096
PACKED = "doc_id long, piece int, n_words long, bin long, place long, source string"


class Bins:
    """The open bins of a group."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_room: list[tuple[int, int]] = []  # (room, bin), ascending

    def put(self, size: int, source_bit: int, cluster_bit: int) -> tuple[int, int]:
        """(bin, place in it)."""
        at = bisect_left(self.by_room, (size, -1))
        while at < len(self.by_room):
            b = self.by_room[at][1]
            if not (self.sources[b] & source_bit or self.clusters[b] & cluster_bit):
                del self.by_room[at]
                break
            at += 1
        else:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        place = self.capacity - self.left[b]
        self.left[b] -= size
        self.sources[b] |= source_bit
        self.clusters[b] |= cluster_bit
        insort(self.by_room, (self.left[b], b))
        return b, place


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, words, bin, place) of each piece of a group, in the rows' order."""
    bins, out, rests = Bins(capacity), [], []
    numbers: dict = {}
    clustered: dict = {}
    bits = [0 if s is None else 1 << numbers.setdefault(s, len(numbers)) for s in sources]
    for row, size in enumerate(sizes):
        whole = max(0, -(-size // capacity) - 1)
        rests.append((size - whole * capacity, row, whole))
    full = 0
    for rest, row, whole in sorted(rests, key=lambda r: (-r[0], r[1])):
        for piece in range(whole):
            full += 1
            out.append((row, piece, capacity, -full, 0))
        # clusters of one row conflict with nothing, so only repeated ones need a bit
        bit = 1 << clustered.setdefault(clusters[row], len(clustered)) if clusters[row] is not None else 0
        out.append((row, whole, rest, *bins.put(rest, bits[row], bit)))
    opened = len(bins.left)
    return sorted((r, p, n, b if b >= 0 else opened - b - 1, at) for r, p, n, b, at in out)


def clustered(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and cluster (near-duplicate class) of each document."""
    return keep(near_duplicates(docs, carried=["source"]).select("doc_id", "source", F.col("n_words").alias("size"), F.hex("class_key").alias("cluster")), "clusters")


def packed(docs: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, n_words, bin, place, source: a row a piece. Bins are numbered by group."""
    size = n_words(F.col("text")) if size is None else size
    cluster = F.md5(F.coalesce("text", F.lit("")).cast("binary")) if cluster is None else cluster
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), size.cast("long").alias("size"))
    rows, n = numbered(light, ["doc_id", "cluster", "source", "size"])  # near copies of one doc_id and source differ in size; what is equal in all is interchangeable
    rows = rows.withColumn("group", F.floor(permuted(F.col("number"), n) / group).cast("long"))

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("number", "ascending")])
        ids, sources = table.column("doc_id").to_pylist(), table.column("source").to_pylist()
        clusters = table.column("cluster").to_pylist()
        seen: dict = {}
        for c in clusters:
            seen[c] = seen.get(c, 0) + 1
        base = table.column("group")[0].as_py() << 32
        found = pack(table.column("size").to_pylist(), sources, [c if seen[c] > 1 else None for c in clusters], capacity)
        row, piece, words, b, place = (list(x) for x in zip(*found, strict=True))
        return pa.table({
            "doc_id": pa.array([ids[r] for r in row], pa.int64()), "piece": pa.array(piece, pa.int32()), "n_words": pa.array(words, pa.int64()),
            "bin": pa.array([base + x for x in b], pa.int64()), "place": pa.array(place, pa.int64()), "source": pa.array([sources[r] for r in row], pa.string()),
        })

    return rows.select("doc_id", "source", "cluster", "size", "number", "group").groupBy("group").applyInArrow(each, PACKED)
