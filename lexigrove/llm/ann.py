"""Maximum inner product search by score-aware quantisation.

Vectors are cut into pairs of components, each coded in four bits. Codebooks and
codes minimise an anisotropic loss, ||r||^2 + (eta - 1)(r.u)^2 with r the residual
and u the direction of the vector, which penalises the part of the error that
is parallel to the vector and so changes the largest inner products. A part of the rows, PART_BYTES at most, is
held by one task, which reads the queries once, block by block. For each block of queries, blocks of ROWS rows are
scanned by table lookups, two codes a byte, the best RERANK of a block are scored exactly on the original vectors in
double precision, and the best ``k`` of all blocks of the part are merged before anything is shuffled.

Codebooks are fitted on a bounded sample (SAMPLE rows of lowest hash); every
valid row is coded and searched. Queries are written to the shared folder in
blocks, and each task reads them for its own rows, so neither is
broadcast or collected and the rows are not copied.

Defined cases: vectors that are null, empty, zero, or hold nulls, NaN or infinite
components take no part, nor do vectors of another length than the most common
one (ties: the longer); equal scores go to the smaller vec_id; rows that repeat a
vec_id are candidates each, and a query's own vec_id is never one; a null vec_id is a candidate like others, below all other ids, and no query; a repeated query id gets one result, for the
copy of lowest hash; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm._store import filesystem, id_back, id_of, new_path

SAMPLE = 8192
CENTRES = 16
THRESHOLD = 0.2
RERANK = 256
ROWS = 8192
PART_ROWS = 1 << 16
PART_BYTES = 1 << 26
QUERIES = 512


def eta_of(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel error for unit vectors and a score threshold."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Codebook:
    """Anisotropic product quantiser: centres of shape (pairs, 16, 2)."""

    def __init__(self, centres: np.ndarray, dim: int, eta: float):
        self.centres, self.dim, self.eta = centres, dim, eta

    @staticmethod
    def _pairs(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 4, seed: int = 7) -> Codebook:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        x = cls._pairs(sample.astype(np.float64))
        n, pairs, _ = x.shape
        centres = np.stack([x[rng.choice(n, CENTRES, replace=n < CENTRES), m] for m in range(pairs)])
        for _ in range(rounds):  # plain k-means first
            for m in range(pairs):
                near = ((x[:, m, None] - centres[m]) ** 2).sum(2).argmin(1)
                count = np.bincount(near, minlength=CENTRES)[:, None]
                total = np.stack([np.bincount(near, x[:, m, d], CENTRES) for d in (0, 1)], axis=1)
                centres[m] = np.where(count > 0, total / np.maximum(count, 1), centres[m])
        book = cls(centres, dim, eta_of(dim))
        u = x / np.linalg.norm(x.reshape(n, -1), axis=1)[:, None, None]
        codes = book._codes(x, u)
        for _ in range(rounds):
            error = x - centres[np.arange(pairs), codes]
            parallel = (error * u).sum((1, 2))
            for m in range(pairs):
                rest = parallel - (error[:, m] * u[:, m]).sum(1)
                left = np.eye(2) + (book.eta - 1) * u[:, m, :, None] * u[:, m, None, :]
                right = x[:, m] + (book.eta - 1) * u[:, m] * (rest + (x[:, m] * u[:, m]).sum(1))[:, None]
                for c in np.unique(codes[:, m]):
                    own = codes[:, m] == c
                    centres[m, c] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
                error[:, m] = x[:, m] - centres[m, codes[:, m]]
                parallel = rest + (error[:, m] * u[:, m]).sum(1)
            codes = book._codes(x, u, codes)
        return book

    def _codes(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent on the anisotropic loss, from the nearest centres."""
        pairs = x.shape[1]
        if codes is None:
            codes = np.stack([((x[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(pairs)], axis=1)
        error = x - self.centres[np.arange(pairs), codes]
        parallel = (error * u).sum((1, 2))
        for _ in range(sweeps):
            for m in range(pairs):
                rest = parallel - (error[:, m] * u[:, m]).sum(1)
                each = x[:, m, None] - self.centres[m]
                along = rest[:, None] + (each * u[:, m, None]).sum(2)
                codes[:, m] = ((each**2).sum(2) + (self.eta - 1) * along**2).argmin(1)
                error[:, m] = x[:, m] - self.centres[m, codes[:, m]]
                parallel = rest + (error[:, m] * u[:, m]).sum(1)
        return codes

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two codes a byte: (rows, ceil(pairs / 2))."""
        x = self._pairs(vectors.astype(np.float64))
        u = x / np.linalg.norm(x.reshape(len(x), -1), axis=1)[:, None, None]
        codes = self._codes(x, u).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): the part of the inner product that each byte stands for."""
        q = self._pairs(queries.astype(np.float64))
        each = np.einsum("qmd,mcd->qmc", q, self.centres)
        each = np.pad(each, ((0, 0), (0, each.shape[1] % 2), (0, 0)))
        return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows)."""
    out = np.zeros((len(tables), len(codes)), dtype=np.float32)
    for b in range(codes.shape[1]):
        out += tables[:, b].take(codes[:, b], axis=1)
    return out


def _best(queries: np.ndarray, query_ids: np.ndarray, tables: np.ndarray, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """(row ids, exact scores) of the best k rows of a block for each query, -inf where there are fewer; its own id is left out."""
    near = scan(tables, codes)
    own = query_ids[:, None] == ids[None]
    near[own] = -np.inf
    keep = min(max(rerank, k), len(ids))
    chosen = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
    exact = np.einsum("qcd,qd->qc", rows[chosen].astype(np.float64), queries.astype(np.float64))
    exact[np.take_along_axis(own, chosen, 1)] = -np.inf
    return _first(ids[chosen], exact, k)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of all rows but the query's own."""
    spark = vectors.sparkSession
    asks = F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()
    valid = vectors.select(id_of(F.col("vec_id")).alias("vec_id"), "embedding", asks.alias("asks")).where(_valid(F.col("embedding")))
    lengths = valid.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["dim"]
    total = lengths[0]["n"]
    valid = valid.where(F.size("embedding") == dim)
    hashed = F.xxhash64("vec_id", "embedding")
    fitted = valid.select("embedding", hashed.alias("h")).orderBy("h").limit(sample).select("embedding").toArrow()
    book = Codebook.fit(_matrix(fitted.column(0).combine_chunks()))

    path = new_path(spark, "queries")
    first = Window.partitionBy("vec_id").orderBy("h")
    asked = valid.where("asks").select("vec_id", "embedding", hashed.alias("h")).withColumn("n", F.row_number().over(first)).where("n = 1").select("vec_id", "embedding")
    asked.write.option("maxRecordsPerFile", 1 << 16).parquet(path)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _part(pa.Table.from_batches(held), path, book, k, rerank)

    # as many parts as there are cores for small tables, and no part of more than is held in memory
    whole = max(ROWS, min(PART_ROWS, PART_BYTES // (4 * dim)))
    parts = max(-(-total // whole), min(spark.sparkContext.defaultParallelism, -(-total // (ROWS // 2))), 1)
    found = valid.select("vec_id", "embedding").repartition(parts).mapInArrow(look, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), id_back(F.col("vec_id")).alias("vec_id"), "score")


def _part(table: pa.Table, path: str, book: Codebook, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of a part for each query."""
    ids = table.column("vec_id").to_numpy()
    rows = _matrix(table.column("embedding").combine_chunks())
    blocks = [slice(a, a + ROWS) for a in range(0, len(ids), ROWS)]
    codes = [book.encode(rows[b]) for b in blocks]
    store, folder = filesystem(path)
    for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
        if not info.path.endswith(".parquet"):
            continue
        with pq.ParquetFile(info.path, filesystem=store) as f:
            for batch in f.iter_batches(QUERIES):
                if not batch.num_rows:
                    continue
                queries, query_ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
                tables = book.tables(queries)
                got = [_best(queries, query_ids, tables, rows[b], ids[b], c, k, rerank) for b, c in zip(blocks, codes, strict=True)]
                near, score = _first(np.hstack([i for i, _ in got]), np.hstack([s for _, s in got]), k)
                good = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, near.shape[1]).reshape(near.shape)[good]), pa.array(near[good]), pa.array(score[good])], ["query_id", "vec_id", "score"])
