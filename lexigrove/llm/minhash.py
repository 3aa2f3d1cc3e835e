"""Near-duplicate classes by ProbMinHash.

A text's shingles (runs of five words) weigh 1 + ln(occurrences), so that a line
repeated many times does not outweigh the rest of a text. Each
shingle makes arrivals of a Poisson process at the rate of its weight, each arrival goes to
one of K registers, a register keeps its earliest arrival, and a shingle stops
as soon as its next arrival is later than all registers. The share of
equal registers of two texts estimates their probability Jaccard similarity. A second
set of registers, of unit weights, estimates the plain Jaccard of the shingle sets; it
is the same for a text that repeats no shingle.
BANDS bands of ROWS registers of each set give candidates, which are verified on the whole
shingle sets: two texts are linked if their probability Jaccard, or the plain
Jaccard of their shingle sets, is LEAST or more.

Classes are the connected components of links. Equal texts are one vertex. In
a bucket, all members are first verified against one of them; then every link between members
of a bucket that lie in different components is looked for, whatever the bucket's size. A pair of LEAST has
at least that share of either text's weight in common, so if each text's shingles are put in one order, the first ones, as
many as leave less than that share, have one in common. Members are dealt by these first shingles, rare ones being first, and
those that share none with another component have no link to it. The others, and all members of a bucket of BLOCK or fewer, are compared on their whole
shingle sets, by bucket or, if it has more than WIDE of them outside its largest component, by each first shingle, of all such buckets at once,
which finds the same links and may find one of texts that share no band. So there is a row for each first shingle of a text, but none for those in each of its buckets. Comparisons are dealt into blocks of bounded size, and members of the largest
component are not compared with each other. A group of blocks
returns only the links that join its parts, so links between texts of one class need not be listed,
and no bucket is cut short or compared in one task. Only a pair that shares no band may go uncompared: of
similarity 0.8, with probability 5e-5. Links of up to FEW_EDGES edges are joined in one task, more of them in rounds.

Defined cases: a null text is an empty text; a text of fewer than five words is
one shingle; texts without words share a class with equal texts only; rows that
repeat a doc_id are rows of their own; an empty table gives no rows; further
columns are ignored; a null doc_id is below all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm import _text
from lexigrove.llm._store import bound_batches, forget, id_back, id_of, keep

SHINGLE = 5
LEAST = 0.8
BANDS = 25
ROWS = 5
K = BANDS * ROWS
#: An empty register: an infinite time.
NEVER = np.uint64(0x7F800000FFFFFFFF)
#: Over four standard errors of the registers' estimate under LEAST. It tells what registers are good for; no pair is dropped by it.
FLOOR = 0.65
BLOCK = 256
#: Members to be compared outside the largest component above which a bucket is dealt by first shingles; the links are the same.
WIDE = 8 * BLOCK
#: Texts on which the order of shingles is fitted, and frequent shingles that it knows. Any order finds all links.
ORDER_TEXTS = 1 << 12
ORDER_SHINGLES = 1 << 17
#: Shingles that are compared at once.
COLUMNS = 1 << 12
#: Written tables have a file for so many documents or edges at most, so that small tables are not split into very many files.
FILE_DOCS = 1 << 12
FILE_EDGES = 1 << 17
#: Edges whose components one task finds, in some 30 MB; those of more are found in rounds. The components are the same.
FEW_EDGES = 1 << 16
#: Small buckets of about so many documents are compared in one task's group.
PACK_DOCS = 1 << 11
#: Bits of a hash by which rows that cannot have a partner are left out before a join. Any number gives the same rows.
MARK_BITS = 24
#: A text with this many copies or more, or this share of all rows, is joined by broadcast; there are at most 1 / HEAVY_SHARE such texts.
HEAVY_SHARE = 1e-4
HEAVY = 1000


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def weighted(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), rows and in each row shingles ascending, each once."""
    row, shingle = _text.shingles(raw, at, size)
    if not len(row):
        return row, shingle, row
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.append(True, (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1]))
    first = np.flatnonzero(new)
    return row[first], shingle[first], np.diff(np.append(first, len(row)))


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def counted(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), each once, in the order of the rows."""
    both = _text.mix(shingle ^ _text.mix(np.arange(1, row.max(initial=0) + 2, dtype=np.uint64))[row])
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else order
    count = np.zeros(len(row), dtype=np.int64)
    count[order[first]] = np.diff(np.append(first, len(row)))
    own = np.flatnonzero(count)
    return row[own], shingle[own], count[own]


def registers(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """(rows, k) uint32: the low bits of the element whose arrival each register keeps; rows without elements are zero.

    A register is one number, the arrival's time above and the element below, so the earliest is the least.
    """
    kept = np.full(rows * k, NEVER, dtype=np.uint64)
    low = element & np.uint64(0xFFFFFFFF)
    time, step = np.zeros(len(row)), 0
    while len(row):
        many = 1 if len(row) > 1 << 12 else 16  # few elements take several arrivals at once
        salt = np.arange(step, step + many, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)
        draw = _text.mix(element[:, None] + salt)
        at = -np.log(((draw >> np.uint64(24)).astype(np.float64) + 1) * 2.0**-40) / weight[:, None]
        at[:, 0] += time
        at = np.cumsum(at, axis=1)
        slot = (row * k)[:, None] + ((draw & np.uint64(0xFFFFFF)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(kept, slot.ravel(), (at.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | low[:, None]).ravel())
        last = (kept.reshape(rows, k).max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
        live = np.flatnonzero(at[:, -1] < last[row])
        row, element, weight, low, time = row[live], element[live], weight[live], low[live], at[live, -1]
        step += many
    return np.where(kept == NEVER, np.uint64(0), kept).astype(np.uint32).reshape(rows, k)


def both_registers(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers by weight, those by unit weights, and which rows repeat an element; the two are equal in all other rows."""
    kept = registers(row, element, weights(count), rows, k)
    repeats = np.bincount(row[count > 1], minlength=rows) > 0
    plain = kept.copy()
    some = repeats[row]
    plain[repeats] = registers((np.cumsum(repeats) - 1)[row[some]], element[some], np.ones(int(some.sum())), int(repeats.sum()), k)
    return kept, plain, repeats


def band_keys(kept: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) int64."""
    parts = kept.astype(np.uint64).reshape(len(kept), bands, kept.shape[1] // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for r in range(parts.shape[2]):
        out = _text.mix(out + parts[:, :, r] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out.view(np.int64)


def similarity(a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray) -> float:
    """The larger of probability Jaccard of weights and Jaccard of sets; shingles ascending, each once."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a) + len(b) - len(common))
    if a_count.max() == 1 and b_count.max() == 1:
        return plain
    if (len(a), a.tobytes(), a_count.tobytes()) > (len(b), b.tobytes(), b_count.tobytes()):  # one order of sums, so that rounding does not tell which text is first
        a, a_count, b, b_count = b, b_count, a, a_count
    a_count, b_count = weights(a_count), weights(b_count)
    # sum over the common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d), by the order of a_e / b_e
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = a_count, b_count
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(y))
    own = np.flatnonzero((x > 0) & (y > 0))
    cut = np.searchsorted(ratio, ratio[own], side="left")
    return max(plain, float((1 / (above[cut] / x[own] + below[cut] / y[own])).sum()))


def _signed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(doc_id, key, n_words, bands) and the carried columns in a struct: the buckets of both weightings, null for texts without words."""
    schema = {"bands": pa.list_(pa.int64()), "n_words": pa.int64()}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                rows = part.num_rows
                raw, at = _text.buffers(part.column("text"))
                words = _text.spans(raw, at)
                row, shingle, count = counted(*_text.shingles(raw, at, SHINGLE, words))
                kept, plain, repeats = both_registers(row, shingle, count, rows)
                some = np.bincount(row, minlength=rows) > 0
                bands = list(band_keys(kept))
                more = np.flatnonzero(repeats)
                for i, x in zip(more.tolist(), band_keys(plain[more]), strict=True):
                    bands[i] = np.union1d(bands[i], x)
                made = [
                    [x if s else None for x, s in zip(bands, some, strict=True)],
                    np.bincount(words[2], minlength=rows),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "carried")), *(pa.array(x, t) for x, t in zip(made, schema.values(), strict=True))], ["doc_id", "key", "carried", *schema])

    rows = docs.select(id_of(F.col("doc_id")).alias("doc_id"), text_key(F.col("text")).alias("key"), F.struct(F.lit(0).cast("byte").alias("_"), *carried).alias("carried"), F.coalesce("text", F.lit("")).alias("text"))
    to = rows.select("doc_id", "key", "carried").schema.add("bands", T.ArrayType(T.LongType())).add("n_words", "long")
    return rows.mapInArrow(sign, to)


def _likely(rows: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``by`` may be in ``wanted`` (by), before a join that tells: all that are, and those whose hash of MARK_BITS is that of one. What is broadcast is 2^(MARK_BITS - 3) bytes at most."""
    mark = F.shiftrightunsigned(F.xxhash64(by), 64 - MARK_BITS)
    words = wanted.select(mark.alias("mark")).groupBy(F.shiftright("mark", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 AS int))")).alias("bits"))
    words = words.groupBy(F.shiftright("word", 6).alias("high")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("word & 63").alias("low"), "bits"))).alias("bits"))
    marks = words.select("high", F.expr("transform(sequence(0L, 63L), k -> coalesce(bits[k], 0L))").alias("words"))
    found = rows.withColumn("mark", mark).withColumn("high", F.shiftright("mark", 12)).join(F.broadcast(marks), "high")
    return found.where("getbit(words[cast(shiftright(mark, 6) & 63 AS int)], cast(mark & 63 AS int)) = 1").select(*rows.columns)


def _shingled(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """(key, shingles, counts) of the texts of ``owners`` (key, doc_id), each key once, as bytes; counts are empty if all are 1."""
    schema = pa.schema([("key", pa.binary()), ("shingles", pa.binary()), ("counts", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                row, shingle, count = weighted(*_text.buffers(part.column("text")))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), pa.array([shingle[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([count[a:b].astype(np.uint32).tobytes() if (count[a:b] > 1).any() else b"" for a, b in spans], pa.binary()),
                ], schema=schema)

    rows = docs.select(id_of(F.col("doc_id")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
    rows = _likely(rows, "key", owners).join(owners, ["doc_id", "key"]).select("key", "text")  # a semi join would be pushed below the filter
    return rows.mapInArrow(make, "key binary, shingles binary, counts binary").dropDuplicates(["key"])


def _counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint32) if data else np.ones(n, dtype=np.uint32)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose similarity is ``least`` or more."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            a_s, a_c, b_s, b_c = (batch.column(n).to_pylist() for n in ("a_shingles", "a_counts", "b_shingles", "b_counts"))
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a_s[i], dtype=np.uint64), np.frombuffer(b_s[i], dtype=np.uint64)
                linked.append(similarity(x, _counts(a_c[i], len(x)), y, _counts(b_c[i], len(y))) >= least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], schema=schema)

    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("a_shingles"), F.col("counts").alias("a_counts"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("b_shingles"), F.col("counts").alias("b_counts"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_shingles", "a_counts", "b_shingles", "b_counts").mapInArrow(verify, "a binary, b binary")


def root(up: dict[bytes, bytes], x: bytes) -> bytes:
    """The root of x in a forest, whose paths get shorter."""
    while (above := up.get(x, x)) != x:
        up[x] = up.get(above, above)
        x = above
    return x


def _joined(edges: DataFrame) -> DataFrame:
    """(key, component) of the vertices of up to FEW_EDGES edges, in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((root(up, a), root(up, b)))
                up[high] = up[low] = low
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([root(up, x) for x in list(up)], pa.binary())], ["key", "component"])

    return edges.coalesce(1).mapInArrow(join, "key binary, component binary")


def components(edges: DataFrame, files: int, rounds: int = 60) -> DataFrame:
    """(key, component) of all vertices of the edges (a, b), component being the smallest key of it: in one task if there are few, else by rounds of large-star and small-star until nothing moves. Each round is a written table, of few files if it has few edges; only counts and sums come to the driver."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            around = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
            return around.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        moved = e.join(low, "a")
        return moved.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files), "edges")
    before = state(now)
    if before[0] <= FEW_EDGES:
        found = keep(_joined(now), "components")
        forget(now)
        return found
    for _ in range(rounds):
        files = max(1, -(-before[0] // FILE_EDGES))  # neither star has more edges than it is given
        half = keep(star(now, True).coalesce(files), "star")
        last, now = now, keep(star(half, False).coalesce(files), "star")
        forget(last, half)
        after = state(now)
        if after == before:
            found = keep(now.select(F.col("a").alias("key"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct()).coalesce(files), "components")
            forget(now)
            return found
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def agreement(kept: np.ndarray, plain: np.ndarray, repeats: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of rows (p, q) the larger share of equal registers of the two weightings, and (pairs, BANDS) whether they have a bucket of that band in common."""
    same = kept[p] == kept[q]
    near, shared = same.mean(axis=(1, 2)), same.all(axis=2)
    some = np.flatnonzero(repeats[p] | repeats[q])
    if len(some):
        x, y = p[some], q[some]
        same = plain[x] == plain[y]
        near[some] = np.maximum(near[some], same.mean(axis=(1, 2)))
        # a bucket does not tell of which weighting a band is
        shared[some] |= same.all(axis=2) | (plain[x] == kept[y]).all(axis=2) | (kept[x] == plain[y]).all(axis=2)
    return near, shared


def _dealt(members: DataFrame, by: str, packs: int) -> DataFrame:
    """The members of those ``by`` that have several components, with pack, x and y, the group in which a row is compared.

    All of a small one are in one group, and many small ones in one pack. Of a larger one, the
    members of the largest component are dealt into blocks of about BLOCK and the others into blocks of their own;
    each block of others meets each block of the largest and each block of others, so a row of a few others
    is copied as often as there are blocks, and nothing else is.
    """
    counts = members.groupBy(by, "component").agg(F.count("*").alias("n")).groupBy(by).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).where(F.col("n") > F.col("top.n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = counts.select(by, F.col("top.component").alias("top"), (F.col("n") <= BLOCK).alias("small"), blocks(F.col("top.n")).alias("majors"), blocks(F.col("n") - F.col("top.n")).alias("minors"))
    rows = members.join(counts, by).withColumn("minor", F.col("component") != F.col("top"))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    own = F.col("block")
    places = F.when(F.col("small"), F.array(place(F.lit(0), F.lit(0)))).when(~F.col("minor"), F.transform(to("minors"), lambda y: place(own, y)))
    with_others = F.filter(F.transform(to("minors"), lambda z: place(-1 - F.least(own, z), F.greatest(own, z))), lambda g: g["y"] != -1 - g["x"])
    places = places.otherwise(F.concat(F.transform(to("majors"), lambda x: place(x, own)), with_others))
    rows = rows.withColumn("block", block).withColumn("place", F.explode(places))
    pack = F.when(F.col("small"), F.pmod(F.xxhash64(by), F.lit(packs))).otherwise(F.col(by))
    return rows.withColumns({"pack": pack, "x": F.col("place.x"), "y": F.col("place.y")}).drop("place", "block", "minor", "top", "small", "majors", "minors")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and of how many."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("shingles").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, dtype=np.int64))], ["shingle"])

    share = max(1, sets.count() // ORDER_TEXTS)
    some = sets.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(share)) == 0).select("shingles").mapInArrow(each, "shingle long")
    top = some.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    shingle, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def first_shingles(shingle: np.ndarray, count: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first of a text's shingles, ascending and each once, in the order of how frequent they are: as many as leave less than ``least`` of the set and of its weight."""
    known, often = frequent
    n = np.zeros(len(shingle), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
        n = np.where(known[at] == shingle, often[at], 0)
    order = np.lexsort((shingle, n))
    weight = weights(count[order])
    left = np.maximum(1 - np.arange(1, len(shingle) + 1) / len(shingle), 1 - np.cumsum(weight) / weight.sum())
    return shingle[order[: int((left >= least - 1e-9).sum()) + 1]]


def _firsts(sets: DataFrame, least: float) -> DataFrame:
    """The first shingles of each text, a row each with its key and component."""
    frequent = _frequent(sets)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, counts in zip(batch.column("shingles").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                shingle = np.frombuffer(data, dtype=np.uint64)
                out.append(first_shingles(shingle, _counts(counts, len(shingle)), frequent, least).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("component"), pa.array(out, pa.list_(pa.int64()))], ["key", "component", "firsts"])

    return sets.mapInArrow(make, "key binary, component binary, firsts array<long>").select("key", "component", F.explode("firsts").alias("first"))


def _mixed(rows: DataFrame, by: str) -> DataFrame:
    """Those ``by`` that have rows of several components; of these two fixed hashes are compared, as numbers are aggregated by hash."""
    hashes = [F.xxhash64("component"), F.xxhash64("component", F.lit(1))]
    several = rows.groupBy(by).agg(*(f(h).alias(f"{name}{k}") for k, h in enumerate(hashes) for name, f in (("low", F.min), ("high", F.max))))
    return several.where("low0 != high0 OR low1 != high1").select(by)


def may_link(shingles: list[np.ndarray], counts: list[np.ndarray], least: float) -> np.ndarray:
    """(rows, rows) which pairs may be of similarity ``least``: by the Jaccard of the sets, and where a row repeats a shingle by an upper bound of the other, the weight of what is common as a share of either text's."""
    rows, size = len(shingles), np.array([len(x) for x in shingles])
    repeats = np.array([bool((c > 1).any()) for c in counts])
    row = np.repeat(np.arange(rows), size)
    _, column, often = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    share = np.concatenate([weights(c) / weights(c).sum() for c in counts])
    own = np.flatnonzero(often[column] > 1)
    own = own[np.argsort(column[own], kind="stable")]
    row, column, share = row[own], (np.cumsum(often > 1) - 1)[column[own]], share[own]
    common, mass = np.zeros((rows, rows)), np.zeros((rows, rows))
    a = 0
    while a < len(column):
        first = column[a]
        b = int(np.searchsorted(column, first + COLUMNS))
        width = int(column[b - 1] - first) + 1
        one = np.zeros((rows, width), dtype=np.float32)
        one[row[a:b], column[a:b] - first] = 1
        common += one @ one.T
        if repeats.any():
            part = np.zeros_like(one)
            part[row[a:b], column[a:b] - first] = share[a:b]
            mass += part @ one.T
        a = b
    near = common >= (least - 1e-6) * (size[:, None] + size - common)
    return near | (np.minimum(mass, mass.T) >= least - 1e-3) & (repeats[:, None] | repeats)


def _residual(members: DataFrame, sets: DataFrame, least: float, packs: int) -> DataFrame:
    """Links (a, b) between components, of texts in one bucket, as many as join what they join.

    The members of a bucket of up to BLOCK, which is one group anyway, are all compared. Of larger ones, members that share a first
    shingle with one of another component, be it of another bucket, are found, and only they are compared: by bucket or, if more
    than WIDE of them are outside its largest component, by first shingle. No link of a bucket is lost by this.
    """
    files = max(1, packs // 2)
    rows = keep(members.join(_mixed(members, "bucket"), "bucket", "left_semi").select("bucket", "key", "component").coalesce(files), "mixed")
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket")
    many = keep(rows.join(large, "bucket", "left_semi").coalesce(files), "many")
    texts = many.select("key", "component").distinct()
    firsts = keep(_firsts(sets.join(texts, "key"), least).coalesce(files), "firsts")
    shared = keep(firsts.join(_mixed(firsts, "first"), "first", "left_semi").select("key", "component", "first").coalesce(files), "shared")
    found = keep(many.join(shared, "key", "left_semi").coalesce(files), "found")

    wide = found.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg((F.sum("n") - F.max("n")).alias("others")).where(F.col("others") > WIDE).select("bucket")
    broad = found.join(wide, "bucket", "left_semi").select("key")
    by_first = shared.join(broad, "key", "left_semi").select(F.xxhash64("first").alias("by"), "key", "component")
    dealt = keep(found.join(wide, "bucket", "left_anti").select(F.col("bucket").alias("by"), "key", "component").unionByName(by_first).coalesce(files), "dealt")
    small = rows.join(large, "bucket", "left_anti").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "component"))).alias("members"))
    small = small.groupBy("members").agg(F.min("bucket").alias("by")).select("by", F.inline("members"))  # of buckets with the same members one is compared
    small = small.withColumns({"pack": F.pmod(F.xxhash64("by"), F.lit(packs)), "x": F.lit(0), "y": F.lit(0)})

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("by").combine_chunks()
        data, counts, names = (table.column(n).to_pylist() for n in ("shingles", "counts", "component"))
        value, code = table.column("by").to_numpy(), np.unique(np.array(names, dtype=object), return_inverse=True)[1]
        up: dict = {}
        a, b = [], []
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(value)], strict=True):
            if len({root(up, x) for x in names[i:j]}) == 1:
                continue
            shingles = [np.frombuffer(x, dtype=np.uint64) for x in data[i:j]]
            often = [_counts(x, len(y)) for x, y in zip(counts[i:j], shingles, strict=True)]
            near = np.triu(may_link(shingles, often, least), 1) & (code[i:j, None] != code[i:j])
            for p, q in np.argwhere(near).tolist():
                x, y = root(up, names[i + p]), root(up, names[i + q])
                if x != y and similarity(shingles[p], often[p], shingles[q], often[q]) >= least:
                    up[x] = y
                    a.append(max(names[i + p], names[i + q]))
                    b.append(min(names[i + p], names[i + q]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    few = _dealt(dealt, "by", packs).unionByName(small).join(sets, "key").select("by", "component", "shingles", "counts", "pack", "x", "y")
    links = keep(few.groupBy("pack", "x", "y").applyInArrow(compare, "a binary, b binary").distinct().coalesce(files), "links")
    forget(rows, many, firsts, shared, found, dealt)
    return links


def near_duplicates(docs: DataFrame, least: float = LEAST, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), n_words, key (of its text) and class_key of each document, and the columns to be carried along, which have other names."""
    bound_batches(docs.sparkSession)
    signed = keep(_signed(docs, list(carried)), "signed")
    rows = signed.count()
    files = max(1, -(-rows // FILE_DOCS))
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    texts = keep(texts.withColumn("rank", F.xxhash64("key")).coalesce(files), "texts")
    placed = texts.where("bands is not null").select("key", "rank", F.explode("bands").alias("bucket"))
    # ranks are numbers of fixed size, so that they are aggregated by hash; should two texts have one rank, both are pivots
    pivots = keep(placed.groupBy("bucket").agg(F.min("rank").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot").coalesce(files), "pivots")
    members = keep(_likely(placed, "bucket", pivots).join(pivots, "bucket").select("bucket", "key", "rank", "pivot").coalesce(files), "members")
    pairs = members.where("rank != pivot").select(F.col("key").alias("a"), "pivot").distinct()
    pairs = pairs.join(texts.select(F.col("rank").alias("pivot"), F.col("key").alias("b")), "pivot").select("a", "b")
    wanted = members.select("key").distinct()
    owners = keep(texts.join(wanted, "key", "left_semi").select("doc_id", "key").coalesce(files), "owners")
    sets = keep(_shingled(docs, owners).coalesce(files), "sets")
    first = components(_verified(pairs, sets, least), files)
    known = members.join(first, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    links = _residual(known, sets, least, max(1, rows // PACK_DOCS))
    joined = components(links, files)

    classes = texts.select("key", "doc_id", "copies").join(first, "key", "left").withColumn("component", F.coalesce("component", "key"))
    classes = classes.join(joined.select(F.col("key").alias("component"), F.col("component").alias("whole")), "component", "left").withColumn("class_key", F.coalesce("whole", "component"))
    lowest = classes.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    classes = keep(classes.join(lowest, "class_key").select("key", "class_key", "class_id", "copies").coalesce(files), "classes")
    forget(texts, pivots, members, owners, sets, first, links, joined)
    # a text of very many copies is joined by broadcast: there are at most 1 / HEAVY_SHARE of them
    heavy_from = max(HEAVY, int(rows * HEAVY_SHARE))
    heavy = classes.where(F.col("copies") >= heavy_from).select("key", F.col("class_key").alias("h_class_key"), F.col("class_id").alias("h_class_id"))
    own = ["doc_id", "key", "n_words", "carried"]
    dealt = signed.select(*own).join(F.broadcast(heavy), "key", "left")
    light = dealt.where("h_class_key is null").select(*own).join(classes.where(F.col("copies") < heavy_from).drop("copies"), "key")
    every = light.select(*own, "class_id", "class_key").unionByName(dealt.where("h_class_key is not null").select(*own, F.col("h_class_id").alias("class_id"), F.col("h_class_key").alias("class_key")))
    every = every.select("doc_id", "class_id", "n_words", "key", "class_key", *(F.col("carried")[c].alias(c) for c in carried))
    return every.coalesce(files).withColumns({c: id_back(F.col(c)) for c in ("doc_id", "class_id")})


def without_near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class stays, that of the smallest doc_id, then of the smallest text key, then of the smallest hash of its other columns (maps do not count); all columns as they were."""
    found = near_duplicates(docs, least)
    best = found.groupBy("class_key").agg(F.min(F.struct(id_of(F.col("doc_id")).alias("doc_id"), "key")).alias("best")).select(F.col("best.doc_id").alias("id"), F.col("best.key").alias("key"))
    counted = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_of(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("key"), F.xxhash64(*counted).alias("order"))
    rows = rows.join(best, ["id", "key"])
    return rows.groupBy("id", "key").agg(F.min_by("row", "order").alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
