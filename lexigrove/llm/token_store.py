"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with the ids (unsigned
32-bit little-endian) of some whole documents, then a skippable frame with the
document index, then the seek table of the public seekable format: for each
frame its compressed and decompressed size and the low 32 bits of the XXH64 of
its content, in a skippable frame that ends in the frame count, a flag byte and
a magic number. So any zstandard reader can decompress the whole file, and a
reader of this module decompresses only the frames of the documents it wants,
each checked against its own checksum.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id are kept, ordered by their text; a single very long document is one
frame; an empty table has no files and no rows; further columns are ignored; a
null doc_id comes before all others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.llm import _text
from lexigrove.llm._store import NULL_ID, bound_batches, filesystem, id_of, make_dir, new_path, write_whole

END_ID = 2
FRAME_BYTES = 1 << 20

# Fixed values of the public zstandard seekable format.
SKIPPABLE = 0x184D2A5E
INDEX_SKIPPABLE = 0x184D2A5D
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u4"), ("frame", "<u4"), ("offset", "<u8")])
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


class Encoder:
    """Whole texts to ids through the tokenizers library, each distinct piece of a text once.

    A text is cut only where the byte-level pre-tokenizer always cuts: before
    white space that follows other bytes, and between ASCII letters, digits and
    punctuation (not after an apostrophe). Pieces so made encode alike wherever they
    stand. Texts with white space beyond ASCII, or with a token that was added to the vocabulary, are encoded whole. What is
    remembered of a piece is found by a hash and used only if the bytes are the same.
    """

    SLOTS = 1 << 22
    POOL = 1 << 24
    JOINED = 512

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # a byte-level token has a character a byte
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.added = sorted({t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.joins = not any(any(c in x for c in b" \t\n\r\v\f") for x in self.added)
        self.kind = np.full(256, 4, dtype=np.uint8)
        self.kind[33:127] = 3
        self.kind[48:58] = 2
        self.kind[65:91] = self.kind[97:123] = 1
        self.kind[_text.IS_SPACE] = 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, dtype=np.uint64)
        self.start = np.zeros(self.SLOTS, dtype=np.int32)
        self.length = np.full(self.SLOTS, -1, dtype=np.int32)
        self.bytes_start = np.zeros(self.SLOTS, dtype=np.int64)
        self.bytes_length = np.zeros(self.SLOTS, dtype=np.int32)
        self.pool, self.bytes = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.uint8)
        self.used = self.bytes_used = 0

    @staticmethod
    def _room(pool: np.ndarray, used: int, more: int) -> np.ndarray:
        return pool if used + more <= len(pool) else np.concatenate([pool, np.zeros(max(len(pool), more), dtype=pool.dtype)])

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in the pool of the ids of each piece. Pieces that begin with a space and end with other bytes are encoded many to a call of the library, as each of them begins a token there."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        plain = np.fromiter((self.joins and x[:1] == b" " and not x[-1:].isspace() and x[-1] < 128 and not self._special(x) for x in texts), dtype=bool, count=len(texts))
        start, length = np.zeros(len(texts), dtype=np.int32), np.zeros(len(texts), dtype=np.int32)
        many, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        groups = [many[k : k + self.JOINED] for k in range(0, len(many), self.JOINED)] + [alone[k : k + 1] for k in range(len(alone))]
        got = self.tokenizer.encode_batch_fast([b"".join([texts[i] for i in g.tolist()]).decode() for g in groups], add_special_tokens=False)
        for g, one in zip(groups, got, strict=True):
            ids = np.array(one.ids, dtype=np.uint32)
            self.pool = self._room(self.pool, self.used, len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            if len(g) == 1:
                start[g], length[g] = self.used, len(ids)
            else:
                ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size[g]), side="left") + 1
                begins = np.concatenate([[0], ends[:-1]])
                start[g], length[g] = self.used + begins, ends - begins
            self.used += len(ids)
        return start, length

    def _special(self, text: bytes) -> bool:
        return any(x in text for x in self.added)

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(self.SLOTS - 1)
        return (key & low).astype(np.int64), (key >> np.uint64(32) & low).astype(np.int64)

    def _whole(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows that are not cut."""
        view, found = raw.tobytes(), [_rows_with_wide_space(raw, at)]
        for token in self.added:
            places, k = [], view.find(token)
            while k >= 0:
                places.append(k)
                k = view.find(token, k + 1)
            found.append(np.searchsorted(at, np.array(places, dtype=np.int64), side="right") - 1)
        return np.unique(np.concatenate(found))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        raw, at = _text.buffers(column)
        rows = len(at) - 1
        if self.used > self.POOL or self.bytes_used > 4 * self.POOL:
            self._clear()
        kind = self.kind[raw]
        cut = np.zeros(len(raw), dtype=bool)
        if len(raw) > 1:
            a, b = kind[:-1], kind[1:]
            cut[1:] = ((a != 0) & (b == 0)) | ((a != b) & (a > 0) & (a < 4) & (b > 0) & (b < 4) & ~((raw[:-1] == 39) & (b == 1)))
        for r in self._whole(raw, at):
            cut[at[r] : at[r + 1]] = False
        cut[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        size = ends - starts
        key = _text.span_hash(raw, starts, ends)
        one, two = self._slots(key)
        slot = np.where(self.keys[one] == key, one, two)
        found = (self.keys[slot] == key) & (self.length[slot] >= 0) & (self.bytes_length[slot] == size)
        hit = np.flatnonzero(found)
        found[hit] = _same_bytes(raw, starts[hit], self.bytes, self.bytes_start[slot[hit]], size[hit])
        p_start, p_length = self.start[slot].astype(np.int64), self.length[slot].astype(np.int64)
        if not found.all():
            miss = np.flatnonzero(~found)
            new, first, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            same = size[miss] == size[miss[first[inverse]]]
            alike = np.flatnonzero(same)
            same[alike] = _same_bytes(raw, starts[miss[alike]], raw, starts[miss[first[inverse[alike]]]], size[miss[alike]])
            other = np.flatnonzero(~same)  # pieces with the hash of another one
            view = raw.tobytes()
            s, n = self._library([view[starts[i] : ends[i]] for i in [*miss[first].tolist(), *miss[other].tolist()]])
            p_start[miss], p_length[miss] = s[inverse], n[inverse]
            p_start[miss[other]], p_length[miss[other]] = s[len(first) :], n[len(first) :]
            one, two = self._slots(new)
            put = np.where(self.length[one] < 0, one, two)
            self.length[put] = -1
            self.keys[put] = new  # of pieces with one slot the last stays
            own = np.flatnonzero(self.keys[put] == new)
            put, piece = put[own], miss[first[own]]
            self.start[put], self.length[put], self.bytes_length[put] = s[own], n[own], size[piece]
            more = int(size[piece].sum())
            self.bytes = self._room(self.bytes, self.bytes_used, more)
            self.bytes[self.bytes_used : self.bytes_used + more] = raw[_text.repeated(starts[piece], size[piece])]
            self.bytes_start[put] = self.bytes_used + np.cumsum(size[piece]) - size[piece]
            self.bytes_used += more
        ids = self.pool[_text.repeated(p_start, p_length)]
        row = np.searchsorted(at, starts, side="right") - 1
        counts = np.bincount(row, weights=p_length, minlength=rows).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _same_bytes(raw: np.ndarray, starts: np.ndarray, pool: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of two byte arrays, of one size each, are the same."""
    if not len(size):
        return np.zeros(0, dtype=bool)
    differ = raw[_text.repeated(starts, size)] != pool[_text.repeated(others, size)]
    return ~np.logical_or.reduceat(np.append(differ, False), np.cumsum(size) - size)


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One a worker process: what it has encoded serves the next task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _rows_with_wide_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with white space of more than one byte: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000."""
    if len(raw) < 3:
        two = np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0)))
        return np.unique(np.searchsorted(at, two, side="right") - 1)
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    lead = lead[lead < len(raw) - 1]
    a, b, c = raw[lead], raw[lead + 1], raw[np.minimum(lead + 2, len(raw) - 1)]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.unique(np.searchsorted(at, lead[hit], side="right") - 1)


class Writer:
    """Writes one file; documents come as (doc_id, ids)."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        data = ids.astype("<u4", copy=False).tobytes()
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((doc_id, len(ids), len(self.entries), self.size))
        self.open.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.size:
            plain = b"".join(self.open)
            packed = self.packer.compress(plain)
            self.out.write(packed)
            self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = self.packer.compress(np.array(self.index, dtype=INDEX).tobytes())
        self.out.write(struct.pack("<II", INDEX_SKIPPABLE, len(body)) + body)
        self.entries.append((8 + len(body), 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        table = np.array(self.entries, dtype=ENTRY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE))


class Reader:
    """Reads one file by its seek table; frames are fetched and decompressed one at a time, each at most once in a row."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, self.size - 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums")
        self.entries = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, self.size - 9 - count * ENTRY.itemsize), dtype=ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        body = self.file.read_at(int(self.entries["packed"][-1]) - 8, int(self.offsets[-2]) + 8)
        self._check(body, count - 1)
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpacker.decompress(body), dtype=INDEX)
        self.start = np.concatenate([[0], np.cumsum(self.index["n_tokens"].astype(np.int64))])
        self.held: tuple[int, bytes] = (-1, b"")
        self.decompressed = 0

    def _check(self, plain: bytes, k: int) -> None:
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.entries["checksum"][k]):
            raise ValueError(f"frame {k}: checksum differs")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            plain = self.unpacker.decompress(self.file.read_at(int(self.entries["packed"][k]), int(self.offsets[k])), max_output_size=int(self.entries["plain"][k]))
            self._check(plain, k)
            self.held = (k, plain)
            self.decompressed += 1
        return self.held[1]

    def ids(self, i: int) -> np.ndarray:
        """Of the i-th document of the file."""
        _, n, k, offset = self.index[i]
        return np.frombuffer(self.frame(int(k)), dtype="<u4", count=int(n), offset=int(offset)) if n else np.zeros(0, dtype="<u4")

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The requested documents that the file has; decompresses only their frames."""
        for wanted in sorted(set(doc_ids)):
            i = int(np.searchsorted(self.index["doc_id"], wanted))
            while i < len(self.index) and self.index["doc_id"][i] == wanted:
                yield wanted, self.ids(i)
                i += 1

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, docs_per_file: int = 4096) -> DataFrame:
    """Writes files in ascending doc_id order; returns the written manifest (part, file, docs, tokens, bytes, first_id, last_id, base), base being the ids of all files before.

    Files are ranges of doc_id, found by Spark from a sample, so none depends on
    the number of rows of a key; each is written under a name of its own attempt
    and renamed, so a task that runs again writes the same file anew.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.count()
    parts = max(1, -(-rows // docs_per_file))
    make_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = encoder_for(tokenizer)
        name = f"part-{part:06d}.ids.zst"
        tokens = documents = 0
        last_id = first_id = first.column("doc_id")[0].as_py()

        def fill(out) -> None:
            nonlocal tokens, documents, last_id
            writer = Writer(out)
            for batch in _joined(first, batches):
                for piece in _text.chunks(batch, "text"):
                    ids, at = encoder.encode(piece.column("text"))
                    for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        writer.add(doc_id, np.append(ids[a:b], np.uint32(end_id)))
                        tokens += b - a + 1
                        documents += 1
                        last_id = doc_id
            writer.close()

        size = write_whole(f"{path}/{name}", fill)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{path}/{name}"], "docs": [documents], "tokens": [tokens], "bytes": [size], "first_id": [first_id], "last_id": [last_id]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("docs", "tokens", "bytes", "first_id", "last_id"))]))

    texts = docs.select(id_of(F.col("doc_id")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    written = in_order.mapInArrow(write, "part int, file string, docs long, tokens long, bytes long, first_id long, last_id long")
    manifest = f"{path}/manifest.parquet"
    written.write.parquet(manifest)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return spark.read.schema(written.schema).parquet(manifest).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _joined(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and, if asked for, ids."""
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        schema.append(("ids", pa.list_(pa.int64())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = Reader(file)
                for a in range(0, len(reader.index), 512):
                    own = range(a, min(a + 512, len(reader.index)))
                    ids = [reader.ids(i) for i in own]
                    got = {"doc_id": [None if d == NULL_ID else d for d in reader.index["doc_id"][own.start : own.stop].tolist()], "start": base + reader.start[own.start : own.stop], "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                    if with_ids:
                        got["ids"] = [x.astype(np.int64) for x in ids]
                    yield pa.RecordBatch.from_pydict(got, schema=pa.schema(schema))
                reader.close()

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "part").mapInArrow(read, ddl)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """The ids of the requested documents, a list for each row of a doc_id, by ranged reads of their frames alone; only files whose range of doc_ids holds one of them are opened."""
    got: dict[int, list[list[int]]] = {}
    wanted = manifest.sparkSession.createDataFrame([(d,) for d in sorted(set(doc_ids))], "wanted long")
    files = manifest.join(F.broadcast(wanted), F.col("wanted").between(F.col("first_id"), F.col("last_id"))).groupBy("part", "file").agg(F.collect_list("wanted").alias("wanted")).orderBy("part")
    for row in files.toLocalIterator():
        reader = Reader(row["file"])
        for d, ids in reader.find(row["wanted"]):
            got.setdefault(d, []).append(ids.tolist())
        reader.close()
    return got


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_tokens(write_tokens(docs, new_path(spark, "tokens"), tokenizer))
