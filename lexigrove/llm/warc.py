"""WARC archives with a two-level capture index.

Pages are written as gzip members, one a record, into one archive a task. Of
pages with equal payloads the one with the smallest page_id is a response record and
the others are revisit records that refer to it and hold no payload. Captures
are then sorted by reversed-host URL key and page_id into index files of
independently compressed blocks of BLOCK lines. Each file ends in the sparse directory of its blocks, their
first keys and byte ranges, and a written table has the first key of each file, a row for some
FILE_BLOCKS * BLOCK captures. A lookup searches the table and then the file's directory
by bisection, reads the byte range of the block, and then the byte ranges of the records. The query reads the
archives back by such lookups of all its pages' keys, in order, so that neighbours share a block.

Archive tasks sort their rows by page_id, so a task that is run twice
writes the same bytes; files get their name by a rename.

Defined cases: null html is an empty payload, and all empty payloads are equal; a
null url is the empty key; a null page_id sorts before all others; rows that
repeat page_id and payload are each written, all as response if theirs is the
smallest page_id of the payload, and the names of their records are told apart by a number (a revisit refers to the first); an empty table gives no archives and no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm._store import NULL_ID, bound_batches, filesystem, id_of, make_dir, new_path, write_whole

BLOCK = 1000
FILE_BLOCKS = 64
#: Pages whose records are read at once.
LOOKUPS = 256
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC 1.1 format

CAPTURES = "url_key string, page_id long, url string, archive string, offset long, length long"
DIRECTORY = "part int, first_key string, first_id long, last_key string, file string, offset long, length long, lines long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://a.b.org/c?d becomes org,b,a)/c?d. Unparseable URLs are their own key."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return quote(url or "", safe="/?&=:;,%")
    if not host:
        return quote(url or "", safe="/?&=:;,%")
    return quote(",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="/?&=:;,()%")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{f':{copy}' if copy else ''}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE, copy: int = 0) -> bytes:
    """The bytes of one uncompressed record; ``copy`` numbers further rows of one page_id and payload."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, digest, copy)}",
        f"WARC-Target-URI: {quote(url, safe='/?&=:;,%()#@+!*$[]~')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type and refers_to of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
    number = lambda name: int(name.split(":")[2]) if name.split(":")[2] else None
    return {"record_id": fields["WARC-Record-ID"], "page_id": number(fields["WARC-Record-ID"]), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def decisions(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages that are written as revisits. Digests are grouped with partial sums and joined back under a salt, so a payload that a third of all pages share is dealt over SALTS tasks."""
    light = pages.select("page_id", "sha1", "payload_bytes").where(F.col("payload_bytes") >= least_bytes)
    shared = light.groupBy("sha1").agg(F.min_by("page_id", F.coalesce("page_id", F.lit(-(2**63)))).alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("sha1", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = light.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(shared, ["sha1", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("own_id"), F.col("sha1").alias("own_sha1"), "refers_to", F.lit(True).alias("revisit")).distinct()


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes the archives; returns their captures as a written table."""
    spark = pages.sparkSession
    bound_batches(spark)
    make_dir(path)
    html = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("payload_bytes"))
    of = decisions(pages, least_bytes).withColumn("at", id_of(F.col("own_id"))).drop("own_id").withColumnRenamed("own_sha1", "sha1")
    # rows of one page_id and payload meet in one task, which numbers them: adaptive execution does not split a shuffle that is asked for
    rows = pages.withColumn("at", id_of(F.col("page_id"))).repartition("at", "sha1").join(of.hint("merge"), ["at", "sha1"], "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit")).sortWithinPartitions("page_id", "html", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"{path}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        found: list[tuple] = []

        def fill(out) -> None:
            at, copy, before = 0, 0, None
            for batch in _both(first, batches):
                for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    copy = copy + 1 if before == (page_id, payload) else 0
                    before = (page_id, payload)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, refers_to, revisit, copy=copy)) + packer.flush()
                    out.write(member)
                    found.append((url_key(url), page_id, url, name, at, len(member)))
                    at += len(member)

        write_whole(name, fill)
        for k in range(0, len(found), 4096):
            yield _batch(found[k : k + 4096], CAPTURES)

    captures = rows.mapInArrow(write, CAPTURES)
    captures.write.parquet(f"{path}/captures.parquet")
    return spark.read.schema(captures.schema).parquet(f"{path}/captures.parquet")


def _both(first, rest):
    yield first
    yield from rest


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Captures are in this order: that of Spark, by the bytes of the key, null ids first."""
    return key.encode(), NULL_ID if page_id is None else page_id


def write_index(captures: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Writes the sorted, block-compressed index; returns the table of its files: first key, and byte range of the block directory in each."""
    spark = captures.sparkSession
    make_dir(path)
    parts = max(1, -(-captures.count() // (FILE_BLOCKS * block)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{path}/index-{part:06d}.cdx.zst"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        heads: list[list] = []
        last, count, place = "", 0, (0, 0)

        def fill(out) -> None:
            nonlocal last, count, place
            packer, lines, at = zstandard.ZstdCompressor(level=6), [], 0

            def flush() -> None:
                nonlocal at
                data = packer.compress("\n".join(f"{x['url_key']} {json.dumps(x)}" for x in lines).encode())
                out.write(data)
                heads.append([lines[0]["url_key"], lines[0]["page_id"], at, len(data)])
                at += len(data)
                lines.clear()

            for batch in _both(first, batches):
                for row in batch.to_pylist():
                    lines.append(row)
                    last, count = row["url_key"], count + 1
                    if len(lines) == block:
                        flush()
            if lines:
                flush()
            data = packer.compress(json.dumps(heads).encode())
            out.write(data)
            place = (at, len(data))

        write_whole(name, fill)
        yield _batch([(part, heads[0][0], heads[0][1], last, name, *place, count)], DIRECTORY)

    ordered = captures.repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "archive", "offset")
    directory = ordered.mapInArrow(write, DIRECTORY)
    directory.write.parquet(f"{path}/directory.parquet")
    return spark.read.schema(directory.schema).parquet(f"{path}/directory.parquet")


def _ranged(file: str, offset: int, length: int) -> str:
    store, path = filesystem(file)
    with store.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(length, offset)).decode()


def read_blocks(file: str, offset: int, length: int) -> list[list]:
    """The block directory of an index file: first key, first id, offset and length of each block."""
    return json.loads(_ranged(file, offset, length))


def read_block(file: str, offset: int, length: int) -> list[dict]:
    """The captures of one index block, by a read of its range."""
    return [json.loads(x.split(" ", 1)[1]) for x in _ranged(file, offset, length).split("\n")]


def read_records(captures: list[dict]) -> Iterator[dict]:
    """The records of captures, by reads of their ranges, archive by archive; ranges that touch are read at once."""
    by_archive: dict[str, list[tuple[int, int]]] = {}
    for c in captures:
        by_archive.setdefault(c["archive"], []).append((c["offset"], c["length"]))
    for archive, ranges in by_archive.items():
        store, path = filesystem(archive)
        with store.open_input_file(path) as f:
            ranges.sort()
            k = 0
            while k < len(ranges):
                stop, last = sum(ranges[k]), k + 1
                while last < len(ranges) and ranges[last][0] == stop and stop - ranges[k][0] < 1 << 22:
                    stop += ranges[last][1]
                    last += 1
                data = f.read_at(stop - ranges[k][0], ranges[k][0])
                for at, n in ranges[k:last]:
                    yield parsed(gzip.decompress(data[at - ranges[k][0] :][:n]))
                k = last


class CaptureIndex:
    """Lookups by URL. Holds a row for each index file, sorted; the block directory of a file and a block are read when a key falls into them, and the last ones are held, so keys that come in order read each once."""

    def __init__(self, files: DataFrame | list[tuple]):
        if not isinstance(files, list):
            files = [tuple(r) for r in files.select("first_key", "first_id", "file", "offset", "length").toLocalIterator()]
        self.files = sorted((_order(key, page_id), file, offset, length) for key, page_id, file, offset, length in files)
        self.heads = [f[0] for f in self.files]
        self.open: tuple[int, list, list] = (-1, [], [])
        self.held: tuple[tuple, tuple[list[dict], list]] = ((), ([], []))
        self.reads = 0

    def _blocks(self, k: int) -> tuple[list, list]:
        if self.open[0] != k:
            blocks = read_blocks(*self.files[k][1:])
            self.open = (k, blocks, [_order(b[0], b[1]) for b in blocks])
        return self.open[1:]

    def _lines(self, k: int, b: int) -> tuple[list[dict], list]:
        if self.held[0] != (k, b):
            lines = read_block(self.files[k][1], *self._blocks(k)[0][b][2:])
            self.held = ((k, b), (lines, [_order(c["url_key"], c["page_id"]) for c in lines]))
            self.reads += 1
        return self.held[1]

    def between(self, low: tuple, high: tuple) -> Iterator[dict]:
        """Captures from one (key, id) to another, both included."""
        k = max(0, bisect_left(self.heads, low) - 1)
        while k < len(self.files) and self.heads[k] <= high:
            heads = self._blocks(k)[1]
            b = max(0, bisect_left(heads, low) - 1)
            while b < len(heads) and heads[b] <= high:
                lines, orders = self._lines(k, b)
                yield from lines[bisect_left(orders, low) : bisect_right(orders, high)]
                b += 1
            k += 1

    def captures(self, url: str) -> list[dict]:
        key = url_key(url)
        return list(self.between(_order(key, None), _order(key, 2**63 - 1)))

    def records(self, url: str) -> list[dict]:
        return list(read_records(self.captures(url)))


def read_pages(pages: DataFrame, directory: DataFrame) -> DataFrame:
    """A row a record of the pages (page_id, url), each found by a lookup of its URL key and page_id in the index; a page that is not found is an error."""
    path = directory.inputFiles()[0].rsplit("/", 1)[0] if directory.inputFiles() else None
    names = [x.split()[0] for x in RECORD.split(", ")]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], ["url_key", "page_id"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            if index is None and batch.num_rows:
                store, folder = filesystem(path)
                table = ds.dataset(folder, filesystem=store, format="parquet").to_table(["first_key", "first_id", "file", "offset", "length"])
                index = CaptureIndex(list(zip(*(c.to_pylist() for c in table.columns), strict=True)))
            for a in range(0, batch.num_rows, LOOKUPS):
                found: list[dict] = []
                for key, page_id in zip(*(c.to_pylist() for c in batch.slice(a, LOOKUPS).columns), strict=True):
                    own = list(index.between(_order(key, page_id), _order(key, page_id)))
                    if not own:
                        raise ValueError(f"page {page_id} is not in the index")
                    found += own
                yield _batch([tuple(r[n] for n in names) for r in read_records(found)], RECORD)

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(keys, "url_key string, page_id long").distinct()
    if path is None:
        return pages.sparkSession.createDataFrame([], RECORD)
    return wanted.repartitionByRange(pages.sparkSession.sparkContext.defaultParallelism * 4, "url_key", "page_id").sortWithinPartitions("url_key", "page_id").mapInArrow(look, RECORD)


def read_all(directory: DataFrame) -> DataFrame:
    """A row a record of all archives, block by block of the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for f in batch.to_pylist():
                for _, _, offset, length in read_blocks(f["file"], f["offset"], f["length"]):
                    yield _batch([tuple(r[n] for n in names) for r in read_records(read_block(f["file"], offset, length))], RECORD)

    tasks = directory.sparkSession.sparkContext.defaultParallelism * 4
    return directory.repartition(tasks, "file").mapInArrow(read, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = new_path(spark, "warc")
    return read_pages(pages, write_index(write_archives(pages, path), f"{path}/index"))
