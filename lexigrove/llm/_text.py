"""Vectorised work on whole Arrow string columns: word spans and 64-bit span hashes.

A text is a run of UTF-8 bytes; words are maximal runs of bytes other than the
six ASCII white-space characters (0x09-0x0D, 0x20). Everything here is linear
in the bytes of a batch and keeps a few 8-byte arrays per byte of it, so callers
feed it through :func:`chunks`, which bounds a batch by bytes, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one row at least, so a single very long text stays whole."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that are not separators; a run never crosses rows."""
    if not len(raw):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    word = ~separator[raw]
    before = np.empty(len(raw), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = at[(at > 0) & (at < len(raw))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(raw), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def eights(raw: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven after it as one number; beyond the end are zeros."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are chained through the mixer, so spans of one length
    up to eight bytes never collide, and longer ones have no algebraic collisions.
    """
    size, view = ends - starts, eights(raw)
    out = mix((view[starts] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    done, rest = 8, np.flatnonzero(size > 8)
    while len(rest):
        out[rest] = mix(out[rest] * _CHAIN ^ (view[starts[rest] + done] & _LOW_BYTES[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    return out


def shingles(raw: np.ndarray, at: np.ndarray, size: int, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words, the spans of which may be given; a text of fewer words is one shingle, a text without words none."""
    starts, ends, row = spans(raw, at) if words is None else words
    if not len(starts):
        return row, np.zeros(0, dtype=np.uint64)
    n = len(starts)
    word = np.append(span_hash(raw, starts, ends), np.zeros(size, dtype=np.uint64))
    odd = [mix(np.array([k], dtype=np.uint64))[0] | np.uint64(1) for k in range(1, size + 1)]
    out = word[:n] * odd[0]
    for k in range(1, size):
        out += word[k : n + k] * odd[k]
    whole = np.zeros(n, dtype=bool)
    whole[: max(0, n - size + 1)] = row[: max(0, n - size + 1)] == row[size - 1 :]
    count = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    out[first[short]] = 0
    for k in range(size - 1):
        own = first[short[count[short] > k]]
        out[own] += word[own + k] * odd[k]
    whole[first[short]] = True
    left = np.flatnonzero(whole)
    return row[left], mix(out[left] + np.minimum(size, count)[row[left]].astype(np.uint64))


def repeated(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1 ... for each run: the flat indexes of ragged slices."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
