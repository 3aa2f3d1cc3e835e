"""Toxicity scores by a convolutional text classifier, trained here in numpy.

Words (runs of letters, ASCII lower-cased) are hashed into a table of
embeddings. A slot of the table belongs to the training word that claimed it, known by
further hash bits; all other words share the unknown slot, so rare words of long
texts cannot pass for known ones. Filters of WIDTHS words slide over the
embeddings, each filter keeps its largest response over the whole text, and a
logistic unit weighs those. Scores are shifted so that 0.5 is the best
threshold on validation rows, if LEAST_POSITIVE of them are toxic; on the same rows a threshold is calibrated for each language,
which only decides and never scores.

Training uses a bounded sample of labelled rows: of those of at most LONGEST words, the SAMPLE of lowest hash of their
doc_id, and of these, in that order, as many as have WORDS words together. Their words are
written to the shared folder and one task reads them a few texts at a time, keeping two
bytes a word, so 2 * WORDS bytes at most, and trains; the driver only gets the model. Scoring reads every whole text. As a table of what each slot adds to each filter is computed
once, scoring is a few table lookups a word.

Defined cases: null and empty texts, and texts without letters, have the score of
no words; rows that repeat a doc_id are scored each; a doc_id with several labels
has the largest; null labels are none; with no labelled row, or labels of one kind
only, all scores are that share, kept under 0.5 without any; a null doc_id is not held out and has no label; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import _text
from lexigrove.llm._store import bound_batches, filesystem, new_path, write_whole

SAMPLE = 8000
LONGEST = 1 << 20
WORDS = 1 << 26
SLOTS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
LEAST_DOCS = 4
EPOCHS = 8
RATE = 0.01
BATCH = 64
VALIDATION = 5  # one row in so many
LEAST_POSITIVE = 5  # positive validation rows from which scores are shifted
LEAST_LANGUAGE = 20  # positive validation rows from which a language has its own threshold
THRESHOLDS = (0.3, 0.7)  # the range of those

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word."""
    starts, ends, row = _text.spans(raw, at, NOT_LETTER)
    return row, _text.span_hash(_LOWER[raw], starts, ends)


@dataclass
class Model:
    owner: np.ndarray  # uint64, the word that a slot belongs to
    embedding: np.ndarray  # (SLOTS + 2, DIM); unknown words and padding last
    filters: list[np.ndarray]  # (width, DIM, FILTERS) of each width
    bias: np.ndarray  # of each filter
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        return np.where(self.owner[slot] == hashes, slot, SLOTS)

    def tables(self) -> list[list[np.ndarray]]:
        """What each slot adds to each filter, by width and place in the window."""
        return [[(self.embedding @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", 0.5)


def _laid_out(slots: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots with a padding after each row, start of each row, positions of real words)."""
    pad = max(WIDTHS)
    count = np.bincount(row, minlength=rows)
    start = np.cumsum(count + pad) - (count + pad)
    out = np.full(int((count + pad).sum()) + pad, SLOTS + 1, dtype=np.int64)
    place = start[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    out[place] = slots
    return out, start, place


def scores(model: Model, tables: list[list[np.ndarray]], row: np.ndarray, slots: np.ndarray, rows: int) -> np.ndarray:
    """Of each text, from the slots of its words."""
    filters = model.filters[0].shape[2]
    pooled = np.zeros((rows, len(WIDTHS) * filters), dtype=np.float64)
    if len(row):
        # a window of unknown words responds alike everywhere: only windows with a known word, and one of unknown words of each text that has any, need a look
        slots, _, place = _laid_out(slots, row, rows)
        known, unknown = slots < SLOTS, slots == SLOTS
        for w, width in enumerate(WIDTHS):
            look = known.copy()
            for j in range(1, width):
                look[:-j] |= known[j:]
            # windows that reach into the padding differ from others of unknown words
            blank = unknown.copy()
            for j in range(1, width):
                blank[:-j] &= unknown[j:]
                blank[-j:] = False
            some = np.flatnonzero(blank[place])
            look[place[some[np.unique(row[some], return_index=True)[1]]]] = True
            for j in range(1, width):
                look[:-j] |= (slots[j:] == SLOTS + 1) & (slots[:-j] != SLOTS + 1)
            at = place[look[place]]
            owner = row[look[place]]
            response = np.zeros((len(at), filters), dtype=np.float32)
            for j in range(width):
                response += tables[w][j][slots[at + j]]
            response += model.bias[w * filters : (w + 1) * filters].astype(np.float32)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            pooled[owner[begin], w * filters : (w + 1) * filters] = np.maximum(np.maximum.reduceat(response, begin, axis=0), 0)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.offset, -30, 30)))


def vocabulary(texts: Iterable[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The words of LEAST_DOCS texts or more, those last whose texts' labels are the least like those of all texts. Texts are counted a few at a time."""
    known, count, hits, held, of, size = np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0), [], [], 0
    for t, label in chain(zip(texts, labels), [(None, 0)]):
        if t is not None:
            held.append(np.unique(t))
            of.append(np.full(len(held[-1]), label, dtype=np.float64))
            size += len(held[-1])
        if held and (t is None or size >= 1 << 18):
            more, place = np.unique(np.concatenate(held), return_inverse=True)
            n, y = np.bincount(place, minlength=len(more)), np.bincount(place, np.concatenate(of), len(more))
            known, place = np.unique(np.concatenate([known, more]), return_inverse=True)
            count, hits = (np.bincount(place, np.concatenate(x), len(known)) for x in ((count, n), (hits, y)))
            held, of, size = [], [], 0
    some = count >= LEAST_DOCS
    known, count, hits = known[some], count[some], hits[some]
    share = labels.mean()
    return known[np.argsort(np.abs(hits - count * share) / np.sqrt(count), kind="stable")]


def train(texts: Callable[[], Iterable[np.ndarray]], labels: np.ndarray, languages: list[str | None], seed: int = 11) -> Model:
    """texts: gives the word hashes of each labelled text, in the order of labels, as often as it is called."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    owner = np.zeros(SLOTS, dtype=np.uint64)
    model = Model(owner, rng.normal(0, 0.1, (SLOTS + 2, DIM)), [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, len(WIDTHS) * FILTERS), 0.0)
    model.embedding[SLOTS:] = 0
    positive = int(labels.sum()) if n else 0
    if positive in (0, n):
        share = min(0.49, positive / n) if n and not positive else positive / n if n else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.weight[:] = 0
        model.offset = float(np.log(share / (1 - share)))
        return model
    for word in vocabulary(texts(), labels):  # the most telling one claims a slot last
        owner[int(word) & (SLOTS - 1)] = word
    slots_of = [model.slots(t).astype(np.uint16) for t in texts()]
    order = rng.permutation(n)
    held, used = order[: n // VALIDATION], order[n // VALIDATION :]
    parts = [model.embedding, *model.filters, model.bias, model.weight]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    offset_moments = [0.0, 0.0]
    model.offset = float(np.log(positive / (n - positive)))
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(used)
        for b in range(0, len(shuffled), BATCH):
            own = shuffled[b : b + BATCH]
            grads, offset_grad = _gradients(model, [slots_of[i] for i in own], labels[own])
            step += 1
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                g += 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.embedding[SLOTS + 1] = 0
            offset_moments = [0.9 * offset_moments[0] + 0.1 * offset_grad, 0.999 * offset_moments[1] + 0.001 * offset_grad**2]
            model.offset -= RATE * (offset_moments[0] / (1 - 0.9**step)) / (np.sqrt(offset_moments[1] / (1 - 0.999**step)) + 1e-8)
    _calibrate(model, [slots_of[i] for i in held], labels[held], [languages[i] for i in held])
    return model


def _gradients(model: Model, slots: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    rows = len(slots)
    row = np.repeat(np.arange(rows), [len(s) for s in slots])
    flat, start, _ = _laid_out(np.concatenate(slots) if rows else np.zeros(0, np.int64), row, rows)
    stop = np.append(start[1:], len(flat) - max(WIDTHS))
    vectors = model.embedding[flat]
    pooled, at = np.zeros((rows, len(WIDTHS) * FILTERS)), []
    for w, width in enumerate(WIDTHS):
        response = sum(vectors[j : len(flat) - width + 1 + j] @ model.filters[w][j] for j in range(width)) + model.bias[w * FILTERS : (w + 1) * FILTERS]
        best = np.zeros((rows, FILTERS), dtype=np.int64)
        for r in range(rows):
            words = stop[r] - start[r] - max(WIDTHS)
            if words:
                best[r] = start[r] + response[start[r] : start[r] + words].argmax(axis=0)
                pooled[r, w * FILTERS : (w + 1) * FILTERS] = np.maximum(response[best[r], np.arange(FILTERS)], 0)
        at.append(best)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.offset, -30, 30)))
    error = (p - labels) / rows
    weight_grad = pooled.T @ error
    back = error[:, None] * model.weight * (pooled > 0)
    embedding_grad = np.zeros_like(model.embedding)
    filter_grads = []
    for w, width in enumerate(WIDTHS):
        g = back[:, w * FILTERS : (w + 1) * FILTERS]
        grad = np.zeros_like(model.filters[w])
        for j in range(width):
            grad[j] = np.einsum("bfd,bf->df", vectors[at[w] + j], g)
            np.add.at(embedding_grad, flat[at[w] + j].ravel(), (g[:, :, None] * model.filters[w][j].T[None]).reshape(-1, DIM))
        filter_grads.append(grad)
    return [embedding_grad, *filter_grads, back.sum(axis=0), weight_grad], float(error.sum())


def _best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """Of best F1, midway to the next lower score."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    k = int(f1.argmax())
    after = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((score[order[k]] + after) / 2)


def _calibrate(model: Model, slots: list[np.ndarray], labels: np.ndarray, languages: list[str | None]) -> None:
    if labels.sum() < LEAST_POSITIVE:
        return
    row = np.repeat(np.arange(len(slots)), [len(t) for t in slots])
    found = scores(model, model.tables(), row, np.concatenate(slots), len(slots))
    best = min(max(_best_threshold(found, labels), 1e-6), 1 - 1e-6)
    model.offset -= float(np.log(best / (1 - best)))
    odds = found / (1 - found) * (1 - best) / best
    found = odds / (1 + odds)
    for lang in sorted({x for x in languages if x}):
        own = np.array([x == lang for x in languages])
        if labels[own].sum() >= LEAST_LANGUAGE:
            model.thresholds[lang] = min(max(_best_threshold(found[own], labels[own]), THRESHOLDS[0]), THRESHOLDS[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on labelled documents that are not held out, in a task, so that the driver's memory holds one model and nothing that training takes."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("labelled"), "toxic")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "lang", "toxic", F.coalesce("text", F.lit("")).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                row, hashes = words(*_text.buffers(part.column("text")))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "toxic")), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "lang", "toxic", "words"])
                yield out.filter(pa.array(np.diff(at) <= LONGEST))

    kinds = dict(docs.dtypes)
    read_rows = rows.mapInArrow(read, f"doc_id {kinds['doc_id']}, lang string, toxic {dict(labels.dtypes)['toxic']}, words binary")
    # one row of a repeated doc_id, chosen before any of them leaves its executor
    path = new_path(docs.sparkSession, "training")
    read_rows.groupBy("doc_id").agg(F.min(F.struct("words", "lang", "toxic")).alias("row")).select("doc_id", "row.*", (F.octet_length("row.words") / 8).cast("long").alias("size")).repartitionByRange(1, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").write.parquet(path)
    at = f"{path}-model"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([write_whole(at, lambda out: out.write(pickle.dumps(_learned(path))))])], ["bytes"])

    docs.sparkSession.range(0, 1, 1, 1).mapInArrow(learn, "bytes long").collect()
    store, place = filesystem(at)
    with store.open_input_stream(place, compression=None) as f:
        return pickle.loads(f.read())


def _learned(path: str) -> Model:
    """Trains on the written rows."""
    toxic, langs, size = [], [], []
    for batch in _batches(path, ["lang", "toxic", "size"]):
        langs += batch.column("lang").to_pylist()
        toxic += batch.column("toxic").to_pylist()
        size += batch.column("size").to_pylist()
    used = int(np.searchsorted(np.cumsum(size), WORDS, side="right")) if size else 0

    def texts() -> Iterator[np.ndarray]:
        left = used
        for batch in _batches(path, ["words"]):
            raw, at = _text.buffers(batch.column("words").slice(0, left))
            yield from (raw[a:b].view(np.uint64) for a, b in zip(at[:-1], at[1:], strict=True))
            left -= min(left, batch.num_rows)
            if not left:
                return

    return train(texts, np.array(toxic[:used], dtype=np.float64) > 0, langs[:used])


def _batches(path: str, columns: list[str], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, a few at a time, so that no whole column of words is held."""
    store, folder = filesystem(path)
    for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with pq.ParquetFile(info.path, filesystem=store) as f:
                yield from f.iter_batches(rows, columns=columns)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All rows of docs with the score of their whole text under a name that docs has not."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its tables are larger and made where they are used
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                row, hashes = words(*_text.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(own, tables, row, own.slots(hashes), part.num_rows), pa.float64())], [*names, name])

    schema = docs.select(*docs.columns).schema.add(name, "double")
    return docs.mapInArrow(score, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is under the threshold of their language."""
    model = fitted(docs, labels)
    limit = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted(model.thresholds.items())), F.lit(0.5))
    name = next(n for k in range(len(docs.columns) + 1) if (n := "toxicity" + "_" * k) not in docs.columns)
    return scored(docs, model, name).where(F.col(name) < limit).drop(name)
