"""Quality classifier: averaged embeddings of hashed words and character n-grams with a softmax output.

The model is trained by numpy stochastic gradient descent, in small batches, on at most ``max_rows`` labelled documents
(chosen by hash of their doc_id), whose features the executors compute and store; the driver reads them chunk by chunk. A
document's vector is the mean over all its features, so its logit is the mean of one number a bucket; scoring sends just
these numbers to the tasks, a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, drop_stored, stored

BITS = 17
NGRAMS = (3, 4, 5)
MAX_ROWS = 3000
REPEAT = 4
#: Rows that the driver holds at once while training; a row takes 1 MB at most (2^BITS buckets).
CHUNK_ROWS = 250
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _PRIME, np.uint64), dtype=np.uint64)
_WORDS_AT_ONCE = 50_000


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h + np.uint64(salt)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all words and of the n-grams of code points inside words (a space marks either
    end), stretch by stretch. A word that equals the one before it also adds ``REPEAT`` times the bucket of "the same again"."""
    parts = (text or "").encode().split()
    for at in range(0, len(parts), _WORDS_AT_ONCE):
        joined = b" " + b" ".join(parts[at : at + _WORDS_AT_ONCE]) + b" "
        raw = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        space = raw == 32
        before = np.cumsum(space)
        starts = np.flatnonzero(space)
        place = np.arange(len(raw)) - starts[before - 1]
        word = np.add.reduceat(raw * _POWERS[place % len(_POWERS)], starts)[:-1]
        same = np.full(REPEAT * int((word[1:] == word[:-1]).sum()), np.uint64(0))
        out = [_bucket(word, 1), _bucket(same, 2)]
        for n in NGRAMS:
            if len(raw) < n:
                continue
            h = raw[: len(raw) - n + 1].copy()
            for k in range(1, n):
                h = h * _PRIME + raw[k : len(raw) - n + 1 + k]
            inside = before[n - 2 : len(raw) - 1] == before[: len(raw) - n + 1]
            out.append(_bucket(h[inside], n))
        yield np.concatenate(out)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << BITS, np.int64)
    for f in features(text):
        total += np.bincount(f, minlength=1 << BITS)
    ids = np.flatnonzero(total)
    return ids.astype("<u4"), total[ids].astype("<f4")


def labelled_sample(labels: DataFrame, label: str, held_out: Column, max_rows: int) -> DataFrame:
    """doc_id, label of at most ``max_rows`` labelled rows that are not held out, the lowest by hash of doc_id."""
    rows = labels.filter(~held_out & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").limit(max_rows)


Row = tuple[int, np.ndarray, np.ndarray]


def fit(chunks: Callable[[], Iterator[list[Row]]], n_rows: int, dim: int = 8, epochs: int = 10, rate: float = 12.0, batch: int = 8, seed: int = 0) -> tuple[np.ndarray, float]:
    """One number a bucket and the bias: difference of the two softmax inputs. No rows give zeros (score one half).

    ``chunks()`` gives rows (label, buckets, weights that add up to one) chunk by chunk, once an epoch; rows are shuffled
    within chunks and taken in small batches."""
    rng = np.random.default_rng(seed)
    table = (rng.random((1 << BITS, dim), dtype=np.float32) - 0.5) / dim
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * n_rows), 0
    for _ in range(epochs if n_rows else 0):
        for rows in chunks():
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                some = [rows[i] for i in order[at : at + batch]]
                lr = rate * (1 - done / steps)
                done += len(some)
                sizes = np.array([len(ids) for _, ids, _ in some])
                ids, w = np.concatenate([r[1] for r in some]).astype(np.int64), np.concatenate([r[2] for r in some])
                of = np.repeat(np.arange(len(some)), sizes)
                mean = np.zeros((len(some), dim), np.float32)
                full = np.flatnonzero(sizes)
                if len(full):
                    mean[full] = np.add.reduceat(w[:, None] * table[ids], (np.cumsum(sizes) - sizes)[full])
                z = mean @ out + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), [r[0] for r in some]] -= 1
                step = w[:, None] * (p @ out.T)[of]
                out -= lr * 0.1 * mean.T @ p
                bias -= 0.02 * (1 - done / steps) * p.sum(axis=0)
                np.subtract.at(table, ids, lr * step)
    delta = out[:, 1] - out[:, 0]
    return (table @ delta).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    sample = F.broadcast(labelled_sample(labels, label, held_out, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in counted], pa.binary()), pa.array([w.tobytes() for _, w in counted], pa.binary())], ["label", "ids", "weights"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").filter("label in (0, 1)")
    # rows that repeat an id do not widen the sample: one text of each labelled id is learned
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    parts = -(-max_rows // CHUNK_ROWS)
    rows = rows.repartition(parts, F.xxhash64("text", "doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(8)), "label", "text").select("label", "text")
    found = stored(rows.mapInArrow(run, "label int, ids binary, weights binary"), "features")

    def chunks() -> Iterator[list[Row]]:
        held: list[Row] = []
        for y, ids, weights in found.toLocalIterator():
            w = np.frombuffer(bytes(weights), "<f4")
            held.append((y, np.frombuffer(bytes(ids), "<u4"), w / w.sum() if len(w) else w))
            if len(held) == CHUNK_ROWS:
                yield held
                held = []
        if held:
            yield held

    model = fit(chunks, found.count())
    drop_stored(found)
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (probability of label 1) for every row; texts without words score by the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                n, total = 0, 0.0
                for f in features(text):
                    n += len(f)
                    total += float(table[f].sum(dtype=np.float64))
                scores.append(1 / (1 + float(np.exp(-(total / max(n, 1) + bias)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 0, folds: int = 5, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only the text enters a score. Labels are learned from rows outside the held-out fold (crc32 of doc_id as text
    modulo ``folds`` equal to ``fold``); without any labels every score is one half. Null texts are empty, null ids
    count as the empty text for the fold; repeated rows score alike; an empty table gives no rows; other columns are
    ignored."""
    held = crc32_of_id(F.col("doc_id")) % folds == fold
    model = train(docs, labels, label, held, max_rows)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
