"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: hashed words, hashed pairs of
neighbouring words and hashed n-grams of 3 and 4 bytes within a word, the white space at its edges
included; ``BLANKS`` zero vectors join the average, so that a few features do not decide alone.
The hash of a pair is that of the XOR of both words, so a word said twice is one feature whatever
the word. Two softmax outputs read the average. Vectors and outputs are trained together by stochastic gradient descent in
numpy on a sample of labelled documents of bounded number and bytes, in one task; everything else runs
over all documents. Because the outputs are linear in the average, scoring needs one number
per feature, the score of the feature's own vector, which is what executors are sent
(``BUCKETS`` numbers, whatever the data).

Labels, language, source and id are no inputs of a score. Defined results: null and empty texts
have no features and score as the outputs' bias alone; documents whose labels contradict one
another count as good when at least half of them say so, null labels do not count; without any
labelled document every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, mix, on_batches, prefix_sums, span_hash, text_slices

BUCKETS = 1 << 18
DIMENSIONS = 8
#: Labelled documents of each class that training takes at most; chosen by the hash of their id.
SAMPLE = 3_000
#: Bytes of text that training takes at most, and of a document it learns from; longer ones are only scored.
SAMPLE_BYTES, LONGEST = 48 << 20, 1 << 20
#: Passes over the sample: so many, or as many as give ``LEAST_STEPS`` updates.
EPOCHS, LEAST_STEPS = 4, 4_000
BLANKS = 30
RATE = 0.5
_SHIFT = np.uint64(64 - 18)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = byte_table(11)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of every feature of the texts; a place is the byte where the feature begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    begin, finish = ~space, ~space
    begin[1:] &= space[:-1]
    finish[:-1] &= space[1:]
    heads, tails = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    begin[heads] = ~space[heads]
    finish[tails] = ~space[tails]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    words = span_hash(prefix_sums(_TABLE[data]), start, end)
    of = np.searchsorted(bounds, start, side="right")
    pair = np.flatnonzero(of[1:] == of[:-1])
    buckets = [(words >> _SHIFT).astype(np.int64), (mix((words[pair] ^ words[pair + 1]) + np.uint64(1)) >> _SHIFT).astype(np.int64)]
    places = [start, start[pair]]
    last = np.zeros(len(data), bool)  # the first byte of an n-gram must not be the last of its text, and so on
    for n in (3, 4):
        count = len(data) - n + 1
        if count <= 0:
            continue
        value = np.zeros(count, np.uint64)
        inside = np.ones(count, bool)
        for j in range(n):
            value |= data[j : j + count].astype(np.uint64) << np.uint64(8 * j)
            if 0 < j < n - 1:
                inside &= ~space[j : j + count]
        last[:] = False
        for back in range(1, n):
            edge = bounds[1:] - back
            last[edge[edge >= 0]] = True
        place = np.flatnonzero(inside & ~last[:count])
        buckets.append((mix(value[place] + np.uint64(n << 40)) >> _SHIFT).astype(np.int64))
        places.append(place)
    return np.concatenate(buckets), np.concatenate(places)


class Sample:
    """Distinct buckets of texts and how often each occurs, one text after the other in two flat arrays."""

    def __init__(self):
        self.buckets, self.counts, self.ends, self.labels = array.array("i"), array.array("H"), [0], []

    def add(self, text: str, label: int) -> None:
        data = np.frombuffer(text.encode(), np.uint8)
        with np.errstate(over="ignore"):
            bucket, count = np.unique(features(data, np.array([0, len(data)]))[0], return_counts=True)
        self.buckets.frombytes(bucket.astype(np.int32).tobytes())
        self.counts.frombytes(np.minimum(count, 65535).astype(np.uint16).tobytes())
        self.ends.append(len(self.buckets))
        self.labels.append(label)


def train(sample: Sample, seed: int = 1) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) after gradient descent over documents in a fixed random order."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    outputs, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    buckets, counts, size = np.frombuffer(sample.buckets, np.int32), np.frombuffer(sample.counts, np.uint16), len(sample.labels)
    epochs = max(EPOCHS, -(-LEAST_STEPS // size))
    steps, done = epochs * size, 0
    for _ in range(epochs):
        for i in rng.permutation(size):
            own = slice(sample.ends[i], sample.ends[i + 1])
            bucket, share = buckets[own], counts[own] / (BLANKS + counts[own].sum(dtype=np.int64))
            rate = RATE * (1 - done / steps)
            done += 1
            middle = share @ vectors[bucket]
            odds = outputs @ middle + bias
            chance = np.exp(odds - odds.max())
            error = chance / chance.sum()
            error[sample.labels[i]] -= 1
            back = error @ outputs
            outputs -= rate * np.outer(error, middle)
            bias -= rate * error
            # Averages make single features' gradients small: their step is scaled by the number of features.
            vectors[bucket] -= rate * np.outer(share * min(len(bucket), 100), back)
    return vectors @ (outputs[1] - outputs[0]), float(bias[1] - bias[0])


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Scores of features learned from the labelled documents outside the held-out fold.

    The sample holds at most ``SAMPLE`` documents of each class, the first by the hash of their id, of at
    most ``LONGEST`` bytes each and ``SAMPLE_BYTES`` bytes together; the task keeps features, not texts.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    marked = marked.where(~held_out("doc_id")).groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    sample = short.join(chosen, "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def fit(batches):
        learned, size = Sample(), 0
        for batch in batches:
            for text, label in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                size += len(text.encode())
                if size <= SAMPLE_BYTES:
                    learned.add(text, label.as_py())
        if learned.labels:
            scores, bias = train(learned)
            yield pa.RecordBatch.from_arrays([pa.array([scores.astype("<f8").tobytes()]), pa.array([bias])], names=["scores", "bias"])

    model = sample.select("doc_id", "text", "label").mapInArrow(fit, "scores binary, bias double").collect()  # one row
    if not model:
        return np.zeros(BUCKETS), 0.0
    return np.frombuffer(bytes(model[0].scores), "<f8"), model[0].bias


def held_out(doc_id: str):
    """The fold that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scorer(docs: DataFrame, labels: DataFrame):
    """A function from a column of texts to their scores, with the trained model broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def score(texts: pa.Array) -> np.ndarray:
        scores, bias = model.value
        odds = np.full(len(texts), bias)
        with np.errstate(over="ignore"):
            for first, end, data, bounds in text_slices(texts):
                bucket, place = features(data, bounds)
                row = np.searchsorted(bounds, place, side="right") - 1
                total = np.bincount(row, weights=scores[bucket], minlength=end - first)
                count = np.bincount(row, minlength=end - first)
                odds[first:end] += total / (BLANKS + count)
        return 1 / (1 + np.exp(-odds))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) for every row of ``docs``."""
    score_of = _scorer(docs, labels)

    def step(batch: pa.RecordBatch):
        score = score_of(batch.column(1))
        columns = [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = on_batches(texts, step, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that the classifier accepts; their columns stay as they are.

    Every row is judged by its own text in the pass that scores it: of rows that share an id, each
    stays or goes by itself. Rows without id stay.
    """
    score_of, number, text = _scorer(docs, labels), docs.columns.index("doc_id"), docs.columns.index("text")

    def step(batch: pa.RecordBatch):
        good = pa.array(score_of(batch.column(text)) >= threshold)
        yield batch.filter(pc.or_(good, batch.column(number).is_null()))

    return on_batches(docs, step, docs.schema)
