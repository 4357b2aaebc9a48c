"""Benchmark decontamination: which test items does a document contain.

An item is contained when ceil(threshold * |Q|) of its distinct word shingles Q occur in the
document. An item may miss at most |Q| - ceil(threshold * |Q|) shingles, so of its MinHash
sketch, the shingles with the smallest hashes, one more than that cannot all be missing:
every containing document shares a shingle with the sketch, and none is lost. Items fall into
partitions by size, each with its sketch length, and a document asks only the partitions whose
smallest need its own number of shingles can meet. Candidates are verified by exact shingle
containment over the whole document.

The items come in blocks of at most ``BLOCK_BYTES`` of text; each block is a stated query set
against all documents. Defined results: null or word-free items and documents match nothing;
items of fewer than ``k`` words have one shingle, their whole word sequence; repeated item rows
count once; repeated document rows each give their rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, on_batches
from .shingles import shingle_sets

#: Text of the items that one pass over the documents takes along.
BLOCK_BYTES = 32 << 20


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks of bounded text, read one partition after the other."""
    blocks, used = [[]], 0
    for row in items.toLocalIterator():
        if used + len(row[1]) > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            used = 0
        blocks[-1].append((row[0], row[1]))
        used += len(row[1])
    return blocks


class Sketches:
    """Sets and MinHash sketches of a block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]], k: int, num: int, den: int):
        self.ids, self.sets, self.needs = [], [], []
        for row, elements in shingle_sets(pa.array([t for _, t in items], pa.string()), k):
            if len(elements):
                self.ids.append(items[row][0])
                self.sets.append(elements)
                self.needs.append(-(-num * len(elements) // den))
        shingle, owner = [], []
        with np.errstate(over="ignore"):
            for i, own in enumerate(self.sets):
                least = np.argsort(mix(own))[: len(own) - self.needs[i] + 1]
                shingle.append(own[least])
                owner.append(np.full(len(least), i))
        shingle, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (shingle, owner))
        order = np.argsort(shingle, kind="stable")
        # The sketches of all size partitions as one index: a shingle, and where its items begin among the owners.
        self.owner = owner[order]
        self.shingle, self.first = np.unique(shingle[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.least = np.array([1 << (n.bit_length() - 1) for n in self.needs], np.int64)

    def contained(self, elements: np.ndarray):
        """(item, shared shingles) of the items a document with these shingles contains.

        The document's shingles are looked up in the index, so the time follows the document, not the items.
        """
        if not len(self.shingle):
            return
        at = np.minimum(np.searchsorted(self.shingle, elements), len(self.shingle) - 1)
        at = at[self.shingle[at] == elements]
        sizes = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        candidates = np.unique(self.owner[place])
        # A document asks only the size partitions whose smallest need its own number of shingles can meet.
        for i in candidates[self.least[candidates] <= len(elements)]:
            own = self.sets[i]
            found = np.searchsorted(elements, own)
            shared = int((elements[np.minimum(found, len(elements) - 1)] == own).sum())
            if shared >= self.needs[i]:
                yield int(i), shared


def _wanted(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item) of the items that num/den of whose shingles a document holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(_wanted(items)):
        sketches = texts.sparkSession.sparkContext.broadcast(Sketches(block, k, num, den))

        def step(batch: pa.RecordBatch, sketches=sketches):
            known, found = sketches.value, []
            for row, elements in shingle_sets(batch.column(1), k):
                if len(elements):
                    found += [(row, known.ids[i], shared, len(known.sets[i])) for i, shared in known.contained(elements)]
            if found:
                rows, ids, shared, sizes = zip(*found)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(ids, pa.int64()), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_shared", "n_item"])

        part = on_batches(texts, step, "doc_id long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents that contain no item; their columns stay as they are.

    Every row is judged by its own text in one pass: of rows that share an id, each stays or goes by
    itself. Rows without id stay.
    """
    number, text = docs.columns.index("doc_id"), docs.columns.index("text")
    for block in _blocks(_wanted(items)):
        sketches = docs.sparkSession.sparkContext.broadcast(Sketches(block, k, num, den))

        def step(batch: pa.RecordBatch, sketches=sketches):
            keep = np.ones(batch.num_rows, bool)
            for row, elements in shingle_sets(batch.column(text), k):
                keep[row] = not len(elements) or next(sketches.value.contained(elements), None) is None
            yield batch.filter(pc.or_(pa.array(keep), batch.column(number).is_null()))

        docs = on_batches(docs, step, docs.schema)
    return docs
