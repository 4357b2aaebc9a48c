"""Removal of repeated passages by prefix-free parsing.

Rolling-hash triggers cut every text the same way wherever the same bytes stand. A window of
``length`` bytes belongs to the first trigger in it; the ``gram`` bytes from a trigger on are its
phrase, and all windows of one trigger together span its bundle (from behind the trigger before
to ``length`` bytes behind it). The names of phrases and bundles are hashes, and sorting occurrences
by (phrase, bundle) is the order of the parse: equal phrases stand together, and within them equal
bundles. So one shuffle of triggers settles most windows. Windows whose phrase stands once in the
corpus are unique; windows of equal bundles are repeated. What is left are the borders of repeats:
there, and in one bundle of each group of equal ones that borders could repeat, windows are named
one by one, and the sorted names, the corpus order cut at ``length`` bytes, show which are equal.

Suffix order is only needed up to ``length`` bytes, so equal names take the place of ranks among
the suffixes of dictionary and parse; no array over a whole corpus is built.

Names of windows have 95 bits, those of bundles 128 with their phrase's. Nothing is capped: a phrase with a third of all occurrences is counted within
each batch first, and later passes hold one row back, not a group.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; rows are known by a
hash of id and text, so the id may be null or repeated; extra columns are ignored. Memory follows
the longest single text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_table, discard, mix, on_batches, powers, prefix_sums, signed, span_hash, stored, text_slices

#: One byte in so many is a trigger.
EVERY = 32
_WIDTH = 8
_FIRST, _SECOND = byte_table(3), byte_table(5)
_EDGE = np.uint64((1 << 64) // EVERY)


def triggers(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, texts) of all triggers whose phrase lies within its text."""
    count = len(data) - _WIDTH + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    place = np.flatnonzero(mix(eight) < _EDGE)
    text = np.searchsorted(bounds, place, side="right") - 1
    whole = place + gram(length) <= bounds[text + 1]
    return place[whole], text[whole]


def gram(length: int) -> int:
    """Bytes of a phrase."""
    return max(_WIDTH, length // 4)


class _Bundles:
    """The windows of a slice of texts, by the trigger they belong to.

    ``start`` and ``stop`` bound the window starts of a bundle; windows without a trigger whose
    phrase lies within them are ``free``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int):
        place, text = triggers(data, bounds, length)
        last = bounds[text + 1] - length + 1  # behind the last window start of the text
        behind = np.empty(len(place), np.int64)  # behind the trigger before, in the same text
        if len(place):
            behind[0] = bounds[text[0]]
            fresh = text[1:] != text[:-1]
            behind[1:] = np.where(fresh, bounds[text[1:]], place[:-1] + 1)
        start = np.maximum(behind, place + gram(length) - length)
        stop = np.minimum(place + 1, last)
        self.full = stop > start
        # A trigger near the end of its text may have no window of its own; its phrase counts all the same.
        self.place, self.text = place, text
        self.start, self.stop = np.where(self.full, start, place), np.where(self.full, stop, place)
        # Window starts that no trigger claims.
        free = np.zeros(len(data) + 1, np.int64)
        ends = bounds[1:] - length + 1
        some = ends > bounds[:-1]
        np.add.at(free, bounds[:-1][some], 1)
        np.add.at(free, ends[some], -1)
        np.add.at(free, self.start, -1)
        np.add.at(free, self.stop, 1)
        self.free = np.flatnonzero(np.cumsum(free[:-1]) > 0)


def _window_rows(data, bounds, ids, starts, open_, length):
    """Names (95 bits) of the windows at ``starts``; those that are not ``open_`` need no place."""
    text = np.searchsorted(bounds, starts, side="right") - 1
    first, second = (span_hash(prefix_sums(table[data]), starts, starts + length) for table in (_FIRST, _SECOND))
    doc = ids.take(pa.array(text, mask=~open_))
    return [pa.array(signed(first)), pa.array((second >> np.uint64(33)).astype(np.int32)), doc, pa.array(starts - bounds[text], pa.int32(), mask=~open_)]


_OCCURRENCE = "phrase long, bundle long, doc long, start long, size long, many boolean"


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    """A row for each trigger; equal bundles within a batch share one row with ``many`` and the others come settled.

    ``phrase`` is null in rows that are settled: their windows are repeated.
    """

    def step(batch: pa.RecordBatch):
        rows = []
        with np.errstate(over="ignore"):
            for first, end, data, bounds in text_slices(batch.column(1)):
                b = _Bundles(data, bounds, length)
                sums = prefix_sums(_FIRST[data])
                size = b.stop - b.start
                phrase = span_hash(sums, b.place, b.place + gram(length))
                content = span_hash(sums, b.start, np.where(b.full, b.stop + length - 1, b.start))
                rows.append((phrase, mix(content + size.astype(np.uint64)), b.text + first, b.start - bounds[b.text], size))
        phrase, bundle, row, start, size = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((bundle, phrase))
        phrase, bundle, row, start, size = (x[order] for x in (phrase, bundle, row, start, size))
        same = np.zeros(len(phrase), bool)
        same[1:] = (phrase[1:] == phrase[:-1]) & (bundle[1:] == bundle[:-1])
        many = np.zeros(len(phrase), bool)
        many[:-1] = same[1:]
        many |= same
        doc = batch.column(0).take(pa.array(row))
        columns = [pa.array(signed(phrase), mask=same), pa.array(signed(bundle)), doc, pa.array(start), pa.array(size), pa.array(many)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OCCURRENCE.split(", ")])

    return on_batches(texts, step, _OCCURRENCE)


def _parse_order(rows: DataFrame) -> DataFrame:
    """Occurrences of phrases that stand more than once, with their fate.

    ``settled``: their windows are repeated; ``name``: their windows have to be named. A pass over
    rows sorted by (phrase, bundle); between batches it remembers one row and what stood before it.
    """
    schema = "doc long, start long, size long, settled boolean, name boolean"

    def run(batches):
        held = None  # the first row of the bundle that the last batch ended in, and whether its phrase has another bundle
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            earlier = False
            if held is not None:
                table = pa.concat_tables([held[0], table])
                earlier = held[1]
            out, held = judged(table, earlier, False)
            yield from out
        if held is not None:
            yield from judged(held[0], held[1], True)[0]

    def judged(table, earlier, final):
        phrase, bundle = table["phrase"].to_numpy(), table["bundle"].to_numpy()
        many = table["many"].to_numpy()
        count = len(phrase)
        new_phrase, new_bundle = np.ones(count, bool), np.ones(count, bool)
        new_phrase[1:] = phrase[1:] != phrase[:-1]
        new_bundle[1:] = new_phrase[1:] | (bundle[1:] != bundle[:-1])
        head = np.flatnonzero(new_bundle)
        group = np.cumsum(new_bundle) - 1
        rows_of = np.diff(np.append(head, count))
        repeated = (rows_of > 1) | np.logical_or.reduceat(many, head)
        # Bundles per phrase; a bundle of the first phrase may stand in an earlier batch.
        phrase_of = (np.cumsum(new_phrase) - 1)[head]
        bundles = np.bincount(phrase_of)
        if earlier:
            bundles[0] += 1
        shared = bundles[phrase_of] > 1
        # The last bundle waits for the next batch, as does a lone bundle's need for names.
        done = np.ones(len(head), bool)
        if not final:
            done[-1] = False
        settled = repeated[group]
        name = new_bundle & shared[group]
        give = done[group] & (settled | name)
        last = group == group[-1]
        if not final:
            give |= last & ~new_bundle
            settled = settled | (last & repeated[-1])
        columns = [table["doc"], table["start"], table["size"], pa.array(settled), pa.array(name & ~(last & (not final)))]
        out = pa.Table.from_arrays(columns, names=["doc", "start", "size", "settled", "name"]).filter(pa.array(give)).combine_chunks()
        if final:
            return out.to_batches(), None
        keep = table.slice(int(head[-1]), 1)
        if repeated[-1]:
            keep = keep.set_column(keep.schema.get_field_index("many"), "many", pa.array([True]))
        return out.to_batches(), (keep.combine_chunks(), bool(bundles[-1] > 1))

    ordered = rows.where("phrase is not null").repartition("phrase").sortWithinPartitions("phrase", "bundle")
    return ordered.mapInArrow(run, schema)


def _named_windows(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Names of the windows that are not settled, and of those that could equal them."""
    lists = marks.where("size > 0 or settled or name").groupBy("doc").agg(F.collect_list(F.struct("start", "size", "settled", "name")).alias("marks"))  # at most one for each trigger of the text
    joined = texts.join(lists, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "marks")

    def step(batch: pa.RecordBatch):
        ids, marks = batch.column(0), batch.column(2)
        sizes = pc.fill_null(pc.list_value_length(marks), 0).to_numpy()
        fields = marks.flatten()
        m_start, m_size = fields.field(0).to_numpy(), fields.field(1).to_numpy()
        m_settled, m_name = (fields.field(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        m_row = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            for first, end, data, bounds in text_slices(batch.column(1)):
                lo, hi = int(np.searchsorted(m_row, first)), int(np.searchsorted(m_row, end))
                begin = m_start[lo:hi] + bounds[m_row[lo:hi] - first]
                size, settled, name = m_size[lo:hi], m_settled[lo:hi], m_name[lo:hi]
                b = _Bundles(data, bounds, length)
                # A window can only be repeated if all phrases in it are.
                repeated = np.zeros(len(data) + 1, bool)
                repeated[begin] = True
                lone = b.place[~repeated[b.start]]
                barred = np.zeros(len(data) + 1, np.int64)
                text = np.searchsorted(bounds, lone, side="right") - 1
                np.add.at(barred, np.maximum(bounds[text], lone + gram(length) - length), 1)
                np.add.at(barred, lone + 1, -1)
                free = np.cumsum(barred)[:-1] == 0
                behind = np.cumsum(size[name]) - size[name]
                starts = np.repeat(begin[name] - behind, size[name]) + np.arange(int(size[name].sum()))
                open_ = np.repeat(~settled[name], size[name])
                starts = np.concatenate([starts, b.free]).astype(np.int64)
                open_ = np.concatenate([open_, np.ones(len(b.free), bool)])
                use = free[starts] if len(starts) else np.zeros(0, bool)
                starts, open_ = starts[use], open_[use]
                if len(starts):
                    yield pa.RecordBatch.from_arrays(_window_rows(data, bounds, ids.slice(first, end - first), starts, open_, length), names=["n1", "n2", "doc", "start"])

    return on_batches(joined, step, "n1 long, n2 int, doc long, start int")


def _equal_windows(windows: DataFrame) -> DataFrame:
    """Open windows (doc, start) whose name stands more than once. A pass over sorted names that holds one row back."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            more = False
            if held is not None:
                table, more = pa.concat_tables([held[0], table]), held[1]
            n1, n2 = table["n1"].to_numpy(), table["n2"].to_numpy()
            same = (n1[1:] == n1[:-1]) & (n2[1:] == n2[:-1])
            hit = np.zeros(len(n1), bool)
            hit[1:] |= same
            hit[:-1] |= same
            hit[0] |= more
            wait = hit.copy()
            hit &= table["doc"].is_valid().to_numpy()
            hit[-1] = False
            yield from table.select(["doc", "start"]).filter(pa.array(hit)).combine_chunks().to_batches()
            held = (table.slice(len(n1) - 1).combine_chunks(), bool(wait[-1]))
        if held is not None and held[1] and held[0]["doc"][0].is_valid:
            yield from held[0].select(["doc", "start"]).combine_chunks().to_batches()

    return windows.repartition("n1").sortWithinPartitions("n1", "n2").mapInArrow(run, "doc long, start int")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    text or another; strings are judged on the texts as they come.
    """
    doc_id = F.col("doc_id").cast("long")
    named = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("key"), "text")
    texts = named.select(F.col("key").alias("doc_id"), "text")
    found = stored(_occurrences(texts, length), "repeats-parse")
    settled = found.where("phrase is null").select("doc", "start", "size", F.lit(True).alias("settled"), F.lit(False).alias("name"))
    marks = stored(_parse_order(found).unionByName(settled), "repeats-marks")
    discard(found)
    windows = _named_windows(texts, marks, length)
    single = stored(_equal_windows(windows), "repeats-windows")
    ranges = marks.where("settled and size > 0").select("doc", "start", "size").unionByName(single.select("doc", F.col("start").cast("long"), F.lit(1).cast("long").alias("size")))
    spans = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))  # at most one for each byte of the text
    joined = named.join(spans, F.col("key") == F.col("doc"), "left").select("doc_id", "text", "spans")

    def step(batch: pa.RecordBatch):
        rows = []
        spans = batch.column(2)
        for row, text in enumerate(batch.column(1).cast(pa.binary())):
            data = text.as_py() or b""
            own = spans[row]
            if not own.is_valid or not len(own):
                rows.append((len(data), 0, 0, data))
                continue
            start, size = own.values.field(0).to_numpy(), own.values.field(1).to_numpy()
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, np.minimum(start + size + length - 1, len(data)), -1)
            gone = np.cumsum(cover[:-1]) > 0
            spans_of = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(data), int(gone.sum()), spans_of, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        size, removed, count, kept = zip(*rows)
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, count)], pa.array(digests), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return on_batches(joined, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
