"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

Tokenizer A encodes a space and the text, tokenizer B the text, to which it adds the space itself:
both tile the same bytes. Row i of a token-byte incidence matrix holds the bytes of token i; with
matrices in compressed rows, Gustavson's row products A x B' list, for every A token, the B tokens
whose bytes overlap its own, with the number of shared bytes: the overlap links. Byte offsets where
tokens of both end cut the tokens into groups; the product of the token-group incidence matrices
lists the pairs within a group. Bytes are taken in blocks, so a block's matrices are of bounded size.

An id pair counts the documents that hold it linked. Documents come in chunks (one Arrow batch);
a chunk knows its distinct pairs, which meet the corpus-wide counts in joins keyed by pair and
return to the chunk. So a pair that every document holds costs a row a chunk, not one a link.

Defined results: a row is a document, repeated rows and ids included; texts that are null or empty,
or that one tokenizer's token bytes do not spell again, have no tokens, zeros, and '' for groups;
special tokens' strings are plain text; extra columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE, discard, on_batches, stored, text_slices
from .token_file import Encoder

#: Units of text whose piece ids one worker remembers at most.
KNOWN = 300_000


class Csr(NamedTuple):
    """A 0/1 matrix in compressed rows."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def spans(ends: np.ndarray, first: int) -> Csr:
    """Token-byte incidence of adjoining tokens that end at ``ends``, the first of which starts at ``first``."""
    size = int(ends[-1]) - first if len(ends) else 0
    return Csr(np.concatenate([[0], ends - first]), np.arange(size), size)


def members(group: np.ndarray, count: int) -> Csr:
    """Token-group incidence: every token lies in one group."""
    return Csr(np.arange(len(group) + 1), group, count)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    sizes = np.bincount(m.columns, minlength=m.width)
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), rows[np.argsort(m.columns, kind="stable")], len(m.starts) - 1)


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, column, value) of a x b: row i sums the rows of b that row i of a names."""
    sizes = np.diff(b.starts)[a.columns]
    before = np.cumsum(sizes) - sizes
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), sizes)
    column = b.columns[np.repeat(b.starts[:-1][a.columns] - before, sizes) + np.arange(len(row))]
    key = row * b.width + column
    if len(key) and (key[1:] < key[:-1]).any():
        key = np.sort(key)
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    return key[heads] // max(1, b.width), key[heads] % max(1, b.width), np.diff(np.append(heads, len(key)))


class _Bytes:
    """A number of byte strings, one after the other, found by index."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.at = np.cumsum([0, *map(len, strings)])
        self.sizes = np.diff(self.at)

    def joined(self, index: np.ndarray) -> np.ndarray:
        sizes = self.sizes[index]
        total = np.cumsum(sizes)
        return self.data[np.repeat(self.at[:-1][index] - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]


class _Plain(Encoder):
    """Ids of byte-level BPE with the special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        with open(path, encoding="utf-8") as f:
            names = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in self.known.alphabet.items()}
        spelled = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelled[i] = bytes(back.get(c, ord(c)) for c in name)
        self.bytes = _Bytes(spelled)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self(" " + text), self.type)


class _Units(dict):
    """Piece ids of units: spaces and what follows up to the next ones."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        ids = self.model.encode(unit[1:], num_threads=1) if unit != " " else [self.model.piece_to_id("▁")]
        out = array.array("I", ids).tobytes()
        if len(self) < KNOWN:
            self[unit] = out
        return out


class _Pieces:
    """Ids of sentence pieces.

    Where no piece holds a space behind something else, merges never cross the start of a run of
    spaces, and the library is asked once per distinct unit.
    """

    _UNIT = re.compile(" +[^ ]*")
    _BYTE = re.compile("<0x([0-9A-F]{2})>")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = _Bytes([bytes([int(self._BYTE.fullmatch(n).group(1), 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.cuts = not any(re.search("[^▁]▁", n) for n in names) and "▁" in names
        self.known = _Units(self.model)

    def ids(self, text: str) -> np.ndarray:
        if self.cuts and "▁" not in text:
            return np.frombuffer(b"".join(map(self.known.__getitem__, self._UNIT.findall(" " + text))), np.uint32)
        return np.array(self.model.encode(text, num_threads=1), np.uint32)


_models: dict[tuple[str, str], tuple[_Plain, _Pieces]] = {}


def models(a_path: str, b_path: str) -> tuple[_Plain, _Pieces]:
    if (a_path, b_path) not in _models:
        _models[a_path, b_path] = _Plain(a_path), _Pieces(b_path)
    return _models[a_path, b_path]


class Aligned:
    """Tokens, links and groups of some texts, put one after the other.

    ``rows`` are the texts that have tokens. Of side s (0 or 1): ``ids[s]``, ``ends[s]`` (byte
    offset behind each token), ``first[s]`` (each text's first token, one more at the end). ``cuts``:
    the byte offsets where both end; ``first_cut``: of each text.
    """

    def __init__(self, column: pa.Array, a: _Plain, b: _Pieces):
        self.sides = (a, b)
        kept, ids = [], ([], [])
        for row, text in enumerate(column.to_pylist()):
            if not text:
                continue
            spelled = np.frombuffer(b" " + text.encode(), np.uint8)
            both = a.ids(text), b.ids(text)
            if all(int(m.bytes.sizes[i].sum()) == len(spelled) and self._spells(m, i, spelled) for m, i in zip(self.sides, both)):
                kept.append((row, len(spelled)))
                for side in (0, 1):
                    ids[side].append(both[side])
        self.rows = np.array([r for r, _ in kept], np.int64)
        self.bounds = np.cumsum([0, *[n for _, n in kept]])
        self.ids = [np.concatenate(i).astype(np.int64) if i else np.zeros(0, np.int64) for i in ids]
        self.ends = [np.cumsum(m.bytes.sizes[i]) for m, i in zip(self.sides, self.ids)]
        self.first = [np.concatenate([[0], np.cumsum([len(x) for x in i])]).astype(np.int64) for i in ids]
        self.cuts = np.intersect1d(*self.ends, assume_unique=True)
        self.first_cut = np.searchsorted(self.cuts, self.bounds, side="right")

    @staticmethod
    def _spells(model, ids: np.ndarray, spelled: np.ndarray) -> bool:
        at = 0
        for first in range(0, len(ids), SLICE // 4):
            part = model.bytes.joined(ids[first : first + SLICE // 4])
            if not np.array_equal(part, spelled[at : at + len(part)]):
                return False
            at += len(part)
        return True

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes) of all overlaps, in blocks of about ``SLICE`` bytes."""
        one, two = self.ends
        done = 0
        while done < len(one):
            start = int(one[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(one, start + SLICE, side="right")))
            low = int(np.searchsorted(two, start, side="right"))  # the token that holds byte ``start``
            high = int(np.searchsorted(two, one[stop - 1], side="left")) + 1
            inner = np.minimum(two[low:high], one[stop - 1])
            row, column, size = product(spans(one[done:stop], start), transposed(spans(inner, start)))
            yield row + done, column + low, size
            done = stop

    def groups(self, side: int) -> np.ndarray:
        """The group of every token of a side."""
        return np.searchsorted(self.cuts, self.ends[side], side="left")

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) of all pairs within a group, in blocks of A tokens."""
        own, other = self.groups(0), transposed(members(self.groups(1), len(self.cuts)))
        pairs = np.cumsum(np.diff(other.starts)[own])
        done = 0
        while done < len(own):
            stop = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + SLICE, side="right")))
            row, column, _ = product(members(own[done:stop], len(self.cuts)), other)
            yield row + done, column
            done = stop

    def per_text(self, index: np.ndarray, side: int = 0) -> np.ndarray:
        """The text (its place in ``rows``) of every given token."""
        return np.searchsorted(self.first[side], index, side="right") - 1

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text: the ids of both sides in order, group by group."""
        group = [self.groups(s) for s in (0, 1)]
        sizes = [np.bincount(g, minlength=len(self.cuts)) for g in group]
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
        ends = upto[0] + upto[1]
        ids, sign = np.empty(ends[-1], np.int64), np.full(ends[-1], ord(","), np.uint8)
        ids[np.arange(len(group[0])) + upto[1][group[0]]] = self.ids[0]
        ids[np.arange(len(group[1])) + upto[0][group[1] + 1]] = self.ids[1]
        sign[ends[1:] - 1] = ord(";")
        sign[ends[1:] - sizes[1] - 1] = ord("|")
        said = b"".join([_numbers(ids[at : at + SLICE], sign[at : at + SLICE]).tobytes() for at in range(0, len(ids), SLICE)])
        at = np.concatenate([[0], np.cumsum(_digits[0].sizes[ids])])[ends[self.first_cut]] if len(ids) else []
        return [said[x : y - 1] for x, y in zip(at[:-1], at[1:])]


_digits: list[_Bytes] = []


def _numbers(values: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Decimal numbers, each with the sign that follows it."""
    if not _digits or len(_digits[0].sizes) <= int(values.max()):
        _digits[:] = [_Bytes([b"%d," % i for i in range(max(1 << 16, int(values.max()) + 1))])]
    out = _digits[0].joined(values)
    out[np.cumsum(_digits[0].sizes[values]) - 1] = sign
    return out


def token_alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (doc_id, a_ids, b_ids, links, groups): links as (a, b, n_bytes) with places in the lists of ids."""

    def step(batch: pa.RecordBatch):
        for first, end, _, _ in text_slices(batch.column(1)):
            found = Aligned(batch.column(1).slice(first, end - first), *models(a_path, b_path))
            rows = [{"doc_id": i, "a_ids": [], "b_ids": [], "links": [], "groups": ""} for i in batch.column(0).slice(first, end - first).to_pylist()]
            parts = [np.concatenate(p) for p in zip(*found.links())] if len(found.rows) else []
            of = found.per_text(parts[0]) if parts else None
            for t, text in enumerate(found.group_texts()):
                a, b = (found.ids[s][found.first[s][t] : found.first[s][t + 1]] for s in (0, 1))
                at = slice(*np.searchsorted(of, [t, t + 1]))
                links = zip(*((p[at] - base).tolist() for p, base in zip(parts, (found.first[0][t], found.first[1][t], 0))))
                rows[int(found.rows[t])].update(a_ids=a.tolist(), b_ids=b.tolist(), links=[{"a": x, "b": y, "n_bytes": n} for x, y, n in links], groups=text.decode())
            link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n_bytes", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("links", pa.list_(link)), ("groups", pa.string())]))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return on_batches(texts, step, "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int, n_bytes: int>>, groups string")


_CHUNKED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, spots binary, times binary, pairs array<long>, holders array<int>"


def _chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document, with the places (``spots``) of its pairs in the list of its chunk's distinct pairs.

    The list stands in the first row of the chunk. A chunk's name is drawn when the rows are made;
    they have to be written before they are used.
    """

    def step(batch: pa.RecordBatch):
        sides = models(a_path, b_path)
        count = len(sides[1].bytes.sizes)
        span = len(sides[0].bytes.sizes) * count
        numbers = np.zeros((batch.num_rows, 5), np.int64)
        digests = [""] * batch.num_rows
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, pair, times
        for first, end, _, _ in text_slices(batch.column(1)):
            found = Aligned(batch.column(1).slice(first, end - first), *sides)
            if not len(found.rows):
                continue
            rows = found.rows + first
            for s in (0, 1):
                numbers[rows, s] = np.diff(found.first[s])
            numbers[rows, 2] = np.diff(found.first_cut)
            sizes = [np.bincount(found.groups(s), minlength=len(found.cuts)) for s in (0, 1)]
            numbers[rows, 4] = np.add.reduceat(sizes[0] * sizes[1], found.first_cut[:-1])
            for row, text in zip(rows, found.group_texts()):
                digests[int(row)] = hashlib.sha256(text).hexdigest()
            for a, b, _ in found.links():
                of = found.per_text(a)
                numbers[:, 3] += np.bincount(rows[of], minlength=batch.num_rows)
                pair = found.ids[0][a] * count + found.ids[1][b]
                both, times = np.unique(of * span + pair, return_counts=True)
                held.append((rows[both // span], both % span, times))
        row, pair, times = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        known, spot = np.unique(pair, return_inverse=True)
        key = row * max(1, len(known)) + spot
        if (key[1:] <= key[:-1]).any():  # a long text came in several blocks
            key, inverse = np.unique(key, return_inverse=True)
            times = np.bincount(inverse, weights=times).astype(np.int64)
            row, spot = key // len(known), key % len(known)
        holders = np.bincount(spot, minlength=len(known))
        at = np.searchsorted(row, np.arange(batch.num_rows + 1))
        steps = np.diff(spot, prepend=0)
        steps[at[:-1][np.diff(at) > 0]] = spot[at[:-1][np.diff(at) > 0]]
        chunk = secrets.randbits(63)
        places, often = ([x[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])] for x in (steps, times))
        for low in range(0, batch.num_rows, 1000):
            part = slice(low, low + 1000)
            size = len(digests[part])
            lists = [pa.array([x if low == 0 and i == 0 else None for i in range(size)], kind) for x, kind in ((known, pa.list_(pa.int64())), (holders, pa.list_(pa.int32())))]
            columns = [pa.array(np.full(size, chunk)), batch.column(0).slice(low, 1000), *[pa.array(numbers[part, i]) for i in range(5)]]
            columns += [pa.array(digests[part]), pa.array(places[part], pa.binary()), pa.array(often[part], pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CHUNKED.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return on_batches(texts, step, _CHUNKED)


def pair_counts(chunks: DataFrame, width: int) -> DataFrame:
    """pair, ``of`` (the chunk) and spot of every chunk's distinct pairs with n_docs, the corpus-wide count, and whether it is the highest of the A id."""
    rows = chunks.where("pairs is not null").select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("pairs", "holders")).alias("spot", "x"))
    rows = rows.select("of", "spot", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("n"))
    counts = rows.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a_id", F.floor(F.col("pair") / width))
    most = F.max("n_docs").over(W.partitionBy("a_id"))  # an A id has at most as many rows as B has ids
    counts = counts.select("pair", "n_docs", (F.col("n_docs") == most).alias("best"))
    return rows.select("pair", "of", "spot").join(counts, "pair")


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of one chunk."""
    spot = counts["spot"].to_numpy()
    n_docs, best = np.zeros(len(spot), np.int64), np.zeros(len(spot), np.int64)
    n_docs[spot] = counts["n_docs"].to_numpy()
    best[spot] = counts["best"].to_numpy(zero_copy_only=False)
    steps, times = (np.frombuffer(b"".join(docs[c].to_pylist()), "<u4").astype(np.int64) for c in ("spots", "times"))
    size = np.array([len(x) // 4 for x in docs["spots"].to_pylist()])
    at = np.concatenate([[0], np.cumsum(size)])
    upto = np.concatenate([[0], np.cumsum(steps)])
    where = upto[1:] - np.repeat(upto[at[:-1]], size)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, value in (("n_best", best), ("count_sum", n_docs)):
        total = np.concatenate([[0], np.cumsum(value[where] * times)])
        out = out.append_column(name, pa.array(total[at[1:]] - total[at[:-1]]))
    return out.append_column("groups_sha256", docs["groups_sha256"]).append_column("n_group_links", docs["n_group_links"])


def alignment_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_group_links.

    ``n_best``: links whose pair has the highest document count of its A id; ``count_sum``: the sum
    of these counts over the links; ``n_group_links``: pairs of tokens within a group.
    """
    chunks = stored(_chunks(docs, a_path, b_path), "align", "zstd")
    counts = pair_counts(chunks.select("chunk", "pairs", "holders"), len(models(a_path, b_path)[1].bytes.sizes))
    rows = chunks.drop("pairs", "holders")
    out = rows.groupBy("chunk").cogroup(counts.select("of", "spot", "n_docs", "best").groupBy("of"))
    return out.applyInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long")
