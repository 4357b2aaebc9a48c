"""Token ids of documents in files coded with one length-limited canonical Huffman code.

Ids are counted over all documents, the code lengths follow by package-merge under a bound,
and codes are canonical, so the lengths alone restore them. A file row is an independent block:
the ids of one document (of ``BLOCK`` ids of it, if it has more) from a byte boundary on, with
the bit offset of every ``STRIDE``-th id. A decoder starts at all checkpoints at once and takes
one id per step and checkpoint from a table indexed by the next bits.

Rows are written in ascending doc_id order, file by file. Defined results: a null text is
empty and holds the end id alone; documents that share an id, or have none, stay apart, in no
fixed order among themselves; extra columns are ignored; a table without rows gives empty files.
"""

from __future__ import annotations

import array
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import on_batches, stored

STRIDE = 512
BLOCK = 1 << 20
MAX_BITS = 18
#: Pretokens whose ids one worker remembers at most.
KNOWN = 800_000

# Pretokens of texts made of Latin letters, ASCII digits and signs, spaces and line feeds. An
# apostrophe, or anything else, is left out on purpose: then the matches do not cover the text.
_PRETOKEN = re.compile("(?: ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+))|\n+(?!\\S)|\n")


class _Known(dict):
    """Ids of pretokens; new ones come from the library's model, and are kept up to ``KNOWN`` of them."""

    def __init__(self, model, kind: np.dtype):
        self.model, self.kind = model, "H" if kind.itemsize == 2 else "I"
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.alphabet)
        ids = array.array(self.kind, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) < KNOWN:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts as the tokenizers library gives them, as little-endian bytes.

    With a byte-level pre-tokenizer the pretokens of plain Latin text are found here, and the
    library's model gives the ids of each distinct one. Other texts, and other tokenizers, go
    to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = _Known(self.tokenizer.model, self.type)

    def __call__(self, text: str) -> bytes:
        if self.cuts and not any(s in text for s in self.special):
            found = _PRETOKEN.findall(text)
            if len("".join(found)) == len(text):
                return b"".join(map(self.known.__getitem__, found))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``limit`` (package-merge); 0 for absent symbols."""
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    if len(present) < 2:
        lengths[present] = 1
        return lengths
    if len(present) > 1 << limit:
        raise ValueError(f"{len(present)} symbols need more than {limit} bits")
    present = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[present].astype(np.float64)
    kinds, items = [np.zeros(len(leaves), np.int8)], leaves
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        order = np.argsort(merged, kind="stable")
        kinds.append((order >= len(leaves)).astype(np.int8))  # 1: a package of two items of the level before
        items = merged[order]
    take, out = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kind in reversed(kinds):
        used = int((kind[:take] == 0).sum())
        out[:used] += 1
        take = 2 * (take - used)
    lengths[present] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that follow from the lengths: shorter first, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        width = int(lengths.max())
        steps = np.left_shift(np.uint64(1), (width - lengths[order]).astype(np.uint64))
        at = np.cumsum(steps) - steps
        codes[order] = (at >> (width - lengths[order]).astype(np.uint64)).astype(np.uint32)
    return codes


class Code:
    """Coding and table-driven decoding with given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical_codes(lengths).astype(np.uint64)
        self.width = max(1, int(lengths.max(initial=0)))
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """Symbol and length (low 5 bits) for every ``width`` next bits."""
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            table = np.zeros(1 << self.width, np.uint32)
            filled = np.repeat((order << 5 | self.lengths[order]).astype(np.uint32), 1 << (self.width - self.lengths[order]))
            table[: len(filled)] = filled
            self._table = table
        return self._table

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first byte of each block, bit offset of each id within the bytes); blocks start at bytes."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        block = np.concatenate([[0], ends])[bounds]
        sizes = (np.diff(block) + 7) // 8
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = ends - bits + np.repeat(8 * first[:-1] - block[:-1], np.diff(bounds))
        total = int(first[-1])
        value = self.codes[ids] << (np.uint64(64) - bits.astype(np.uint64) - (at & 31).astype(np.uint64))
        word, count = at >> 5, total // 4 + 2
        high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=count)
        low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=count + 1)
        out = high[:count].astype(np.uint64) + low[:count].astype(np.uint64)
        return out.astype(">u4").view(np.uint8)[:total], first, at

    def decode(self, data: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
        """``steps`` ids from each start (bit offsets): one row per start."""
        pad = 8 + (-len(data)) % 4 + 4 * (steps * self.width // 32 + 2)
        words = np.concatenate([data, np.zeros(pad, np.uint8)]).view(">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        mask, shift, table = np.uint64((1 << self.width) - 1), 64 - self.width, self.table
        at, out = starts.astype(np.int64), np.empty((steps, len(starts)), np.uint32)
        for step in range(steps):
            entry = table[(pairs[at >> 5] >> (shift - (at & 31)).astype(np.uint64)) & mask]
            out[step] = entry >> np.uint32(5)
            at = at + (entry & np.uint32(31))
        return out.T


def token_ids(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Rows (uid, doc_id, ids): the ids of each text as little-endian bytes of the tokenizer's width."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def step(batch: pa.RecordBatch):
        encode = encoder(path)
        tail = b"" if end_id is None else np.array([end_id], encode.type).tobytes()
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = [encode(t or "") + tail for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["uid", "doc_id", "ids"])

    return on_batches(texts, step, "uid long, doc_id long, ids binary")


def _joined(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of bytes, and where each row's ids begin."""
    column = column.cast(pa.large_binary())
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content is not None and content.size else np.zeros(0, np.uint8)
    return data.view(kind), (offsets - offsets[0]) // kind.itemsize


def id_counts(ids: DataFrame, kind: np.dtype) -> DataFrame:
    """Rows (id, n) over all documents; each batch is counted before the shuffle."""

    def step(batch: pa.RecordBatch):
        counts = np.bincount(_joined(batch.column(0), kind)[0])
        present = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(counts[present])], names=["id", "n"])

    return on_batches(ids.select("ids"), step, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, folder: str, path: str, end_id: int | None = None, max_bits: int = MAX_BITS) -> None:
    """Encode all documents and write ``folder``/blocks and ``folder``/code."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(path).get_vocab_size()
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    ids = stored(token_ids(docs, path, end_id), "token-ids", compression="zstd")
    counts = np.zeros(max(size, (end_id or 0) + 1), np.int64)
    for row in id_counts(ids, kind).collect():  # at most one row for each id of the vocabulary
        counts[row.id] = row.n
    lengths = code_lengths(counts, max(max_bits, int(np.ceil(np.log2(max(2, len(counts)))))))
    code = Code(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), kind.itemsize)], "lengths binary, width int").coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(code)

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 200):
            yield from coded(batch.slice(at, 200))

    def coded(batch: pa.RecordBatch):
        tokens, begin = _joined(batch.column(2), kind)
        row, cuts = [], [0]
        for i in range(batch.num_rows):
            edges = [*range(int(begin[i]), int(begin[i + 1]), BLOCK), int(begin[i + 1])][1:] or [int(begin[i])]
            row += [i] * len(edges)
            cuts += edges
        cuts, row = np.array(cuts), np.array(row)
        data, first, bit = shared.value.encode(tokens, cuts)
        marks, ends = [], [0]
        for a, b, byte in zip(cuts[:-1], cuts[1:], first[:-1]):
            marks.append(bit[a:b:STRIDE] - 8 * byte)
            ends.append(ends[-1] + len(marks[-1]))
        piece = np.arange(len(row)) - np.searchsorted(row, row)
        payload = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        checkpoints = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(marks), pa.int64()))
        columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(np.diff(cuts), pa.int64()), payload.cast(pa.binary()), checkpoints]
        yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "piece", "n", "payload", "checkpoints"])

    # The ids are put in order, not the blocks: finding the ranges runs all steps before it once more. A document's blocks come in order.
    placed = ids.select("uid", "doc_id", "ids").repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    blocks = on_batches(placed, step, "uid long, doc_id long, piece int, n long, payload binary, checkpoints array<long>")
    blocks.write.parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str, each, schema: str) -> DataFrame:
    """Decode all blocks; ``each(ids)`` gives the values after (uid, doc_id, piece, n) in ``schema``."""
    stored_code = spark.read.parquet(f"{folder}/code").first()
    code = spark.sparkContext.broadcast(Code(np.frombuffer(bytes(stored_code.lengths), np.uint8)))
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 500):
            yield from decoded(batch.slice(at, 500))

    def decoded(batch: pa.RecordBatch):
        payload = batch.column("payload").cast(pa.large_binary())
        _, where, content = payload.buffers()
        offsets = np.frombuffer(where, np.int64)[payload.offset : payload.offset + len(payload) + 1]
        data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content is not None and content.size else np.zeros(0, np.uint8)
        first = offsets[:-1] - offsets[0]
        lists, n = batch.column("checkpoints"), batch.column("n").to_numpy()
        marks = lists.flatten().to_numpy()
        lanes = (n + STRIDE - 1) // STRIDE
        starts = marks + np.repeat(8 * first, lanes)
        lane_end = np.cumsum(lanes)
        values = []
        left = np.full(int(lanes.sum()), STRIDE)
        left[(lane_end - 1)[lanes > 0]] = (n - (lanes - 1) * STRIDE)[lanes > 0]
        short = left < STRIDE
        full = code.value.decode(data, starts[~short], STRIDE) if (~short).any() else None
        order = np.flatnonzero(short)
        order = order[np.argsort(left[order], kind="stable")]
        rest: dict[int, np.ndarray] = {}
        for group in np.array_split(order, min(8, len(order))) if len(order) else []:
            got = code.value.decode(data, starts[group], int(left[group].max()))
            for lane, ids in zip(group, got):
                rest[int(lane)] = ids[: left[lane]]
        at_full = np.cumsum(~short) - 1
        for i in range(batch.num_rows):
            a, b = int(lane_end[i] - lanes[i]), int(lane_end[i])
            parts = []
            whole = b - a - (1 if b > a and short[b - 1] else 0)
            if whole > 0:
                parts.append(full[at_full[a] : at_full[a] + whole].reshape(-1))
            if b - a > whole:
                parts.append(rest[b - 1])
            values.append(each(np.concatenate(parts) if parts else np.zeros(0, np.uint32)))
        columns = [batch.column(c) for c in ("uid", "doc_id", "piece", "n")] + [pa.array(v) for v in zip(*values)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = spark.read.parquet(f"{folder}/blocks").select("uid", "doc_id", "piece", "n", "payload", "checkpoints")
    return on_batches(blocks, step, schema)


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the second's length.

    Appending zero bytes is a linear map of the CRC register; it is squared up to the length.
    """

    def apply(matrix, vector):
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    step = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):
        step = [apply(step, column) for column in step]
    while length:
        if length & 1:
            first = apply(step, first)
        step = [apply(step, column) for column in step]
        length >>= 1
    return first ^ second


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "uid long, doc_id long, piece int, n long, crc long"
    pieces = stored(read_blocks(spark, folder, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), schema), "token-pieces")

    @F.udf("long")
    def folded(parts):
        crc = 0
        for _, n, one in sorted(parts):
            crc = crc_joined(crc, one, 4 * n)
        return crc

    # Only documents of several blocks need their checksums joined.
    long_ones = pieces.where("piece = 1").select("uid", "doc_id").distinct()
    keys = [pieces["doc_id"].eqNullSafe(long_ones["doc_id"]), pieces["uid"] == long_ones["uid"]]
    short = pieces.join(long_ones, keys, "left_anti").select("uid", "doc_id", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    several = pieces.join(long_ones, keys, "left_semi").groupBy("uid", "doc_id")
    several = several.agg(F.sum("n").alias("n_tokens"), F.collect_list(F.struct("piece", "n", "crc")).alias("parts"))  # one for each 2**20 ids
    docs = short.unionByName(several.select("uid", "doc_id", "n_tokens", folded("parts").alias("ids_crc32")))
    return running_start(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def running_start(docs: DataFrame) -> DataFrame:
    """``start``: the sum of n_tokens over all rows before, by (doc_id, uid). Ranges first, then rows within them."""
    placed = stored(docs.repartitionByRange("doc_id", "uid").withColumn("range", F.spark_partition_id()), "token-ranges")
    totals = placed.groupBy("range").agg(F.sum("n_tokens").alias("total"))  # one row per range
    before = F.coalesce(F.sum("total").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("range", before.alias("offset"))
    own = F.sum("n_tokens").over(W.partitionBy("range").orderBy("doc_id", "uid").rowsBetween(W.unboundedPreceding, 0))
    return placed.join(offsets, "range").withColumn("start", F.col("offset") + own - F.col("n_tokens"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/codevigil/token-file-{uuid.uuid4().hex}"
