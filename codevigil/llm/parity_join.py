"""N-gram Jaccard join by parity sketches.

Two sets with similarity num/den or more differ in at most d elements, d growing with their
size. The elements of a set are hashed into m > d blocks (m follows the size in steps: the size
bands), and each block keeps the parity of its elements as a sketch of 2**32 bits, of which the odd
ones are held, as the XOR of their hashes. By the
pigeonhole principle at least m - d blocks of such a pair agree, so both sets share one of
their first d + 1 blocks in any fixed order of block sketches; the order here puts sketches
with many bits first, because they are the rarest, and m is so much larger than d that blocks of
fewer than two elements are seldom among them. Sharing a block makes a candidate, a wide
parity sketch bounds the symmetric difference from below, and the sets themselves decide.

Nothing is lost: within a block's group every member is compared with the group's smallest
member, and later with every member that is not yet known to be in its component.

Defined results: a null or word-free text has the empty set and links with nothing; equal
sets are one node, named by the smallest id that has the set; rows that share an id are one document,
so what links with either is linked; a row without id keeps its row but has no component; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, on_batches, signed, stored
from .shingles import shingle_sets

#: Bits of the short sketch; the wide one has as many as the set has elements, or more.
SHORT = 1024
#: Members of one block that one task compares with one another; larger groups are split into tiles.
TILE = 1024


def most_different(size: int, num: int, den: int) -> int:
    """Largest symmetric difference between a set of this size and any set similar to it."""
    return (den - num) * size // num


def band(size: int, num: int, den: int) -> int:
    """Number of blocks for pairs whose larger set has this size: the first of 2, 3, 4, 6, 9, ... over 1.2 d."""
    blocks = 2
    while 5 * blocks <= 6 * most_different(size, num, den):
        blocks = blocks * 3 // 2
    return blocks


def block_keys(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first d + 1 block keys of a set, in every band that a similar set can put it in."""
    size = len(elements)
    most = most_different(size, num, den)
    if most == 0:
        return np.zeros(0, np.uint64)
    bits = mix((elements & np.uint64(0xFFFFFFFF)) + np.uint64(1))
    out = []
    smallest, largest = band(size, num, den), band(size * den // num, num, den)
    blocks = smallest
    while blocks <= largest:
        block = ((elements >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.diff(block, prepend=-1))
        sketch, count = np.zeros(blocks, np.uint64), np.zeros(blocks, np.int64)
        sketch[block[heads]] = np.bitwise_xor.reduceat(bits, heads)
        count[block[heads]] = np.diff(np.append(heads, size))
        names = np.arange(blocks, dtype=np.uint64) + np.uint64(blocks << 32)
        keys = mix(mix(names) ^ (sketch * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((keys, -count))
        out.append(keys[order[: most + 1]])
        blocks = blocks * 3 // 2
    return np.concatenate(out)


def wide_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the elements by the low bits of their hash, as 64-bit integers; folds to any smaller power of two."""
    width = max(SHORT, 1 << (len(elements) - 1).bit_length())
    place = (mix(elements) >> np.uint64(32)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).view(np.int64)


def short_sketch(wide: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(wide.reshape(-1, SHORT // 64), axis=0)


def _signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    schema = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch array<long>, wide array<long>, keys array<long>"

    def step(batch: pa.RecordBatch):
        ids = batch.column(0)
        numbers = ids.to_pylist()
        rows, seen = [], {}
        with np.errstate(over="ignore"):
            for row, elements in shingle_sets(batch.column(1), k):
                size = len(elements)
                d1 = int(signed(np.bitwise_xor.reduce(mix(elements + np.uint64(1)), keepdims=True))[0]) if size else 0
                d2 = int(signed(np.sum(mix(elements ^ np.uint64(0xABCDEF12345)), dtype=np.uint64, keepdims=True))[0]) if size else 0
                rows.append([row, size, d1, d2, None, None])
                if not size or numbers[row] is None:
                    continue
                # Of equal texts in a batch, the one with the smallest id carries sketch and keys.
                first = seen.get((size, d1, d2))
                if first is None:
                    rows[-1][4:] = [wide_sketch(elements), signed(block_keys(elements, num, den))]
                elif numbers[row] < numbers[first]:
                    rows[row][4:], rows[first][4:] = rows[first][4:], [None, None]
                else:
                    continue
                seen[size, d1, d2] = row
        keys = [r[5] for r in rows]
        offsets = np.cumsum([0, *[0 if x is None else len(x) for x in keys]])
        flat = [x for x in keys if x is not None and len(x)]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
        columns = [ids.cast(pa.int64()), batch.column(2), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)], pa.array([None if r[4] is None else short_sketch(r[4]) for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.int64())), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "sketch", "wide", "keys"])

    return on_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), step, schema)


def _shared_keys(keys: DataFrame) -> DataFrame:
    """Rows (key, node) of the keys that two nodes or more have. A pass over sorted rows that holds one row back."""

    def run(batches):
        last = (None, None, True)  # key, node, whether it has been given out
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            fresh[0] = (key[0], node[0]) != last[:2]
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            out = np.zeros(len(key), bool)
            out[1:] |= same
            out[:-1] |= same
            if last[0] is not None and key[0] == last[0]:
                out[0] = True
                if not last[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], names=["key", "node"])
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], names=["key", "node"])
            last = (int(key[-1]), int(node[-1]), bool(out[-1]))

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def _across(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of nodes that share a key and lie in different components.

    Rows come sorted by (key, i, j); side 0 holds the members of tile i, side 1 those of tile j.
    Pairs that the sketches rule out are never made rows.
    """

    def pairs(rows: pa.Table, last: np.ndarray):
        """Pairs within runs; ``last`` is the end of each row's run."""
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        component, size = rows["component"].to_numpy(), rows["n"].to_numpy()
        split = rows["i"].to_numpy() != rows["j"].to_numpy()
        sketch = rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        x, shift = np.arange(len(node)), 1
        while len(x := x[x + shift < last[x]]):
            y = x + shift
            fit = (component[x] != component[y]) & (~split[x] | (side[x] != side[y]))
            fit &= np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num
            one, two = x[fit], y[fit]
            gap = np.bitwise_count(sketch[one] ^ sketch[two]).sum(1, dtype=np.int64)
            near = gap * (den + num) <= (den - num) * (size[one] + size[two])
            one, two = node[one[near]], node[two[near]]
            yield np.stack([np.minimum(one, two), np.maximum(one, two)], 1)
            shift += 1

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            key, i, j = (rows[c].to_numpy() for c in ("key", "i", "j"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cut = np.concatenate([[0], edge, [len(key)]])
            done = int(cut[-2])
            yield from give(rows.slice(0, done), np.repeat(cut[1:-1], np.diff(cut[:-1])))
            held = rows.slice(done).combine_chunks()
        if held is not None:
            yield from give(held, np.full(held.num_rows, held.num_rows))

    def give(rows, last):
        found = list(pairs(rows, last)) if rows.num_rows else []
        if found and len(both := np.unique(np.concatenate(found), axis=0)):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _possible(pairs: DataFrame, about: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and wide sketches do not rule out."""
    left, right = (about.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"s_{x}")) for x in ("a", "b"))
    near = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num

    def folded(sketch: str, other: str):
        half = (F.size(sketch) / 2).cast("int")
        fold = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sketch) == 2 * F.size(other), fold).otherwise(F.col(sketch))

    gap = F.aggregate(F.zip_with(folded("s_a", "s_b"), folded("s_b", "s_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))
    both = pairs.join(left, "a").join(right, "b").where(near)
    # A node holds several sets where an id is repeated.
    return both.where(gap * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose sets are similar enough. Only the texts of documents in pairs are read into sets."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = texts.join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    sets = stored(_sets(chosen, k), "parity-sets")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s"))
    return stored(both.where(F.col("c") * (num + den) >= F.col("s") * num).select("a", "b"), "parity-links")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set) and component_id.

    Documents link when den * |A & B| >= num * |A | B| over sets of ``k``-word shingles;
    component_id is the smallest id reachable over links, the document itself included.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labelled = _labelled(texts, k, num, den, True)
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def _labelled(texts: DataFrame, k: int, num: int, den: int, join_ids: bool) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, node, component_id); ``join_ids`` links the sets of one id."""
    signatures = stored(_signatures(texts, k, num, den), "parity")
    named = signatures.where("n_shingles > 0")
    node = named.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node"))
    node = stored(node, "parity-nodes")
    same = [F.col(f"{c}") == F.col(f"own_{c}") for c in ("n_shingles", "d1", "d2")]
    owners = node.select(*[F.col(c).alias(f"own_{c}") for c in ("n_shingles", "d1", "d2")], F.col("node").alias("own"))
    held = named.where("sketch is not null").join(owners, [F.col("doc_id") == F.col("own"), *same], "left_semi")
    keys = held.where("size(keys) > 0").select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    shared = stored(_shared_keys(keys), "parity-shared")

    about = held.dropDuplicates(["doc_id", "n_shingles", "d1", "d2"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch", "wide")
    hubs = shared.groupBy("key").agg(F.min("node").alias("a"))
    star = shared.join(hubs, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    star = stored(_possible(star, about, num, den), "parity-star")
    links = _verified(star, texts, k, num, den)
    if join_ids:
        digest = F.struct("n_shingles", "d1", "d2")
        several = named.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id")
        links = links.unionByName(named.join(several, "doc_id", "left_semi").join(node, ["n_shingles", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    found = stored(components(links, "parity"), "parity-components")

    placed = shared.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi and c > 2")  # a pair has been compared
    tiles = F.ceil(F.col("c") / TILE).cast("long")
    open_rows = placed.join(mixed.select("key", tiles.alias("tiles")), "key").join(about.drop("wide"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    open_rows = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    groups = open_rows.select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "node",
        "component",
        "n",
        "sketch",
    )
    rest = stored(_possible(_across(groups, num, den).join(star, ["a", "b"], "left_anti"), about, num, den), "parity-rest")
    if not rest.isEmpty():
        more = _verified(rest, texts, k, num, den)
        found = stored(components(links.unionByName(more), "parity"), "parity-components")

    label = node.join(found, "node", "left").select("n_shingles", "d1", "d2", "node", F.coalesce("component", "node").alias("component_id"))
    out = signatures.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(label, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", "node", "component_id")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def step(batch: pa.RecordBatch):
        found = [(row, signed(elements)) for row, elements in shingle_sets(batch.column(1), k) if len(elements)]
        if found:
            offsets = np.cumsum([0, *[len(x) for _, x in found]])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([x for _, x in found])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in found])), lists], names=["node", "elements"])

    return on_batches(texts, step, "node long, elements array<long>")


def one_per_component(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents without those that another document of their component stands for; the smallest id stays.

    Columns stay as they are. Documents without words stay; so do rows without id. Of rows that share an id
    a copy of a text that a smaller id has goes by itself; those whose texts no smaller id has stay or go together.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = _labelled(texts, k, num, den, False).where("n_shingles > 0 and (node <> doc_id or component_id <> node)")
    gone = marked.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
