"""Embedding near-dedup: balls found over hierarchical navigable small-world graphs, one per shard.

Vectors are dealt into shards by hash. A shard puts near copies into balls: any two members of a
ball are at half the linking angle from its leader, so they are linked without a test. The
leaders form the shard's graph, and a vector that the graph does not lead to its ball only makes one
more leader. All leaders of all shards are then compared with every shard's leaders by matrix products,
in blocks: a search of the graph can miss leaders, whole groups of them where a group's members are nearer
to one another than to the rest, and an audit of samples does not show it. Pairs of balls that the
angles between and within them decide are settled whole; of other pairs the members are compared by
cosine in double precision, tile by tile. Components are unions of balls.

So a group of near copies, however large, costs its balls and not its pairs, unless its vectors lie
around the linking angle from one another.

Defined results: vectors that are null, empty or zero, or that hold null or non-finite components,
link with nothing; vectors of different length are not compared; one row per input row, rows that
share a vec_id count as separate vectors; a vector without id is no component's name; extra columns
are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, on_batches, runs, stored

#: Vectors of a shard, and the least number of shards.
SHARD_ROWS, LEAST_SHARDS = 200_000, 6
#: Leaders in one block of queries.
BLOCK_ROWS = 16_384
#: Neighbours of a node, on the upper levels and on the lowest.
DEGREE, LOWEST_DEGREE = 12, 24
BUILD_BEAM, BEAM = 32, 16
TILE = 512
#: Queries and leaders in one matrix product.
COMPARED = 2048
_EPSILON = 1e-9


class Graph:
    """Vectors and their levels. Searches work on many queries at once, in step."""

    def __init__(self, dim: int):
        self.vectors = np.zeros((0, dim), np.float32)
        self.levels: list[np.ndarray] = []  # neighbours by level: rows are nodes, -1 where there is none
        self.near: list[np.ndarray] = []
        self.top, self.top_depth = np.zeros(0, np.int64), -1

    def search(self, level: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of up to ``beam`` nearest nodes per query, best first; -1 where there is none."""
        count, size = len(queries), len(self.vectors)
        step = max(1, min(1024, (1 << 26) // max(1, size)))
        if count > step:
            parts = [self.search(level, queries[i : i + step], entry[i : i + step], beam) for i in range(0, count, step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        links = self.levels[level]
        seen = np.zeros((count, size), bool)
        nodes = np.full((count, beam), -1)
        near = np.full((count, beam), -np.inf, np.float32)
        fresh = np.zeros((count, beam), bool)
        active = np.arange(count)
        found = entry
        while len(active):
            # Take in the nodes found, each once.
            new = np.full(found.shape, -np.inf, np.float32)
            for j in range(found.shape[1]):
                column = found[:, j]
                some = np.flatnonzero(column >= 0)
                some = some[~seen[active[some], column[some]]]
                seen[active[some], column[some]] = True
                new[some, j] = 0
            take = np.isfinite(new)
            row, col = np.nonzero(take)
            new[row, col] = np.einsum("ij,ij->i", queries[active[row]], self.vectors[found[row, col]])
            all_nodes = np.concatenate([nodes[active], np.where(take, found, -1)], 1)
            all_near = np.concatenate([near[active], new], 1)
            all_fresh = np.concatenate([fresh[active], take], 1)
            best = np.argsort(-all_near, 1, kind="stable")[:, :beam]
            nodes[active] = np.take_along_axis(all_nodes, best, 1)
            near[active] = np.take_along_axis(all_near, best, 1)
            fresh[active] = np.take_along_axis(all_fresh, best, 1)
            active = active[fresh[active].any(1)]
            if not len(active):
                break
            # Visit the best four that have not been visited.
            order = np.argsort(~fresh[active], 1, kind="stable")[:, :4]
            chosen = np.take_along_axis(nodes[active], order, 1)
            open_ = np.take_along_axis(fresh[active], order, 1)
            np.put_along_axis(mark := fresh[active], order, False, 1)
            fresh[active] = mark
            chosen = np.where(open_, chosen, -1)
            found = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        return nodes, near

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Search from the top level down."""
        if not len(self.vectors):
            return np.full((len(queries), beam), -1), np.full((len(queries), beam), -np.inf, np.float32)
        entry = np.repeat(self.top[None, :1], len(queries), 0)
        for level in range(len(self.levels) - 1, 0, -1):
            entry = self.search(level, queries, entry, 4)[0]
        return self.search(0, queries, entry, beam)

    def add(self, vectors: np.ndarray, depth: np.ndarray) -> None:
        """Add nodes whose highest levels are ``depth``; they see the graph and one another."""
        first, queries = len(self.vectors), vectors.astype(np.float32)
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        entry = None
        found = {}
        if first:
            entry = np.repeat(self.top[None, :1], len(queries), 0)
            for level in range(len(self.levels) - 1, -1, -1):
                nodes, near = self.search(level, queries, entry, BUILD_BEAM)
                found[level] = nodes, near
                entry = nodes[:, :4]
        self.vectors = np.concatenate([self.vectors, queries])
        total = len(self.vectors)
        for level in range(max(len(self.levels), int(depth.max(initial=0)) + 1)):
            degree = LOWEST_DEGREE if level == 0 else DEGREE
            if level == len(self.levels):
                self.levels.append(np.full((first, degree), -1))
                self.near.append(np.full((first, degree), -np.inf, np.float32))
            own = np.flatnonzero(depth >= level)
            links = np.concatenate([self.levels[level], np.full((total - first, degree), -1)])
            near = np.concatenate([self.near[level], np.full((total - first, degree), -np.inf, np.float32)])
            if len(own):
                nodes, sims = np.repeat(own[None, :] + first, len(own), 0), among[np.ix_(own, own)]
                if level in found:
                    nodes = np.concatenate([found[level][0][own], nodes], 1)
                    sims = np.concatenate([found[level][1][own], sims], 1)
                best = np.argsort(-sims, 1, kind="stable")[:, :degree]
                target, value = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
                target = np.where(np.isfinite(value), target, -1)
                links[own + first, : target.shape[1]] = target
                near[own + first, : target.shape[1]] = value
                # Links back: each node keeps its nearest.
                source = np.repeat(own + first, target.shape[1])
                target, value = target.reshape(-1), value.reshape(-1)
                use = target >= 0
                self._back(links, near, target[use], source[use], value[use])
            self.levels[level], self.near[level] = links, near
        if int(depth.max()) > self.top_depth:
            self.top, self.top_depth = np.array([first + int(np.argmax(depth))]), int(depth.max())

    @staticmethod
    def _back(links: np.ndarray, near: np.ndarray, to: np.ndarray, source: np.ndarray, value: np.ndarray) -> None:
        degree = links.shape[1]
        order = np.lexsort((-value, to))
        to, source, value = to[order], source[order], value[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        use = rank < degree
        at = np.repeat(np.arange(len(nodes)), count)
        new, new_near = np.full((len(nodes), degree), -1), np.full((len(nodes), degree), -np.inf, np.float32)
        new[at[use], rank[use]], new_near[at[use], rank[use]] = source[use], value[use]
        twice = (new[:, :, None] == links[nodes][:, None, :]).any(2)
        new_near[twice] = -np.inf
        both, both_near = np.concatenate([links[nodes], new], 1), np.concatenate([near[nodes], new_near], 1)
        best = np.argsort(-both_near, 1, kind="stable")[:, :degree]
        near[nodes] = np.take_along_axis(both_near, best, 1)
        links[nodes] = np.where(np.isfinite(near[nodes]), np.take_along_axis(both, best, 1), -1)


def build(vectors: np.ndarray, angle: float, seed: int) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph over leaders, the leader's row for each node, the node of each vector's ball)."""
    rng = np.random.default_rng(seed)
    graph = Graph(vectors.shape[1])
    close = np.cos(angle / 2 - _EPSILON)
    leaders: list[int] = []
    ball = np.full(len(vectors), -1)
    at = 0
    while at < len(vectors):
        size = min(1024, max(128, len(leaders)))
        rows = np.arange(at, min(len(vectors), at + size))
        at += size
        own = vectors[rows]
        if leaders:
            nodes, _ = graph.nearest(own.astype(np.float32), BEAM)
            first = np.maximum(nodes[:, 0], 0)
            exact = np.einsum("ij,ij->i", own, vectors[np.array(leaders)[first]])
            joins = (nodes[:, 0] >= 0) & (exact >= close)
            ball[rows[joins]] = first[joins]
        rest = rows[ball[rows] < 0]
        near = vectors[rest] @ vectors[rest].T >= close
        new = []
        for i in range(len(rest)):
            if ball[rest[i]] < 0:
                follow = rest[i:][near[i, i:] & (ball[rest[i:]] < 0)]
                ball[follow] = len(leaders) + len(new)
                ball[rest[i]] = len(leaders) + len(new)
                new.append(int(rest[i]))
        if new:
            depth = np.minimum(8, (-np.log(1 - rng.random(len(new))) / np.log(DEGREE)).astype(np.int64))
            graph.add(vectors[new], depth)
            leaders += new
    return graph, np.array(leaders, np.int64), ball


def _unit_rows(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, dim, unit): ``unit`` the normalised vector as doubles, null where it links with nothing."""

    def step(batch: pa.RecordBatch):
        units, dims = [], []
        for value in batch.column(2):
            unit = None
            if value.is_valid and len(value.values) and value.values.null_count == 0:
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and (most := np.abs(x).max()) > 0:
                    x = x / most
                    unit = (x / np.sqrt((x * x).sum())).tobytes()
            units.append(unit)
            dims.append(len(unit) // 8 if unit else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["uid", "vec_id", "dim", "unit"])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return on_batches(rows, step, "uid long, vec_id long, dim int, unit binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _balls(rows: DataFrame, shards: int, angle: float) -> DataFrame:
    """Per shard: a row for each vector with its ball, and one row with the leaders."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dim, shard = int(key[0]), int(key[1])
        frame = frame.sort_values("uid")
        vectors, uid = _matrix(frame["unit"], dim), frame["uid"].to_numpy()
        _, leaders, ball = build(vectors, angle, shard)
        cosine = np.clip(np.einsum("ij,ij->i", vectors, vectors[leaders[ball]]), -1, 1)
        spread = np.where(np.arange(len(ball)) == leaders[ball], 0.0, np.arccos(cosine) + _EPSILON)
        radius = np.zeros(len(leaders))
        np.maximum.at(radius, ball, spread)
        size = np.bincount(ball, minlength=len(leaders))
        out = pd.DataFrame({"dim": dim, "shard": shard, "uid": uid, "ball": uid[leaders[ball]], "radius": radius[ball], "size": size[ball], "leaders": None})
        data = io.BytesIO()
        np.savez(data, radius=radius, size=size, uid=uid[leaders], exact=vectors[leaders])
        last = pd.DataFrame({"dim": [dim], "shard": [shard], "uid": [None], "ball": [None], "radius": [None], "size": [None], "leaders": [data.getvalue()]})
        return pd.concat([out.astype(object), last], ignore_index=True)

    schema = "dim int, shard long, uid long, ball long, radius double, size long, leaders binary"
    dealt = rows.where("unit is not null").select("uid", "dim", "unit", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("dim", "shard").applyInPandas(one, schema)


def _hits(leaders: np.ndarray, radius: np.ndarray, queries: np.ndarray, reach: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, leaders) within reach of one another: all such pairs, compared tile by tile."""
    least = np.cos(np.minimum(np.pi, angle + reach + radius.max())) - 1e-5
    queries = queries.astype(np.float32)
    rows, nodes = [], []
    for j in range(0, len(leaders), COMPARED):
        other = leaders[j : j + COMPARED].astype(np.float32).T
        for i in range(0, len(queries), COMPARED):
            row, node = np.nonzero(queries[i : i + COMPARED] @ other >= least[i : i + COMPARED, None])
            rows.append(row + i)
            nodes.append(node + j)
    return np.concatenate(rows), np.concatenate(nodes)


_PAIR = "a long, b long, size_a long, size_b long, whole boolean"


def _ball_pairs(rows: DataFrame, balls: DataFrame, angle: float, threshold: float) -> DataFrame:
    """Pairs of balls that may link; ``whole``: all their members do."""
    leaders = balls.where("uid = ball").select("dim", "ball", "radius", "size")
    queries = leaders.join(rows.select(F.col("uid").alias("ball"), "unit"), "ball")
    shown = balls.where("leaders is not null").select("dim", "shard", "leaders")
    count = leaders.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("blocks"))  # a row for each vector length
    asked = queries.join(count, "dim").withColumn("block", F.pmod(F.xxhash64("ball"), F.col("blocks")))
    asked = asked.join(shown.select("dim", "shard"), "dim").drop("blocks")  # every block asks every shard
    shown = shown.join(count, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def ask(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["a", "b", "size_a", "size_b", "whole"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series(dtype="bool" if n == "whole" else "int64") for n in names})
        parts = np.load(io.BytesIO(right["leaders"].iloc[0]))
        parts = {name: parts[name] for name in parts.files}
        left = left.sort_values("ball")
        vectors, radius, uid = _matrix(left["unit"], int(key[0])), left["radius"].to_numpy(), left["ball"].to_numpy()
        row, node = _hits(parts["exact"], parts["radius"], vectors, radius, angle)
        other = uid[row] != parts["uid"][node]
        row, node = row[other], node[other]
        cosine = np.einsum("ij,ij->i", vectors[row], parts["exact"][node])
        theta = np.arccos(np.clip(cosine, -1, 1))
        spread = radius[row] + parts["radius"][node]
        points = spread == 0
        whole = np.where(points, cosine >= threshold, theta + spread <= angle - _EPSILON)
        maybe = whole | (~points & (theta - spread <= angle + _EPSILON))
        row, node, whole = row[maybe], node[maybe], whole[maybe]
        mine, theirs = uid[row], parts["uid"][node]
        sizes, others = left["size"].to_numpy()[row], parts["size"][node]
        swap = mine > theirs
        return pd.DataFrame({"a": np.where(swap, theirs, mine), "b": np.where(swap, mine, theirs), "size_a": np.where(swap, others, sizes), "size_b": np.where(swap, sizes, others), "whole": whole})

    asked = asked.toDF(*[f"q_{c}" if c in ("dim", "shard", "block") else c for c in asked.columns])
    return asked.groupBy("q_dim", "q_shard", "q_block").cogroup(shown.groupBy("dim", "shard", "block")).applyInPandas(ask, _PAIR).distinct()


def _compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(uid, n, a, b): links of single members across pairs of balls, counted per tile."""
    tiles = lambda size: F.ceil(F.col(size) / TILE).cast("long")
    pairs = pairs.select("a", "b", tiles("size_a").alias("ta"), tiles("size_b").alias("tb"))
    own = F.xxhash64("uid")
    left = pairs.join(members.withColumnRenamed("ball", "a"), "a").withColumn("i", F.pmod(own, F.col("ta"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tb") - 1)))
    right = pairs.join(members.withColumnRenamed("ball", "b"), "b").withColumn("j", F.pmod(own, F.col("tb"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ta") - 1)))
    names = ["a", "b", "i", "j", "side", "uid", "unit"]
    rows = left.withColumn("side", F.lit(0)).select(names).unionByName(right.withColumn("side", F.lit(1)).select(names))

    def step(batches):
        for table in runs(batches, ["a", "b", "i", "j"]):
            side, uid = table["side"].to_numpy(), table["uid"].to_numpy()
            units = table["unit"].to_pylist()
            vectors = _matrix(units, len(units[0]) // 8)
            linked = vectors[side == 0] @ vectors[side == 1].T >= threshold
            count = np.concatenate([linked.sum(1), linked.sum(0)])
            uid = np.concatenate([uid[side == 0], uid[side == 1]])
            use = count > 0
            if use.any():
                n = int(use.sum())
                columns = [pa.array(uid[use]), pa.array(count[use]), pa.array(np.full(n, table["a"][0].as_py())), pa.array(np.full(n, table["b"][0].as_py()))]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "n", "a", "b"])

    return rows.repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j").mapInArrow(step, "uid long, n long, a long, b long")


def linked_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors at cosine >= threshold), component_id (smallest vec_id over links) and kept."""
    angle = float(np.arccos(threshold))
    rows = stored(_unit_rows(vectors), "hnsw-units")
    shards = max(LEAST_SHARDS, -(-rows.where("unit is not null").count() // SHARD_ROWS))
    balls = stored(_balls(rows, shards, angle), "hnsw-balls")
    pairs = stored(_ball_pairs(rows, balls, angle, threshold), "hnsw-pairs")
    members = balls.where("uid is not null").select("uid", "ball", "size")
    single = stored(_compared(pairs.where("not whole"), members.select("uid", "ball").join(rows.select("uid", "unit"), "uid"), threshold), "hnsw-compared")
    edges = pairs.where("whole").select("a", "b").unionByName(single.select("a", "b")).distinct()
    found = stored(components(edges, "hnsw"), "hnsw-components")
    whole = pairs.where("whole")
    across = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("size_a").alias("n")))
    across = across.groupBy("ball").agg(F.sum("n").alias("n_whole"))
    alone = single.groupBy("uid").agg(F.sum("n").alias("n_single"))
    placed = members.join(found.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    placed = placed.join(across, "ball", "left").join(alone, "uid", "left")
    zero = F.lit(0).cast("long")
    n_links = F.col("size") - 1 + F.coalesce("n_whole", zero) + F.coalesce("n_single", zero)
    out = rows.select("uid", "vec_id").join(placed.select("uid", "component", n_links.alias("n_links")), "uid", "left")
    least = out.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "component", "left")
    name = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), name.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
