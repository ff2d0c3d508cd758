"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged.

Vectors are dealt by a hash of their id into shards of about ``SHARD_ROWS``; each shard's
distinct vectors become a hierarchical graph whose neighbour lists are flat integer arrays,
written as one row per shard. Queries are cut into blocks, every block meets every shard's
row, and the best of all shards are merged. Distances are recomputed in double precision on
the original vectors.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite
component take no part, as query or candidate; a query is compared with vectors of its own
length only; rows that repeat an id and its vector count once; equal vectors are one node that
lists all its ids; ties go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch.llm.common import written

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 160
#: Walks that step together, and the nodes each of them opens in one step.
WALKS = 256
STEP = 4


class SmallWorld:
    """``neighbours[layer, node]`` holds node numbers, -1 where free; layer 0 has twice the links.

    Nodes come in in the order of their numbers: a node's candidates are the nearest nodes
    before it on its layer. A shard is small, so they are found by blocked matrix products
    instead of a walk per node.
    """

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray, entry: int = 0, top: int = 0):
        self.vectors, self.entry, self.top = vectors, entry, top
        self.neighbours = neighbours

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> SmallWorld:
        n = len(vectors)
        drawn = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(np.maximum(drawn, 1e-12)) / math.log(LINKS)).astype(int), 8)
        top = int(levels.max())
        graph = cls(vectors, np.full((top + 1, n, 2 * LINKS), -1, dtype=np.int32), int(levels.argmax()), top)
        for layer in range(top + 1):
            graph._link(np.flatnonzero(levels >= layer), layer)
        return graph

    def _link(self, nodes: np.ndarray, layer: int) -> None:
        """Links of one layer: spread ones to earlier nodes, and their reverse where there is room."""
        v, room = self.vectors[nodes], 2 * LINKS if layer == 0 else LINKS
        near, far = _earlier(v, BUILD_WIDTH)
        chosen = _spread(v, near, far, LINKS)
        source, slot = np.nonzero(chosen >= 0)
        target = chosen[source, slot]
        both = np.concatenate([np.stack([source, target]), np.stack([target, source])], axis=1)
        gaps = _square(v[both[0]] - v[both[1]])
        order = np.lexsort((both[1], gaps, both[0]))
        (owner, other), gaps = both[:, order], gaps[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < BUILD_WIDTH
        near = np.full((len(nodes), BUILD_WIDTH), -1, dtype=np.int64)
        far = np.full(near.shape, np.inf)
        near[owner[keep], place[keep]] = other[keep]
        far[owner[keep], place[keep]] = gaps[keep]
        links = _spread(v, near, far, room)
        self.neighbours[layer, nodes, :room] = np.where(links >= 0, nodes[links], -1)

    def nearest(self, queries: np.ndarray, width: int) -> list[np.ndarray]:
        """For every query the nodes, nearest first, that a best-first walk of this width keeps. All walks step together."""
        return [x for start in range(0, len(queries), WALKS) for x in self._walk(queries[start : start + WALKS], width)]

    def _walk(self, queries: np.ndarray, width: int) -> list[np.ndarray]:
        at = self._descend(queries)
        n_queries = len(queries)
        nodes = np.full((n_queries, width), -1, dtype=np.int64)
        gaps = np.full((n_queries, width), np.inf)
        done = np.zeros((n_queries, width), dtype=bool)
        seen = np.zeros((n_queries, len(self.vectors)), dtype=bool)
        nodes[:, 0], gaps[:, 0] = at, _square(self.vectors[at] - queries)
        seen[np.arange(n_queries), at] = True
        while True:
            todo = ~done & (nodes >= 0)
            active = np.flatnonzero(todo.any(axis=1))
            if not len(active):
                return [row[row >= 0] for row in nodes]
            # lists are sorted, so the first open places are the nearest open nodes
            places = np.argsort(~todo[active], axis=1, kind="stable")[:, :STEP]
            rows = np.repeat(active, places.shape[1])
            places = places.reshape(-1)
            opened = todo[rows, places]
            rows, places = rows[opened], places[opened]
            done[rows, places] = True
            met = self.neighbours[0, nodes[rows, places]]
            pairs = np.unique(np.repeat(rows, met.shape[1])[met.reshape(-1) >= 0] * len(self.vectors) + met[met >= 0])
            rows, met = pairs // len(self.vectors), pairs % len(self.vectors)
            new = ~seen[rows, met]
            rows, met = rows[new], met[new]
            if not len(rows):
                continue
            seen[rows, met] = True
            place = width + np.arange(len(rows)) - np.searchsorted(rows, rows)
            touched, row = np.unique(rows, return_inverse=True)
            wide = int(place.max()) + 1
            all_nodes = np.full((len(touched), wide), -1, dtype=np.int64)
            all_gaps, all_done = np.full(all_nodes.shape, np.inf), np.zeros(all_nodes.shape, dtype=bool)
            all_nodes[:, :width], all_gaps[:, :width], all_done[:, :width] = nodes[touched], gaps[touched], done[touched]
            all_nodes[row, place], all_gaps[row, place] = met, _square(self.vectors[met] - queries[rows])
            best = np.argsort(all_gaps, axis=1, kind="stable")[:, :width]
            nodes[touched] = np.take_along_axis(all_nodes, best, axis=1)
            gaps[touched] = np.take_along_axis(all_gaps, best, axis=1)
            done[touched] = np.take_along_axis(all_done, best, axis=1)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Where the walks of layer 0 begin: on every layer above, step to the nearest neighbour while it is nearer."""
        at = np.full(len(queries), self.entry)
        gap = _square(self.vectors[at] - queries)
        for layer in range(self.top, 0, -1):
            active = np.arange(len(queries))
            while len(active):
                met = self.neighbours[layer, at[active], :LINKS]
                gaps = np.where(met >= 0, _square(self.vectors[met] - queries[active, None]), np.inf)
                best = gaps.argmin(axis=1)
                least = gaps[np.arange(len(active)), best]
                nearer = least < gap[active]
                step, active = met[np.arange(len(active)), best][nearer], active[nearer]
                at[active], gap[active] = step, least[nearer]
        return at


def _square(gap: np.ndarray) -> np.ndarray:
    return np.einsum("...j,...j->...", gap, gap)


def _earlier(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every vector the ``most`` nearest before it, nearest first, and their squared distances; -1 and inf where fewer."""
    n = len(v)
    near, far = np.full((n, most), -1, dtype=np.int64), np.full((n, most), np.inf)
    square = _square(v)
    for start in range(0, n, 512):
        rows = np.arange(start, min(start + 512, n))
        gaps = square[rows, None] + square[None, : rows[-1] + 1] - 2 * v[rows] @ v[: rows[-1] + 1].T
        gaps[np.arange(rows[-1] + 1)[None, :] >= rows[:, None]] = np.inf
        kept = min(most, gaps.shape[1])
        best = np.argpartition(gaps, kept - 1, axis=1)[:, :kept]
        gaps = np.take_along_axis(gaps, best, axis=1)
        order = np.argsort(gaps, axis=1, kind="stable")
        best, gaps = np.take_along_axis(best, order, axis=1), np.take_along_axis(gaps, order, axis=1)
        far[rows, :kept] = gaps
        near[rows, :kept] = np.where(np.isinf(gaps), -1, best)
    return near, far


def _spread(v: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes at most ``most`` in different directions.

    A node is passed over while a chosen one is nearer to it than the row's own node is; what
    room is left goes to the nearest of those passed over.
    """
    n, width = near.shape
    out = np.full((n, most), -1, dtype=np.int64)
    for start in range(0, n, 256):
        ids, gaps = near[start : start + 256], far[start : start + 256]
        own = v[ids]
        square = _square(own)
        between = square[:, :, None] + square[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, dtype=bool)
        for k in range(width):
            free = (ids[:, k] >= 0) & (chosen.sum(axis=1) < most)
            covered = (np.where(chosen, between[:, k], np.inf) < gaps[:, k, None]).any(axis=1)
            chosen[:, k] = free & ~covered
        order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
        out[start : start + 256, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles, dim) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    return (
        table.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))
        .withColumn("dim", F.size("vector"))
    )


_INDEX = "dim int, shard int, n int, layers int, entry int, top int, ids binary, starts binary, vectors binary, neighbours binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    dim, shard = int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0])
    given = np.array(rows["vector"].tolist(), dtype=np.float64).reshape(len(rows), dim)
    ids = rows["vec_id"].to_numpy(dtype=np.int64)
    # sorted by id first, so the graph does not depend on the order of arrival
    order = np.lexsort((ids,))
    ids, given = ids[order], given[order]
    vectors, inverse = np.unique(given, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([inverse.reshape(-1), ids], axis=1), axis=0)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(vectors) + 1))
    mixed = np.random.default_rng(shard).permutation(len(vectors))
    vectors = vectors[mixed]
    flat = [pairs[starts[k] : starts[k + 1], 1] for k in mixed]
    graph = SmallWorld.build(vectors, shard + 1)
    row = {
        "dim": dim,
        "shard": shard,
        "n": len(vectors),
        "layers": len(graph.neighbours),
        "entry": graph.entry,
        "top": graph.top,
        "ids": np.concatenate(flat).astype("<i8").tobytes(),
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype("<i8").tobytes(),
        "vectors": vectors.astype("<f8").tobytes(),
        "neighbours": graph.neighbours.astype("<i4").tobytes(),
    }
    return pd.DataFrame([row])


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per shard with its graph; every usable vector is in one of them."""
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(_build, _INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found over all shards."""

    def run(key: tuple, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if len(shard) and len(block):
            row = shard.iloc[0]
            n, dim = int(row["n"]), int(row["dim"])
            vectors = np.frombuffer(row["vectors"], "<f8").reshape(n, dim)
            graph = SmallWorld(vectors, np.frombuffer(row["neighbours"], "<i4").reshape(int(row["layers"]), n, 2 * LINKS), int(row["entry"]), int(row["top"]))
            ids, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
            asked = np.array(block["vector"].tolist(), dtype=np.float64).reshape(len(block), dim)
            walked = graph.nearest(asked, max(width, k + 1))
            for query_id, mark, q, found in zip(block["vec_id"], block["query"], asked, walked):
                score = np.sqrt(((vectors[found] - q) ** 2).sum(axis=1))
                best = []
                for node, s in sorted(zip(found.tolist(), score.tolist()), key=lambda x: x[1]):
                    if len(best) >= k and s > best[k - 1][0]:
                        break
                    # k + 1 ids are enough: the smallest of a node, but for the query's own
                    best += [(s, int(i)) for i in ids[starts[node] : min(starts[node + 1], starts[node] + k + 1)] if i != query_id]
                    best.sort()
                for s, i in best[:k]:
                    for name, value in zip(out, (query_id, mark, i, s)):
                        out[name].append(value)
        return pd.DataFrame(out)

    asked = queries.withColumn("query", F.xxhash64("vec_id", "vector")).dropDuplicates(["vec_id", "query"])
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, query bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the usable rows whose id is divisible by ``every``."""
    vectors = usable(table)
    index = written(build_index(vectors), "ann-index")
    return search(index, vectors.where(F.col("vec_id") % every == 0), k)
