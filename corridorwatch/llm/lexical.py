"""Exact ranked lexical search: inner products over a ball tree of sparse vectors.

A document's vector has, per term, weight * ((10^9 tf) div (1000 tf + 12 m)); an item's vector
counts its terms, so a score is their inner product. Only dimensions that some item uses can
matter, so documents are projected onto the terms of the items.

Each task cuts its documents into shards of ``SHARD_ROWS`` and builds a ball tree of each:
nodes are split by the direction between two far rows down to leaves of ``LEAF_ROWS``; a
node has its rows' centroid and, per band of terms, the radius around it (bands are runs of
terms of like frequency, so common terms don't widen the ball for rare ones, nor
a band that an item doesn't touch). For an item q
the bound of a node is q . centroid + sum over bands of |q_band| * radius_band, enlarged by
``SLACK`` so that rounding never makes it too small. Nodes are opened best first; subtrees
whose bound is below the item's 20th best score so far are pruned (equal bounds aren't, as a
smaller id may still win), and leaves are scored in 64-bit integers. The best of each task
are merged by one more top-20.

Items are handled in blocks of at most ``BLOCK_TERMS`` terms, so what is sent to the tasks
is bounded; each further block is one more pass over the documents.

Defined results: a null or term-less text is in no result and counts nowhere; an item
without terms gives no rows; every row of either table counts, so rows that repeat an id are
ranked each (null ids last among equal scores) and items that repeat an id are answered each;
with no documents or no items there are no rows; texts are read whole whatever their length;
other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridorwatch.llm.common import map_rows, written

TOP = 20
SHARD_ROWS = 8192
#: Numbers in the centroids of a tree; with many terms, shards get fewer rows.
CENTROID_CELLS = 1 << 24
LEAF_ROWS = 32
BANDS = 2048
#: Relative enlargement of bounds; sums of some thousand doubles err by less than 1e-12.
SLACK = 1e-9
BLOCK_TERMS = 1 << 17
#: Outer bytes of UTF-8 text are letters here: the pattern on bytes equals the one on characters.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return _TERM.findall(text.encode().lower()) if text else []


def _items(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, Counter]]]:
    """Blocks of (item_id, term counts), read one partition at a time."""
    block: list[tuple[int, Counter]] = []
    size = 0
    for row in benchmark.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).toLocalIterator():
        found = Counter(terms(row["t"]))
        if not found:
            continue
        if block and size + len(found) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["k"], found))
        size += len(found)
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc_id, n, dims, tfs) for every row with a term: its length and its items' terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def project(batch: dict) -> dict:
        known = sent.value
        out: dict[str, list] = {"doc_id": [], "n": [], "dims": [], "tfs": []}
        for doc_id, value in zip(batch["doc_id"], batch["text"]):
            found = terms(value)
            if not found:
                continue
            counted = Counter(found)
            common = sorted((known[t], c) for t, c in counted.items() if t in known)
            out["doc_id"].append(doc_id)
            out["n"].append(len(found))
            out["dims"].append([d for d, _ in common])
            out["tfs"].append([c for _, c in common])
        return out

    given = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(given, project, "doc_id bigint, n bigint, dims array<int>, tfs array<bigint>")


@dataclass(frozen=True)
class Corpus:
    """What scores need of the whole corpus: documents, terms, and the weights of dimensions.

    Dimensions are put in the order of falling weight (``place``); bands are runs in that order.
    """

    n_docs: int
    n_terms: int
    place: np.ndarray
    weights: np.ndarray
    bands: np.ndarray

    @staticmethod
    def of(n_docs: int, n_terms: int, frequencies: np.ndarray) -> Corpus:
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequencies.tolist()], dtype=np.int64)
        order = np.argsort(-weights, kind="stable")
        place = np.empty(len(weights), dtype=np.int64)
        place[order] = np.arange(len(weights))
        return Corpus(n_docs, n_terms, place, weights[order], np.arange(len(weights)) * BANDS // max(len(weights), BANDS))

    def impacts(self, n: int, dims: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Weighted term frequencies of a text with ``n`` terms; ``dims`` are places."""
        m = 75 + (25 * n * self.n_docs) // self.n_terms
        return self.weights[dims] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))


@dataclass
class Rows:
    """Sparse rows: the entries of row i are ``at[i] : at[i + 1]`` of ``dims``, ascending, and ``values``."""

    ids: np.ndarray
    at: np.ndarray
    dims: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        lengths = self.at[rows + 1] - self.at[rows]
        at = np.concatenate([[0], np.cumsum(lengths)])
        entries = np.repeat(self.at[rows] - at[:-1], lengths) + np.arange(at[-1])
        return Rows(self.ids[rows], at, self.dims[entries], self.values[entries])

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """The sum of per-entry numbers for each row."""
        total = np.concatenate([[0], np.cumsum(entries)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def dot(self, vector: np.ndarray) -> np.ndarray:
        return self.sums(self.values * vector[self.dims])


@dataclass
class Node:
    start: int
    stop: int
    left: int = -1
    right: int = -1


@dataclass
class BallTree:
    """``rows`` in leaf order; node k has ``centroids[k]`` and ``radii[k]`` (per band)."""

    rows: Rows
    nodes: list[Node]
    centroids: np.ndarray
    radii: np.ndarray


def _ball(rows: Rows, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and, per band, the largest distance of a row from it."""
    n, width = len(rows.ids), len(bands)
    centroid = np.bincount(rows.dims, rows.values, minlength=width) / n
    # |x - c|^2 over a band = |c|^2 + sum over the row's entries of ((x - c)^2 - c^2)
    own = np.bincount(bands, centroid**2, minlength=BANDS)
    band = bands[rows.dims]
    key = np.repeat(np.arange(n), np.diff(rows.at)) * BANDS + band
    first = np.flatnonzero(np.diff(key, prepend=-1))
    x = rows.values.astype(np.float64)
    extra = np.add.reduceat(x * (x - 2 * centroid[rows.dims]), first)
    squares = np.add.reduceat(x**2, first)
    # rows without an entry in a band have the distance |c| there
    most = np.where(np.bincount(band[first], minlength=BANDS) < n, 0.0, -np.inf)
    np.maximum.at(most, band[first], extra)
    size = np.zeros(BANDS)
    np.maximum.at(size, band[first], squares)
    # the difference may cancel: its error is bounded by the size of what was subtracted
    return centroid, np.sqrt(np.maximum(own + most, 0) + 1e-10 * (own + size))


def _halves(rows: Rows, width: int) -> np.ndarray:
    """Which rows go left: nearer in direction to one of two rows far from each other, cut at the median."""
    dense = np.zeros(width)

    def product(i: int) -> np.ndarray:
        part = slice(rows.at[i], rows.at[i + 1])
        dense[rows.dims[part]] = rows.values[part]
        found = rows.dot(dense)
        dense[rows.dims[part]] = 0
        return found

    norms = rows.sums(rows.values.astype(np.float64) ** 2)
    first = int(np.argmax(norms - 2 * product(0)))
    a = product(first)
    second = int(np.argmax(norms - 2 * a))
    order = np.argsort(a - product(second), kind="stable")
    left = np.zeros(len(rows.ids), dtype=bool)
    left[order[: len(order) // 2]] = True
    return left


def build(rows: Rows, bands: np.ndarray) -> BallTree:
    """Halving keeps the depth at log2 of the rows, whatever they hold."""
    nodes, balls = [Node(0, len(rows.ids))], []
    order = np.arange(len(rows.ids))
    k = 0
    while k < len(nodes):
        node = nodes[k]
        inside = rows.take(order[node.start : node.stop])
        balls.append(_ball(inside, bands))
        if node.stop - node.start > LEAF_ROWS:
            left = _halves(inside, len(bands))
            own = order[node.start : node.stop]
            order[node.start : node.stop] = np.concatenate([own[left], own[~left]])
            middle = node.start + int(left.sum())
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(node.start, middle), Node(middle, node.stop)]
        k += 1
    return BallTree(rows.take(order), nodes, np.array([c for c, _ in balls]), np.array([r for _, r in balls]))


class Best:
    """The TOP best (score, smallest id) of an item so far."""

    def __init__(self) -> None:
        self.heap: list[tuple[int, int]] = []

    def least(self) -> int:
        """Rows must reach this score to matter."""
        return self.heap[0][0] if len(self.heap) == TOP else 1

    def offer(self, score: int, doc_id: int) -> None:
        if score <= 0:
            return
        entry = (score, -doc_id)
        if len(self.heap) < TOP:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


@dataclass(frozen=True)
class Queries:
    """Sparse items and the norms of their bands."""

    dims: list[np.ndarray]
    counts: list[np.ndarray]
    norms: np.ndarray

    @staticmethod
    def of(items: list[tuple[np.ndarray, np.ndarray]], bands: np.ndarray) -> Queries:
        norms = np.array([np.sqrt(np.bincount(bands[d], c.astype(np.float64) ** 2, minlength=BANDS)) for d, c in items])
        return Queries([d for d, _ in items], [c for _, c in items], norms)


def bounds(tree: BallTree, queries: Queries) -> np.ndarray:
    """No row below node k has a larger product with item q than ``result[q, k]``."""
    near = np.array([tree.centroids[:, d] @ c for d, c in zip(queries.dims, queries.counts)])
    return (near + queries.norms @ tree.radii.T) * (1 + SLACK) + 1


def search(tree: BallTree, queries: Queries, best: list[Best]) -> int:
    """Improves ``best`` by the rows of the tree; the number of rows scored."""
    limits = bounds(tree, queries)
    rows, nodes, scored = tree.rows, tree.nodes, 0
    vector = np.zeros(tree.centroids.shape[1], dtype=np.int64)
    for q, found in enumerate(best):
        limit = limits[q].tolist()
        if limit[0] < found.least():
            continue
        vector[queries.dims[q]] = queries.counts[q]
        open_nodes = [(-limit[0], 0)]
        while open_nodes:
            at, k = heapq.heappop(open_nodes)
            if -at < found.least():
                break
            node = nodes[k]
            if node.left >= 0:
                for child in (node.left, node.right):
                    if limit[child] >= found.least():
                        heapq.heappush(open_nodes, (-limit[child], child))
                continue
            a, b = rows.at[node.start], rows.at[node.stop]
            total = np.concatenate([[0], np.cumsum(rows.values[a:b] * vector[rows.dims[a:b]])])
            edges = rows.at[node.start : node.stop + 1] - a
            scores = total[edges[1:]] - total[edges[:-1]]
            scored += len(scores)
            for i in np.flatnonzero(scores >= found.least()).tolist():
                found.offer(int(scores[i]), int(rows.ids[node.start + i]))
        vector[queries.dims[q]] = 0
    return scored


def _shards(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Rows]:
    """Sparse rows of impacts, SHARD_ROWS at a time or fewer; rows without an item's term score 0 and are left out."""
    # halves of more than LEAF_ROWS / 2 rows: under 4 / LEAF_ROWS nodes a row
    full = max(min(SHARD_ROWS, CENTROID_CELLS // len(corpus.weights) * LEAF_ROWS // 4), LEAF_ROWS)

    def made(ids: list, dims: list, values: list) -> Rows:
        return Rows(np.array(ids, dtype=np.int64), np.concatenate([[0], np.cumsum([len(d) for d in dims])]), np.concatenate(dims), np.concatenate(values))

    ids: list[int] = []
    dims: list[np.ndarray] = []
    values: list[np.ndarray] = []
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        at, flat = columns[2].offsets.to_numpy(), columns[2].values.to_numpy()
        tfs = columns[3].values.to_numpy()
        for i, (doc_id, n) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist())):
            if at[i] == at[i + 1]:
                continue
            part = slice(at[i], at[i + 1])
            places = corpus.place[flat[part]]
            order = np.argsort(places)
            ids.append(_NO_ID if doc_id is None else doc_id)
            dims.append(places[order])
            values.append(corpus.impacts(n, places[order], tfs[part][order]))
            if len(ids) == full:
                yield made(ids, dims, values)
                ids, dims, values = [], [], []
    if ids:
        yield made(ids, dims, values)


def _search_block(docs: DataFrame, items: list[tuple[int, Counter]], key: str, text: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in items))))}
    rows = written(vectors(docs, vocabulary, key, text), "lexical-vectors")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    frequencies = np.zeros(len(vocabulary), dtype=np.int64)
    # one row per dimension: at most BLOCK_TERMS, or the terms of one item
    for dim, n in rows.select(F.explode("dims").alias("dim")).groupBy("dim").count().toLocalIterator():
        frequencies[dim] = n
    corpus = Corpus.of(totals["n"], max(totals["l"], 1), frequencies)
    place = corpus.place.tolist()
    sparse = [tuple(np.array(x, dtype=np.int64) for x in zip(*sorted((place[vocabulary[t]], n) for t, n in c.items()))) for _, c in items]
    queries = Queries.of(sparse, corpus.bands)
    sent = docs.sparkSession.sparkContext.broadcast((corpus, queries))
    item_ids = [k for k, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, queries = sent.value
        best = [Best() for _ in item_ids]
        for shard in _shards(batches, corpus):
            search(build(shard, corpus.bands), queries, best)
        rows = [(q, -i, score) for q, b in enumerate(best) for score, i in b.heap]
        if rows:
            q, ids, scores = zip(*rows)
            ids = [None if i == _NO_ID else i for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    found = rows.select("doc_id", "n", "dims", "tfs").mapInArrow(run, "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    names = docs.sparkSession.createDataFrame(list(enumerate(item_ids)), "item int, item_id bigint")
    return written(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "lexical-found")


def ranked_search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each item, all documents searched."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in _items(benchmark, item, item_text):
        found = found.unionByName(_search_block(docs, block, key, text))
    return found


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = rf"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PATTERN}')) AS t
    FROM documents
), tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths
), df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t
), items AS (
    SELECT item_id, t, count(*)::BIGINT AS c
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_PATTERN}')) AS t FROM benchmark)
    GROUP BY ALL
), scored AS (
    SELECT i.item_id, tf.doc_id,
           sum(i.c * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
               * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
    FROM items i JOIN df USING (t) JOIN tf USING (t) JOIN lengths l ON l.doc_id = tf.doc_id, totals
    GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""
