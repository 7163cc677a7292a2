"""Exact top-k inner products by M-trees: paged metric nodes, covering radii, parent distances, best-first search.

Vectors are dealt by hash into shards of bounded bytes; a shard's tree is built once and stored as one row. Queries come in
blocks of bounded bytes; a block meets each shard once, on the shard's number. Each shard answers with its own best k, and the best of these are
the answer: no bound is guessed, so the result is exact.

For a node with routing object p and an entry o below, the stored distance d(o, p) and the lengths of both say how much of o lies along p and how much
beside it; q.o is at most the product of what lies along p plus that of what lies beside. That needs no computation with o. For any x of a
subtree with routing object o, covering radius r and greatest length m: q.x <= q.o + |q| r, and 2 q.x <= |q|^2 + m^2 - max(0, d(q, o) - r)^2. Entries
and subtrees these rule out are never touched. Where vectors have no clusters, as random directions of many dimensions, no metric
bound can rule out much, and the search reads nearly all.

Vectors that are null, empty, or hold null or non-finite components take no part, as query or candidate; nor do null ids. Shorter vectors count
as padded with 0. Rows alike in id and vector are one. Fewer than k candidates: all of them. A row's own id is no candidate. An empty table
gives an empty one. Other columns of the table are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import bounded_batches, stored

PAGE = 128
FAN = 16
#: Bytes of vectors, 8 a component, in a tree and in a block of queries.
SHARD_BYTES = BLOCK_BYTES = 8 << 20


class Entries:
    """What a node knows of its entries without touching them: how much of each lies along the routing object and how much beside it."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, away: np.ndarray, route: float):
        self.rows = rows
        self.along = (route**2 + lengths**2 - away**2) / (2 * route) if route else np.zeros(len(rows))
        self.beside = np.sqrt(np.maximum(0.0, lengths**2 - self.along**2))

    def most(self, along: float, beside: float) -> np.ndarray:
        """The largest inner product each can have with a query that has so much along the routing object and beside it."""
        return self.along * along + self.beside * beside


class MTree:
    """Nodes of one shard. ``ids`` and ``vectors``: the shard's rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lengths = np.sqrt((vectors**2).sum(1)) if len(ids) else np.zeros(0)
        #: node: (routing row, radius, greatest length, children or None, entries)
        self.nodes: list[tuple] = []
        #: inner products are whole numbers; what is rounded in a bound is far less than this
        self.room = 0.5 + 1e-12 * float(self.lengths.max(initial=0)) ** 2
        self.root = self._build(np.arange(len(ids))) if len(ids) else None

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - self.vectors[to]) ** 2).sum(1))

    def _build(self, rows: np.ndarray) -> int:
        centre = self.vectors[rows].mean(0)
        route = int(rows[((self.vectors[rows] - centre) ** 2).sum(1).argmin()])
        far = self._distances(rows, route)
        parts = self._split(rows, far) if len(rows) > PAGE else []
        children = np.array([self._build(p) for p in parts], int) if parts else None
        below = rows if children is None else np.array([self.nodes[c][0] for c in children])
        away = far if children is None else self._distances(below, route)
        entries = Entries(below, self.lengths[below], away, float(self.lengths[route]))
        self.nodes.append((route, float(far.max()), float(self.lengths[rows].max()), children, entries))
        return len(self.nodes) - 1

    def _split(self, rows: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """Rows by nearest of up to FAN pivots, each the farthest from those before; rows all alike by number."""
        pages = -(-len(rows) // PAGE)
        if far.max() == 0:
            return np.array_split(rows, min(FAN, pages))
        near, own = self._distances(rows, int(rows[far.argmax()])), np.zeros(len(rows), int)
        for k in range(1, min(FAN, pages)):
            if near.max() == 0:
                break
            d = self._distances(rows, int(rows[near.argmax()]))
            own[d < near] = k
            near = np.minimum(near, d)
        return [rows[own == k] for k in range(own.max() + 1) if (own == k).any()]

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k largest inner products, ties to smaller ids; rows with id ``own`` are left out."""
        if self.root is None:
            return []
        length = float(np.sqrt((query**2).sum()))
        room = self.room + 1e-12 * length**2
        best: list[tuple[float, int]] = []  # heap of (score, -id)

        def bound(node: int, score: float) -> float:
            route, radius, most, _, _ = self.nodes[node]
            apart = max(0.0, length**2 + self.lengths[route] ** 2 - 2 * score) ** 0.5
            return min(score + length * radius, (length**2 + most**2 - max(0.0, apart - radius) ** 2) / 2, length * most) + room

        score = float(self.vectors[self.nodes[self.root][0]] @ query)
        queue = [(-bound(self.root, score), self.root, score)]
        while queue:
            most, node, score = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else -np.inf
            if -most < least:
                break
            route, _, _, children, entries = self.nodes[node]
            along = score / self.lengths[route] if self.lengths[route] else 0.0
            hope = entries.most(along, max(0.0, length**2 - along**2) ** 0.5) + room
            if children is not None:
                radii = np.array([self.nodes[c][1] for c in children])
                hope = hope + length * radii >= least
                for c, row in zip(children[hope].tolist(), entries.rows[hope].tolist(), strict=True):
                    s = float(self.vectors[row] @ query)
                    if (b := bound(c, s)) >= least:
                        heapq.heappush(queue, (-b, c, s))
                continue
            hopeful = entries.rows[hope >= least]
            if not len(hopeful):
                continue
            scores, ids = self.vectors[hopeful] @ query, self.ids[hopeful]
            if len(best) == k:
                good = scores >= least
                scores, ids = scores[good], ids[good]
            elif len(scores) > k:
                order = np.lexsort((ids, -scores))[: k + 1]
                scores, ids = scores[order], ids[order]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return sorted(((int(s), -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Integer-valued rows as doubles, exact up to 2**53; padded with 0."""
    width = width or max((len(x) for x in column), default=0)
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : min(len(x), width)] = x[:width]
    return out


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v) with v = floor(scale * x) of each component, for the rows that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")).distinct()


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``is_query`` (a condition on ``id``) holds, against all rows."""
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = vectors.filter(is_query)
    each = 8 * max(1, width or 0)
    n_shards = max(1, -(-n * each // SHARD_BYTES))
    # blocks no larger than their bytes, and enough tasks where there are few shards
    n_asked = asked.count()
    n_blocks = max(1, -(-n_asked * each // BLOCK_BYTES), min(spark.sparkContext.defaultParallelism // n_shards, n_asked))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(part["id"].to_numpy(), _matrix(part["v"].tolist(), width))
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "tree": [pickle.dumps(tree, 5)]})

    shard = F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).cast("int")
    trees = stored(vectors.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, tree binary"), "m-trees")
    blocks = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    # a task each: a block's search in a shard is the unit of work, and a tree and a block are of a size
    met = trees.join(blocks.hint("shuffle_hash"), "shard").repartition(n_shards * n_blocks)

    def search(batches):
        for pdf in batches:
            for tree, queries in zip(pdf["tree"], pdf["queries"], strict=True):
                t = pickle.loads(tree)
                out = [(q["id"], i, s) for q in queries for s, i in t.search(_matrix([q["v"]], width)[0], q["id"], k)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = met.select("tree", "queries").mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
