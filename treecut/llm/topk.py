"""Operator 1, exact top-k search by columnar branch and bound.

Vectors become integers, floor(SCALE * x).  Queries go to the tasks in blocks of
bounded size; each task turns its vectors into tiles in vertical layout (a row
per dimension) and adds the inner products up block of dimensions by block.
After each, a pair stays only if its partial score plus the product of what is
left of both norms (Cauchy-Schwarz) can still reach the query's k-th best score
so far; survivors are compacted.  The first bounds are the scores among the
queries of a block themselves.  A task returns k rows per query at most, and
Spark ranks those of all tasks.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; only vectors of the query's length are
compared; a query id that repeats is one query (its smallest vector); other
repeated rows are candidates each; scores outside 64 bits are cut to them;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stored

SCALE = 1024
#: Queries of a block, vectors of a tile, dimensions added between bounds.
QUERIES = 2048
TILE = 4096
DIMENSIONS = 16
#: Doubles add integers exactly below this.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def whole(vector: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vector.astype(np.float64))


class Block:
    """A block of queries of one length, and their best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        # Dimensions in which the queries have most mass come first.
        self.order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.order]
        self.largest = float(np.abs(vectors).max(initial=0))
        self.cuts = list(range(0, vectors.shape[1], DIMENSIONS)) + [vectors.shape[1]]
        self.rest = self.norms(self.vectors.T)
        self.least = np.full(len(ids), -np.inf)
        if self.exact(self.largest) and len(ids) > k:
            among = self.vectors @ self.vectors.T
            np.fill_diagonal(among, -np.inf)
            self.least = np.partition(among, -k, axis=1)[:, -k]
        self.best = (np.zeros(0, np.int64), np.zeros(0, object if not self.exact(self.largest) else np.float64), np.zeros(0, np.int64))

    def exact(self, largest: float) -> bool:
        return len(self.order) * self.largest * max(largest, self.largest) < EXACT

    def norms(self, columns: np.ndarray) -> list[np.ndarray]:
        """Norms of what is left of each vector from every cut on."""
        return [np.sqrt(np.square(columns[c:]).sum(axis=0)) for c in self.cuts]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score a tile of candidates (a row per vector)."""
        if not len(ids):
            return
        if not self.exact(float(np.abs(vectors).max(initial=0))):
            # Too large for doubles: whole numbers of any size, without bounds.
            scores = np.array([[int(x) for x in v] for v in self.vectors], dtype=object) @ np.array([[int(x) for x in v] for v in vectors[:, self.order]], dtype=object).T
            q, x = np.indices(scores.shape).reshape(2, -1)
            return self.keep(q, np.clip(scores, -_LONG - 1, _LONG).reshape(-1), ids[x])
        columns = np.ascontiguousarray(vectors[:, self.order].T)
        rest = self.norms(columns)
        scores = np.zeros((len(self.ids), len(ids)))
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        for i, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:]), 1):
            if pairs is None:
                scores += self.vectors[:, lo:hi] @ columns[lo:hi]
                bound = scores + self.rest[i][:, None] * rest[i] * (1 + 1e-9) + 1e-6
                alive = bound >= self.least[:, None]
                if 4 * np.count_nonzero(alive) < alive.size:
                    pairs = np.nonzero(alive)
                    scores = scores[pairs]
            else:
                q, x = pairs
                for d in range(lo, hi):
                    scores += self.vectors[q, d] * columns[d, x]
                alive = scores + self.rest[i][q] * rest[i][x] * (1 + 1e-9) + 1e-6 >= self.least[q]
                pairs, scores = (q[alive], x[alive]), scores[alive]
        if pairs is None:
            pairs = np.nonzero(scores >= self.least[:, None])
            scores = scores[pairs]
        self.keep(pairs[0], scores, ids[pairs[1]])

    def keep(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        other = self.ids[q] != ids
        q, scores, ids = (np.concatenate((a, b[other])) for a, b in zip(self.best, (q, scores, ids)))
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < self.k
        order, q = order[top], q[top]
        self.best = (q, scores[order], ids[order])
        full = np.flatnonzero(np.arange(len(q)) - first[top] == self.k - 1)
        self.least[q[full]] = np.maximum(self.least[q[full]], self.best[1][full].astype(np.float64))

    def rows(self) -> tuple[np.ndarray, list[int], np.ndarray]:
        q, scores, ids = self.best
        return self.ids[q], [int(s) for s in scores], ids


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Ids and vectors that take part."""
    limit = F.lit(float("inf"))  # NaN counts as above it
    finite = F.forall("vector", lambda v: F.coalesce((v < limit) & (v > -limit), F.lit(False)))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(finite)


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best rows for every row for
    which ``is_query`` (a condition on ``vec_id``) holds."""
    rows = usable(vectors, key, vector)
    asked = stored(rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n = max(1, -(-asked.count() // QUERIES))
    found = None
    for i in range(n):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).toArrow()  # about QUERIES rows
        part = _search(rows, own["vec_id"].to_numpy(), own["vector"].to_pylist(), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, ids: np.ndarray, vectors: list[list[float]], k: int) -> DataFrame:
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = np.array([len(v) for v in vectors], dtype=int)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        by_length[length] = ids[at], whole(np.array([vectors[i] for i in at], dtype=np.float64).reshape(len(at), length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {length: Block(*own, k) for length, own in by_length.items()}
        for batch in batches:
            key, column = batch.column("vec_id").to_numpy(), batch.column("vector")
            start = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            size = np.diff(start)
            for length, block in blocks.items():
                at = np.flatnonzero(size == length)
                for lo in range(0, len(at), TILE):
                    own = at[lo : lo + TILE]
                    block.add(key[own], whole(values[start[own][:, None] + np.arange(length)]))
        names = ["query_id", "score", "vec_id"]
        for block in blocks.values():
            query, score, other = block.rows()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(score, pa.int64()), pa.array(other, pa.int64())], names=names)

    return rows.mapInArrow(run, "query_id long, score long, vec_id long")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    found = top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
