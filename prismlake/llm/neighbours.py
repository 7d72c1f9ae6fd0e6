"""Approximate nearest neighbours by collision-counting hashing.

Each of ``PROJECTIONS`` random directions gives one array of projected values, sorted.  A
query opens a window around its own value in every array and counts, for each vector, in
how many windows it lies.  The windows are widened step by step (virtual rehashing: the
same arrays serve every radius); a vector whose count reaches the collision threshold is
verified by its exact cosine.  The widening stops when ``VERIFY_SHARE`` of a block's
vectors (``VERIFY_LEAST`` at least) have been verified, or all.

Vectors are split into blocks by hash; a block's arrays are built in the task that
searches it, so that an index never exceeds a block and a lost task is just run again.
Queries are split likewise, every query block meets every vector block, and a block
returns at most k rows for a query.

Measured recall against brute force is above 0.95 on the test tables (see the tests).

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows with a null id; only vectors of equal length are compared; equal rows
count once, as one candidate; only the id and vector columns are read, so others cannot clash;
rows that share the query's id are its own; ties go to the smaller id; with k
or fewer candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import materialize

PROJECTIONS = 64
THRESHOLD = 0.65           # share of the windows that a vector must lie in
FIRST_WIDTH = 0.08         # half width of the first windows, in units of a unit vector's projection
WIDEN = 1.2
VERIFY_SHARE = 0.3
VERIFY_LEAST = 512
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 1 << 14
SEED = 20


class CollisionIndex:
    """The sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], projections)) / np.sqrt(vectors.shape[1])
        values = (vectors / self.norms[:, None]) @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.sort(values, axis=0).T.copy()

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best verified vectors, best first."""
        norm = np.sqrt((query * query).sum())
        own = query / norm @ self.axes
        n, m = len(self.ids), len(own)
        need = min(n, k + 1 + max(VERIFY_LEAST, int(VERIFY_SHARE * n)))
        counts = np.zeros(n, np.int32)
        low = high = np.array([np.searchsorted(v, x) for v, x in zip(self.values, own)])
        width = FIRST_WIDTH
        while True:
            new_low = np.array([np.searchsorted(v, x - width) for v, x in zip(self.values, own)])
            new_high = np.array([np.searchsorted(v, x + width, "right") for v, x in zip(self.values, own)])
            for j in range(m):
                counts[self.order[j, new_low[j]:low[j]]] += 1
                counts[self.order[j, high[j]:new_high[j]]] += 1
            low, high = new_low, new_high
            found = np.flatnonzero(counts >= THRESHOLD * m)
            if len(found) >= need or (low == 0).all() and (high == n).all():
                break
            width *= WIDEN
        found = found[self.ids[found] != query_id]
        scores = (self.vectors[found] * query).sum(1) / (self.norms[found] * norm)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows (largest cosine) of every row for which ``queries`` holds:
    query_id, rank, vec_id, score."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                        F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = materialize(rows.where(F.col("id").isNotNull() & _usable(F.col("vector"))).distinct())
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    rows = rows.withColumn("dim", F.size("vector")).withColumn("hash", F.xxhash64("id", "vector"))

    def spread(own: str, blocks: int, other: str, others: int, df: DataFrame) -> DataFrame:
        """Rows in their own block, once for each block of the other side."""
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select("dim", F.pmod("hash", F.lit(blocks)).cast("int").alias(own), each.alias(other), "id", "vector")

    left = spread("block", blocks, "part", query_blocks, rows).groupBy("dim", "block", "part")
    right = spread("part", query_blocks, "block", blocks, rows.where("asked")).groupBy("dim", "block", "part")

    def search(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(asked):
            index = CollisionIndex(vectors["id"].to_numpy(np.int64), np.stack(vectors["vector"].to_list()))
            for i, q in zip(asked["id"].tolist(), asked["vector"].to_list()):
                ids, scores = index.search(i, np.asarray(q), k)
                out["query_id"] += [i] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
