"""Exact top-k inner products with a vector-approximation file.

Vectors become integers; every component is quantised to a cell of its dimension. The file holds blocks of
ids, one-byte cells and exact vectors as separate columns. A query scans the cells for lower and upper bounds of
the score, then takes exact vectors in the order of their bounds until no bound can reach the k-th score.
Queries go over the file in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voidscope.session import stage, staging_path

SCALE = 1024
CELLS = 64
BLOCK_ROWS = 2048
QUERY_BLOCK = 1024  # mean number of queries sent to the executors at once
TOP = 10
EVERY = 100
_STEP = 32  # exact vectors taken at a time
_SAFE = 1 << 62


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` of each component; vectors that are NULL or hold NULL or non-finite
    components take no part, and repeated equal rows count once."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).distinct()


def _dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of one width; a shorter vector counts as padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class ApproximationFile:
    """Cell bounds per dimension and the written blocks of ``vectors(vec_id, v)``."""

    def __init__(self, vectors: DataFrame):
        vectors = stage(vectors, "va-vectors")
        self.vectors = vectors
        self.width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
        low, high = self._extent(vectors)
        span = high - low + 1
        cell = np.arange(CELLS + 1)[None, :]
        edges = low[:, None] + -(-cell * span[:, None] // CELLS)  # smallest value of each cell
        self.low, self.span = low, span
        self.lower, self.upper = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
        self.blocks = stage(self._write(vectors), "va-file")

    def _extent(self, vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and width:
                    v = _dense(batch.column("v"), width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(width)), pa.array(v.min(axis=0)), pa.array(v.max(axis=0))], ["d", "low", "high"])

        rows = vectors.select("v").mapInArrow(run, "d long, low long, high long").groupBy("d").agg(
            F.min("low"), F.max("high")).orderBy("d").collect()  # one row per dimension
        extent = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3)
        return extent[:, 1], extent[:, 2]

    def _write(self, vectors: DataFrame) -> DataFrame:
        width, low, span = self.width, self.low, self.span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(start, BLOCK_ROWS)
                    v = _dense(part.column("v"), width)
                    wide = (v - low).astype(object) if width and int(span.max()) > _SAFE // CELLS else v - low
                    cells = (wide * CELLS // span).astype(np.uint8)
                    ids = part.column("vec_id").to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.tobytes()], pa.binary()) for x in (ids, cells, v)], ["ids", "cells", "exact"])

        return vectors.mapInArrow(run, "ids binary, cells binary, exact binary")

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each row of
        ``queries(vec_id, v)`` with every row of another id; ties go to the smaller ``vec_id``."""
        n = queries.count()
        blocks = max(1, -(-n // QUERY_BLOCK))
        spark = self.blocks.sparkSession
        path = staging_path(spark, "va-results")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        for b in range(blocks):  # one block's queries are on the driver at a time, its results go to the shared folder
            some = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
            shared = spark.sparkContext.broadcast(self._bounds(some))
            ranked = self._search(shared, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            shared.destroy()
        return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)

    def _bounds(self, rows: list) -> tuple[np.ndarray, ...]:
        """Ids and vectors of some queries, and the bounds of the cells."""
        q = np.zeros((len(rows), self.width), np.int64)
        for i, r in enumerate(rows):
            q[i, : len(r["v"])] = r["v"]
        return np.array([r["vec_id"] for r in rows], np.int64), q, self.lower.astype(float), self.upper.astype(float)

    def _search(self, shared, k: int) -> DataFrame:
        """The best ``k`` of each task for the broadcast queries."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, lower, upper = shared.value
            best = [(np.zeros(0, object if _wide(q, lower, upper) else np.int64), np.zeros(0, np.int64)) for _ in ids]
            for batch in batches:
                for one in batch.to_pylist():
                    vec = np.frombuffer(one["ids"], np.int64)
                    cells = np.frombuffer(one["cells"], np.uint8).reshape(len(vec), width)
                    exact = np.frombuffer(one["exact"], np.int64).reshape(len(vec), width)
                    best = scan(ids, q, lower, upper, vec, cells, exact, best, k)
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([v for _, v in best])),
                    pa.array(np.concatenate([s for s, _ in best]).tolist(), pa.int64()),
                ], ["query_id", "vec_id", "score"])

        return self.blocks.mapInArrow(run, "query_id long, vec_id long, score long")


def _wide(q: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> bool:
    """Whether scores can leave 62 bits."""
    if not q.size:
        return False
    largest = np.maximum(np.abs(lower), np.abs(upper)).max(axis=1)
    return float((np.abs(q.astype(float)) @ largest).max()) >= _SAFE


def scan(ids, q, lower, upper, vec, cells, exact, best, k):
    """One block of the file: bounds from the cells, then exact vectors in bound order for each query."""
    at = np.arange(cells.shape[1])[None, :]
    low, high = lower[at, cells], upper[at, cells]
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    slack = 1e-12 * (np.abs(q).astype(float) @ np.maximum(np.abs(lower), np.abs(upper)).max(axis=1, initial=0))
    upper_bound = plus @ high.T + minus @ low.T + slack[:, None]
    lower_bound = plus @ low.T + minus @ high.T - slack[:, None]
    own = ids[:, None] == vec[None, :]
    upper_bound[own] = lower_bound[own] = -np.inf
    out = []
    for i, (scores, found) in enumerate(best):
        limit = float(scores[-1]) if len(scores) == k else -np.inf
        if len(vec) >= k:
            limit = max(limit, np.partition(lower_bound[i], -k)[-k])
        some = np.flatnonzero((upper_bound[i] >= limit) & ~own[i])
        some = some[np.argsort(-upper_bound[i, some], kind="stable")]
        wide = scores.dtype == object
        for start in range(0, len(some), _STEP):
            if len(scores) == k and upper_bound[i, some[start]] < float(scores[-1]):
                break  # the k-th result is certain
            take = some[start:start + _STEP]
            new = exact[take].astype(object) @ q[i].astype(object) if wide else exact[take] @ q[i]
            scores, found = np.concatenate([scores, new]), np.concatenate([found, vec[take]])
            order = np.lexsort((found, -scores))[:k] if not wide else np.array(
                sorted(range(len(scores)), key=lambda j: (-scores[j], found[j]))[:k], int)
            scores, found = scores[order], found[order]
        out.append((scores, found))
    return out


def top_k(embeddings: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """Top ``k`` of every valid row whose id is divisible by ``every``, against all valid rows but its own id.

    NULL and non-finite vectors take no part; shorter vectors count as padded with zeros; an id with several
    different vectors is queried with each (results of such an id are ranked together). Further columns are not
    read. An empty table gives an empty result.
    """
    file = ApproximationFile(integers(embeddings))
    return file.search(file.vectors.filter(F.col("vec_id") % every == 0), k)
