"""Dense retrieval over memory cells, overlays and tombstones.

A cell fires for a query if activation - theta > 0, activation being the inner product. The query set is stated and
bounded; it is sent to the executors in blocks, and each tile of cells is multiplied with a block at once, so that a task's
memory depends on neither table's size. A task returns its best k cells per query, so the final ranking sees k rows per task and query, however many cells there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import stored

THETA = 0.22
OVERLAY_THETA = 0.30
#: Cells that are multiplied with a block of queries at once.
TILE = 512


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, TILE at most at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            yield batch.slice(at, TILE)


def query_blocks(queries: DataFrame, extra: str | None = None, kind=np.int64, block: int = 2048) -> Iterator:
    """Broadcasts of (ids, vectors as a matrix, the extra column) for `block` queries or so at a time. The query set is stored first, so that it is not made again for each block."""
    spark = queries.sparkSession
    fields = [F.col("query_id").cast("long"), "vector", *([F.col(extra)] if extra else [])]
    chosen = stored(queries.select(*fields), "queries")
    parts = max(1, -(-chosen.count() // block))
    for part in range(parts):
        rows = chosen.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        ids = rows["query_id"].to_numpy(np.int64)
        q = np.stack([np.asarray(v, np.float64) for v in rows["vector"]]) if len(rows) else np.zeros((0, 1))
        more = rows[extra].fillna(-1).to_numpy(kind) if extra else None
        yield spark.sparkContext.broadcast((ids, q, more))


class Best:
    """Of each of n queries the `keep` entries of the greatest keys so far, then of the smaller ids. held: the query's place, key, id and `more` values of each, in order."""

    def __init__(self, n: int, keep: int, more: int = 0):
        self.n, self.keep = n, keep
        self.held = [np.zeros(0, t) for t in (np.int64, float, np.int64, *[float] * more)]
        self.least = np.full(n, -np.inf)  # the key that an entry must reach

    def add(self, key: np.ndarray, ids: np.ndarray, *values: np.ndarray) -> None:
        """key and values: a row per query, a column per id. A key of -inf, or one that isn't a number, is no entry."""
        key = np.where(key > -np.inf, key, -np.inf)
        if len(ids) > self.keep:
            self.least = np.maximum(self.least, np.partition(key, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep])
        i, j = np.nonzero((key >= self.least[:, None]) & (key > -np.inf))
        if not len(i):
            return
        held = [np.concatenate(x) for x in zip(self.held, (i, key[i, j], ids[j], *(v[i, j] for v in values)))]
        order = np.lexsort((held[2], -held[1], held[0]))
        first = np.searchsorted(held[0][order], np.arange(self.n))
        order = order[np.arange(len(order)) - first[held[0][order]] < self.keep]
        self.held = [x[order] for x in held]
        n = np.bincount(self.held[0], minlength=self.n)
        full = n == self.keep
        self.least[full] = np.maximum(self.least[full], self.held[1][n.cumsum()[full] - 1])


def scored(cells: DataFrame, queries: DataFrame, keep: int, by: str, fired_only: bool, block: int = 2048) -> DataFrame:
    """query_id, cell_id, act, theta, margin: for each query each task's best `keep` cells, by margin or act (to 9 decimals), then the smaller id.

    cells: cell_id, weight, theta; queries: query_id, vector. Queries are collected `block` at a time. Cells with a null weight are
    passed over.
    """
    schema = "query_id long, cell_id long, act double, theta double, margin double"
    out = None
    for sent in query_blocks(queries, block=block):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, _ = sent.value
            best = Best(len(ids), keep, 3)  # act, theta, margin
            for tile in tiles(batches) if len(ids) else ():
                cell = tile.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                theta = tile.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                act = q @ matrix(tile.column(1)).T
                margin = act - theta
                key = np.round(margin if by == "margin" else act, 9)
                best.add(np.where(margin > 0, key, -np.inf) if fired_only else key, cell, act, np.broadcast_to(theta, act.shape), margin)
            if len(best.held[0]):
                columns = [ids[best.held[0]], *best.held[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "cell_id", "act", "theta", "margin"])

        made = cells.where("weight IS NOT NULL").select(F.col("cell_id").cast("long"), "weight", F.col("theta").cast("double")).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


def topk(cells: DataFrame, queries: DataFrame, k: int = 10, by: str = "margin", include_silent: bool = False) -> DataFrame:
    """query_id, rank (1 to k), cell_id, act, margin, fired. by: the ranking key; include_silent: cells that don't fire rank too."""
    key = F.round(F.col(by), 9)
    w = Window.partitionBy("query_id").orderBy(key.desc(), "cell_id")
    found = scored(cells, queries, k, by, not include_silent)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "cell_id", "act", "margin", (F.col("margin") > 0).alias("fired"))


def as_cells(embeddings: DataFrame, theta: float = THETA) -> DataFrame:
    """The supplied vectors in the shape of a bank of cells."""
    return embeddings.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("weight"), F.lit(theta).alias("theta"), "label")


def as_queries(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set: each row whose id is divisible by `every`."""
    return embeddings.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def without_tombstones(cells: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Cells that no tombstone names; applied below any ranking."""
    return cells.join(tombstones.select(F.col("base_cell_id").alias("cell_id")).distinct(), "cell_id", "left_anti")


def with_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base and overlay cells with a source column. An overlay id that the base has already is an error."""
    if not base.join(overlay, "cell_id", "left_semi").isEmpty():
        raise ValueError("overlay ids collide with base ids")
    return base.withColumn("source", F.lit("base")).unionByName(overlay.withColumn("source", F.lit("overlay")))


def candidate_status(found: DataFrame) -> DataFrame:
    """Ranked candidates with their status: accepted above the threshold, else below_threshold."""
    return found.select("query_id", "rank", "cell_id", F.round("act", 6).alias("act"), F.when(F.col("margin") > 0, "above_threshold").otherwise("below_threshold").alias("status"))


def reranked(found: DataFrame, scores: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """The recall pool in the order of an outside score (query_id, cell_id, score): the cut to k comes first, the floor after it."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cell_id")
    out = found.join(scores, ["query_id", "cell_id"]).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)
    return out if min_score is None else out.where(F.col("score") >= min_score)


def reranked_texts(found: DataFrame, scores: DataFrame, texts: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """reranked() where a cell without a text (cell_id, text) comes after all others, whatever its score; a floor takes it out. A null score counts as none too."""
    there = texts.where(F.coalesce("text", F.lit("")) != "").select("cell_id", F.lit(True).alias("_text"))
    least = F.lit(float("-inf"))
    judged = scores.join(there, "cell_id", "left").withColumn("score", F.when(F.col("_text"), F.coalesce("score", least)).otherwise(least)).drop("_text")
    return reranked(found, judged, k, min_score)
