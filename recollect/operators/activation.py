"""Statistics over all pairs of queries and cells.

Pairs are never listed: each task multiplies its cells, a tile at a time, with a block of queries and returns counts, sums or
extremes, which Spark adds up. Values near a quantile are the only ones that leave a task, as distinct values with their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.retrieval import matrix, query_blocks, tiles

SELF, SAME, OTHER = 0, 1, 2
#: Names of the kinds of pairs: a query with its own cell, with one of its label, with any other.
KINDS = {SELF: "self", SAME: "same", OTHER: "other"}


def per_task(cells: DataFrame, queries: DataFrame, work: Callable, schema: str, how: dict[str, str], block: int = 2048) -> DataFrame:
    """What `work` makes of each tile of cells and each block of queries, put together by task: how (sum, min or max) for each column that is no key.

    cells: cell_id, weight, label; queries: query_id, vector, query_label. work gets the queries' ids, the cells' ids, their
    activations (a row per query) and kinds, and returns arrays, one per column of the schema, or None. Cells with a null
    weight are passed over; a null label equals none.
    """
    out = None
    rows = cells.where("weight IS NOT NULL").select(F.col("cell_id").cast("long"), "weight", F.coalesce(F.col("label").cast("long"), F.lit(-(1 << 62))).alias("label"))
    names = [x.split()[0] for x in schema.split(", ")]

    def together(parts: list[pa.Table]) -> pa.Table:
        made = pa.concat_tables(parts).group_by([n for n in names if n not in how]).aggregate(list(how.items()))
        return made.select([f"{n}_{how[n]}" if n in how else n for n in names]).rename_columns(names)

    for sent in query_blocks(queries, "query_label", block=block):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, labels = sent.value
            held: list[pa.Table] = []
            for tile in tiles(batches) if len(ids) else ():
                cell, label = (tile.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                act = q @ matrix(tile.column(1)).T
                kind = np.where(cell[None, :] == ids[:, None], SELF, np.where(label[None, :] == labels[:, None], SAME, OTHER))
                made = work(ids, cell, act, kind)
                if made is not None:
                    held.append(pa.Table.from_arrays([pa.array(c) for c in made], names=names))
                if len(held) >= 16:
                    held = [together(held)]
            if held:
                yield from together(held).combine_chunks().to_batches()

        made = rows.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


def summary(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """Per kind of pair that occurs: kind, n, lo, hi, mean and variance (population) of the activations."""

    def work(ids, cell, act, kind):
        parts = [(k, act[kind == k]) for k in KINDS]
        parts = [(k, v) for k, v in parts if len(v)]
        return [np.array(c) for c in zip(*[(k, len(v), v.min(), v.max(), v.sum(), (v * v).sum()) for k, v in parts])] if parts else None

    sums = per_task(cells, queries, work, "kind long, n long, lo double, hi double, s double, ss double", {"n": "sum", "lo": "min", "hi": "max", "s": "sum", "ss": "sum"}).groupBy("kind").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("kind", "n", "lo", "hi", mean.alias("mean"), F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def counts_above(cells: DataFrame, queries: DataFrame, edges: np.ndarray, within: tuple[float, float] = (-np.inf, np.inf)) -> DataFrame:
    """kind, place and n: how many pairs lie above exactly `place` of the edges (ascending; above means greater). within (lo, hi]: pairs outside don't count."""
    edges = np.asarray(edges, np.float64)

    def work(ids, cell, act, kind):
        here = (act > within[0]) & (act <= within[1])
        place = np.searchsorted(edges, act[here], "left")
        n = np.bincount(kind[here] * (len(edges) + 1) + place, minlength=3 * (len(edges) + 1))
        at = np.flatnonzero(n)
        return at // (len(edges) + 1), at % (len(edges) + 1), n[at]

    return per_task(cells, queries, work, "kind long, place long, n long", {"n": "sum"}).groupBy("kind", "place").agg(F.sum("n").alias("n"))


def quantile(cells: DataFrame, queries: DataFrame, kind: int, share: float, bins: int = 1 << 14, ranked: int = 1 << 20) -> float | None:
    """The exact quantile (linear between neighbours) of one kind's activations; None without pairs.

    Histograms narrow the interval that holds the two values asked for, until it has `ranked` pairs or fewer (or no width);
    its distinct values alone are put in order.
    """
    known = summary(cells, queries).where(F.col("kind") == kind).first()
    if known is None:
        return None
    inside, below = known["n"], 0
    wanted = share * (inside - 1)
    ranks = int(np.floor(wanted)), int(np.ceil(wanted))
    lo, hi = float(np.nextafter(known["lo"], -np.inf)), known["hi"]
    while inside > ranked and hi - lo > 1e-12:
        edges = np.linspace(lo, hi, bins + 1)[1:-1]
        counted = counts_above(cells, queries, edges, (lo, hi)).where(F.col("kind") == kind).orderBy("place").toPandas()
        upto = below + counted["n"].cumsum().to_numpy()
        first, last = (int(np.searchsorted(upto, r, "right")) for r in ranks)
        below = int(upto[first - 1]) if first else below
        inside = int(upto[last]) - below
        places = [int(counted["place"][i]) for i in (first, last)]
        narrow = (float(edges[places[0] - 1]) if places[0] else lo), (float(edges[places[1]]) if places[1] < len(edges) else hi)
        if narrow == (lo, hi):
            break
        lo, hi = narrow

    def work(ids, cell, act, kinds):
        v, many = np.unique(act[(kinds == kind) & (act > lo) & (act <= hi)], return_counts=True)
        return (v, many) if len(v) else None

    near = per_task(cells, queries, work, "v double, n long", {"n": "sum"}).groupBy("v").agg(F.sum("n").alias("n"))
    upto_v = near.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"))
    a, b = upto_v.agg(*[F.min(F.when(F.col("upto") > r - below, F.col("v"))) for r in ranks]).first()
    return a + (b - a) * (wanted - ranks[0])


def fire_counts(cells: DataFrame, queries: DataFrame, theta: float) -> DataFrame:
    """query_id, fires, best: how many cells lie above theta for each query, and the greatest activation."""

    def work(ids, cell, act, kind):
        return ids, (act - theta > 0).sum(1), act.max(1)

    return per_task(cells, queries, work, "query_id long, fires long, best double", {"fires": "sum", "best": "max"}).groupBy("query_id").agg(F.sum("fires").alias("fires"), F.max("best").alias("best"))


def best_within(cells: DataFrame, queries: DataFrame, percents: list[int]) -> DataFrame:
    """percent, query_id, best: the greatest activation among the cells of growing shares of the bank (cell_id mod 100 below the percent)."""

    def work(ids, cell, act, kind):
        rows = [(np.full(len(ids), p), ids, act[:, cell % 100 < p].max(1)) for p in percents if (cell % 100 < p).any()]
        return [np.concatenate(c) for c in zip(*rows)] if rows else None

    return per_task(cells, queries, work, "percent long, query_id long, best double", {"best": "max"}).groupBy("percent", "query_id").agg(F.max("best").alias("best"))


def separation(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, own (the activation of the query's own cell) and best_other."""

    def work(ids, cell, act, kind):
        pick = lambda where: np.where(where, act, -np.inf).max(1)
        return ids, pick(kind == SELF), pick(kind != SELF)

    known = lambda c: F.when(F.max(c) > float("-inf"), F.max(c))
    return per_task(cells, queries, work, "query_id long, own double, other double", {"own": "max", "other": "max"}).groupBy("query_id").agg(known("own").alias("own"), known("other").alias("best_other"))


def own_ranks(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, own_rank: the place of the query's own cell among all cells by activation (to 9 decimals), then the smaller id; null if it is no cell."""
    own = separation(cells, queries).where("own IS NOT NULL").select("query_id", F.round("own", 9).alias("own"))
    asked = queries.join(own, "query_id").select("query_id", "vector", F.col("own").alias("query_label"))
    out = None
    for sent in query_blocks(asked, "query_label", np.float64):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, mine = sent.value
            n = np.zeros(len(ids), np.int64)
            for tile in tiles(batches) if len(ids) else ():
                cell, act = tile.column(0).to_numpy(zero_copy_only=False), np.round(q @ matrix(tile.column(1)).T, 9)
                n += ((act > mine[:, None]) | ((act == mine[:, None]) & (cell[None, :] < ids[:, None]))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["query_id", "n"])

        made = cells.where("weight IS NOT NULL").select(F.col("cell_id").cast("long"), "weight").mapInArrow(run, "query_id long, n long")
        out = made if out is None else out.unionByName(made)
    ranks = out.groupBy("query_id").agg((F.sum("n") + 1).alias("own_rank"))
    return queries.select("query_id").join(ranks, "query_id", "left")
