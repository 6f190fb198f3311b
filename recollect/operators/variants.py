"""Variants of one vector space (raw, centred, whitened and so on) held against each other: recall per kind of query, margins, and which cells fire in several of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators import gates
from recollect.operators.geometry import Whitening
from recollect.operators.retrieval import matrix, query_blocks, tiles
from recollect.session import stored

POSITIVE = ("exact", "paraphrase")


def in_variants(rows: DataFrame, id_col: str, column: str, variants: dict[str, Whitening | None], keep: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with a unit vector per variant, in a column of its name (None: the vector as it is)."""
    out = rows.select(id_col, *keep, column)
    for name, white in variants.items():
        out = out.withColumn(name, F.col(column)) if white is None else white.apply(out, column, name)
    return out.select(id_col, *keep, *[V.unit(F.col(name)).alias(name) for name in variants])


def _blocks(queries: DataFrame, names: list[str]) -> Iterator:
    """Broadcasts of ids, the vectors of all variants side by side, and targets, for a block of the stated query set at a time."""
    return query_blocks(queries.select("query_id", F.concat(*names).alias("vector"), F.coalesce("target_id", F.lit(-1)).alias("t")), "t")


def variant_scores(cells: DataFrame, queries: DataFrame, names: list[str]) -> DataFrame:
    """variant, query_id, target (its cell's activation; null without one), best (of all cells): for each block of queries one pass over the cells for all variants.

    cells: cell_id and a column per variant; queries: query_id, target_id and a column per variant (a stated set, sent in blocks).
    """
    parts = None
    for sent in _blocks(queries, names):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, target = sent.value
            hit, best = np.full((2, len(names), len(ids)), -np.inf)
            for tile in tiles(batches) if len(ids) else ():
                own = tile.column(0).to_numpy(zero_copy_only=False)[None, :] == target[:, None]
                for k, of in enumerate(np.split(q, len(names), axis=1)):
                    act = of @ matrix(tile.column(1 + k)).T
                    hit[k] = np.maximum(hit[k], np.where(own, act, -np.inf).max(1))
                    best[k] = np.maximum(best[k], act.max(1))
            for k, n in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(ids), pa.string()), pa.array(ids), pa.array(hit[k], mask=np.isinf(hit[k])), pa.array(best[k], mask=np.isinf(best[k]))], names=["variant", "query_id", "target", "best"])

        made = cells.select("cell_id", *names).mapInArrow(run, "variant string, query_id long, target double, best double").where("best IS NOT NULL")
        parts = made if parts is None else parts.unionByName(made)
    return parts.groupBy("variant", "query_id").agg(F.max("target").alias("target"), F.max("best").alias("best"))


def fired_overlap(cells: DataFrame, queries: DataFrame, bars: dict[str, float]) -> DataFrame:
    """a, b, in_both, in_either: over all queries, how many cells fire in both variants at their thresholds, and in one of them at least."""
    names, parts = list(bars), None
    for sent in _blocks(queries, names):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, _ = sent.value
            both = np.zeros((len(names), len(names)), np.int64)
            for tile in tiles(batches) if len(ids) else ():
                # a query's fired cells as bits, eight to a byte
                bits = [np.packbits(of @ matrix(tile.column(1 + k)).T > bars[n], axis=1) for k, (n, of) in enumerate(zip(names, np.split(q, len(names), axis=1)))]
                both += np.array([[int(np.bitwise_count(x & y).sum()) for y in bits] for x in bits])
            a, b = np.indices(both.shape)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a.ravel()]), pa.array([names[i] for i in b.ravel()]), pa.array(both.ravel())], names=["a", "b", "in_both"])

        made = cells.select("cell_id", *names).mapInArrow(run, "a string, b string, in_both long")
        parts = made if parts is None else parts.unionByName(made)
    parts = stored(parts.groupBy("a", "b").agg(F.sum("in_both").alias("in_both")), "overlap")
    alone = parts.where("a = b")
    sizes = alone.select("a", F.col("in_both").alias("of_a")), alone.select("b", F.col("in_both").alias("of_b"))
    return parts.join(F.broadcast(sizes[0]), "a").join(F.broadcast(sizes[1]), "b").select("a", "b", "in_both", (F.col("of_a") + F.col("of_b") - F.col("in_both")).alias("in_either"))


def variant_report(scores: DataFrame, kinds: DataFrame, names: list[str], max_false_fire: float = 0.1) -> DataFrame:
    """scores: of variant_scores; kinds: query_id, kind. Per variant: threshold (the best under the cap of false fires), feasible, recall per positive kind, false fires per other kind, silence_rate, margins and margin_overlap.

    A positive query's score is its target's, another one's the greatest. margin_overlap: the share of the negatives that reach the 5th percentile of the positives.
    """
    positive = F.col("kind").isin(*POSITIVE)
    s = stored(scores.join(kinds, "query_id").select("variant", "kind", "best", positive.alias("positive"), F.when(positive, F.col("target")).otherwise(F.col("best")).alias("score")), "scores")
    out = None
    for name in names:
        own = s.where(F.col("variant") == name)
        bar = gates.best_threshold(own.select("score", "positive"), max_false_fire).select("t", "feasible")
        j = own.join(F.broadcast(bar))
        above = (F.col("score") > F.col("t")).cast("int")
        rate = lambda k: F.round(F.avg(F.when(F.col("kind") == k, above)), 6)
        at = lambda q, cond: F.percentile(F.when(cond, F.col("score") - F.col("t")), q)
        low = own.where("positive").agg(F.percentile("score", 0.05).alias("low"))
        j = j.join(F.broadcast(low))
        row = j.groupBy("t", "feasible").agg(
            rate("exact").alias("exact_recall"), rate("paraphrase").alias("paraphrase_recall"), rate("near_miss").alias("near_miss_false_fires"), rate("unrelated").alias("unrelated_false_fires"),
            F.round(F.avg((F.col("best") <= F.col("t")).cast("int")), 6).alias("silence_rate"), F.round(at(0.5, F.col("positive")), 6).alias("median_positive_margin"), F.round(at(0.05, F.col("positive")), 6).alias("p05_positive_margin"),
            F.round(at(0.95, ~F.col("positive")), 6).alias("p95_negative_margin"), F.round(F.avg(F.when(~F.col("positive"), (F.col("score") >= F.col("low")).cast("int"))), 6).alias("margin_overlap"),
        )
        row = row.select(F.lit(name).alias("variant"), F.round("t", 6).alias("threshold"), "feasible", *row.columns[2:])
        out = row if out is None else out.unionByName(row)
    return out
