"""Metrics over ranked results, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.corpus import running_sums

Z95 = 1.959963984540054


def wilson(positive: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """(low, high) of the Wilson interval, within [0, 1]; (0, 0) without trials."""
    p, n = positive / total, total
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    bound = lambda c: F.when(total > 0, F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return bound(centre - half), bound(centre + half)


def rule_of_three(events: Column, total: Column) -> Column:
    """The upper bound min(1, 3 / n) after n trials without an event; null otherwise."""
    return F.when((events == 0) & (total > 0), F.least(F.lit(1.0), 3.0 / total))


def _ranked_values(samples: DataFrame, value: str, by: str) -> DataFrame:
    """by, value, start (samples of the group below it), c (samples that equal it) and n (samples of the group). Ranks come from sums over ranges of the values, so no group is one task's work."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    placed = running_sums(counts, [value], "c", within=[by])
    totals = counts.groupBy(by).agg(F.sum("c").alias("n"))
    return placed.join(F.broadcast(totals), by)


def _at_rank(rank: Column, value: str) -> Column:
    """The value at a rank (from 0) among _ranked_values."""
    return F.min(F.when((F.col("start") <= rank) & (rank < F.col("start") + F.col("c")), F.col(value)))


def latency_linear(samples: DataFrame, value: str, by: str) -> DataFrame:
    """p50, p95 and p99, linear between neighbouring ranks, and n."""
    ranked, points = _ranked_values(samples, value, by), {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    wanted = lambda p: F.lit(p) * (F.col("n") - 1)
    ends = [c for name, p in points.items() for c in (_at_rank(F.floor(wanted(p)), value).alias(f"{name}_a"), _at_rank(F.ceil(wanted(p)), value).alias(f"{name}_b"))]
    found = ranked.groupBy(by).agg(*ends, F.max("n").alias("n"))
    line = lambda name, p: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (wanted(p) - F.floor(wanted(p)))
    return found.select(by, *[F.round(line(name, p), 6).alias(name) for name, p in points.items()], "n")


def latency_nearest(samples: DataFrame, value: str, by: str) -> DataFrame:
    """p50 and p95 by nearest rank (half to even), and n."""
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1), 0)
    return _ranked_values(samples, value, by).groupBy(by).agg(*[F.round(_at_rank(at(p), value), 6).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95))], F.max("n").alias("n"))


def retrieval_eval(ranked: DataFrame, own_ranks: DataFrame, k: int = 5) -> DataFrame:
    """ranked: query_id, query_label, rank, label of the best k cells; own_ranks: query_id, own_rank among all cells (null: its cell isn't there). recall@1, recall@k, MRR and purity@k over all queries."""
    purity = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.avg((F.col("label") == F.col("query_label")).cast("double")).alias("purity"))
    per = own_ranks.join(purity, "query_id", "left")
    hit = lambda n: F.avg(F.when(F.col("own_rank") <= n, 1.0).otherwise(0.0))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(hit(1), 6).alias("recall_at_1"), F.round(hit(k), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("own_rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("purity"), 6).alias("purity_at_k"))


def cohens_d(a: Column, b: Column) -> Column:
    """Of two conditional columns (null where a row belongs to the other group): difference of means over the pooled population deviation."""
    return (F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)


def layer_attribution(losses: DataFrame, without: float, full: float, dominant: float = 0.5) -> DataFrame:
    """losses: layer, suppressed_loss. One row: the layer with the greatest share of the gain, its share, and whether it dominates."""
    share = (F.col("suppressed_loss") - full) / F.nullif(F.lit(without - full), F.lit(0.0))
    s = losses.select("layer", share.alias("share"))
    return s.agg(F.max_by("layer", "share").alias("top_layer"), F.round(F.max("share"), 6).alias("top_share"), (F.max("share") >= dominant).alias("dominates"))


def acceptance(losses: DataFrame, ignorance: float = 0.041, gap: float = 0.167, ceiling: float = 3.78) -> DataFrame:
    """losses: mode (none, random, real), loss. One row: the three gates and whether all hold."""
    m = losses.agg(*[F.avg(F.when(F.col("mode") == x, F.col("loss"))).alias(x) for x in ("none", "random", "real")])
    a, b, c = F.col("random") - F.col("none") >= ignorance, F.col("none") - F.col("real") >= gap, F.col("real") <= ceiling
    return m.select(F.round("none", 6).alias("none"), F.round("random", 6).alias("random"), F.round("real", 6).alias("real"), a.alias("ignorance_ok"), b.alias("gap_ok"), c.alias("ceiling_ok"), (a & b & c).alias("accepted"))
