"""Gates and threshold policies: columns over activations, and the searches that set their thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE = 0.015
RESCUE_FLOOR = 0.40


def fixed(act: Column, theta: Column) -> Column:
    """fire above theta (strictly), else silent."""
    return F.when(act - theta > 0, "fire").otherwise("silent")


def band(act: Column, low: float, high: float) -> Column:
    """fire from `high` on, silent up to `low`, else ambiguous; fire wins where both hold."""
    if high < low:
        raise ValueError("high must not be below low")
    return F.when(act >= high, "fire").when(act <= low, "silent").otherwise("ambiguous")


def two_stage(act: Column, silent: float, fire: float, min_margin: float = 0.0) -> Column:
    """silent up to `silent`, fire where `fire` is cleared by min_margin, else ambiguous."""
    if fire < silent:
        raise ValueError("fire must not be below silent")
    return F.when(act <= silent, "silent").when(act - fire >= min_margin, "fire").otherwise("ambiguous")


def quantile_bar(negatives: DataFrame, column: str, q: float, floor: float | None = None) -> DataFrame:
    """One row: the q-quantile (linear) of the negatives, 0 if there are none, not below the floor."""
    bar = F.coalesce(F.percentile(column, q), F.lit(0.0))
    return negatives.agg((bar if floor is None else F.greatest(bar, F.lit(floor))).alias("bar"))


def gate(acts: DataFrame, threshold: float = GATE) -> DataFrame:
    """acts: query_id, act (null for a query without results). Per query top1, top2, gate_margin, fires and reason."""
    top = acts.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("act"), asc=False), 1, 2).alias("t"))
    n = F.size("t")
    margin = F.when(n == 0, None).when(n == 1, F.get("t", F.lit(0))).otherwise(F.get("t", F.lit(0)) - F.get("t", F.lit(1)))
    fires = F.coalesce(margin >= threshold, F.lit(False))
    reason = F.when(n == 0, "no results").when(n == 1, F.when(fires, "single above").otherwise("single below")).otherwise(F.when(fires, "margin above").otherwise("margin below"))
    return top.select("query_id", F.get("t", F.lit(0)).alias("top1"), F.get("t", F.lit(1)).alias("top2"), margin.alias("gate_margin"), fires.alias("fires"), reason.alias("reason"))


def margin_vs_rest(ranked: DataFrame, pool: int = 10) -> DataFrame:
    """Per query the first activation minus the mean of those on ranks 2 to `pool`."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(1, pool - 1)
    return ranked.withColumn("rest", F.avg("act").over(w)).where("rank = 1").select("query_id", (F.col("act") - F.col("rest")).alias("margin_rest"))


def threshold_grid(scores: DataFrame, n: int = 256) -> DataFrame:
    """t_index and t: n evenly spaced thresholds over the scores' range, which is widened by 1e-9 at both ends."""
    span = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).where("lo IS NOT NULL")
    span = span.select((F.col("lo") - 1e-9).alias("lo"), (F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-6).otherwise(F.col("hi")) + 1e-9).alias("hi"))
    return span.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t_index"), "lo", "hi").select("t_index", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t_index") / (n - 1)).alias("t"))


def sweep(scores: DataFrame, n: int = 256) -> DataFrame:
    """scores: score, positive (boolean). Per threshold of the grid: recall and false_fire.

    Scores are counted once into the grid's intervals and summed from above; no score meets a threshold row by row.
    """
    bounds = scores.agg(F.min("score").alias("lo0"), F.max("score").alias("hi0"))
    bounds = bounds.select((F.col("lo0") - 1e-9).alias("lo"), (F.when(F.col("hi0") <= F.col("lo0"), F.col("lo0") + 1e-6).otherwise(F.col("hi0")) + 1e-9).alias("hi"))
    t = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (n - 1)
    guess = F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (n - 1)).cast("int")
    # the number of thresholds that lie below the score; the guess may be one off
    below = F.when(t(guess + 1) < F.col("score"), guess + 2).when(t(guess) < F.col("score"), guess + 1).otherwise(guess)
    placed = scores.join(F.broadcast(bounds)).select(below.alias("place"), "positive")
    counts = placed.groupBy("place", "positive").agg(F.count(F.lit(1)).alias("n"))
    return sweep_of_counts(counts, threshold_grid(scores, n))


def sweep_of_counts(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """counts: place (how many thresholds of the grid lie below), positive, n; grid: t_index, t. Per threshold: recall and false_fire."""
    per = counts.groupBy("place").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("q"))
    totals = per.agg(F.sum("p").alias("np"), F.sum("q").alias("nn"))
    at = grid.join(per, F.col("place") > F.col("t_index"), "left").groupBy("t_index", "t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("q"), F.lit(0)).alias("q"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return at.join(F.broadcast(totals)).select("t_index", "t", rate("p", "np").alias("recall"), rate("q", "nn").alias("false_fire"))


def best_threshold(scores: DataFrame, max_false_fire: float = 0.1, n: int = 256) -> DataFrame:
    """One row: of the thresholds within the cap, that of the greatest recall, then the least false_fire, then the smallest; without any, that of the greatest recall - false_fire."""
    return best_of_sweep(sweep(scores, n), max_false_fire)


def best_of_sweep(swept: DataFrame, max_false_fire: float = 0.1) -> DataFrame:
    """best_threshold of a sweep that is there already."""
    s = swept.withColumn("feasible", F.col("false_fire") <= max_false_fire)
    r = lambda c: F.round(c, 9)
    order = [F.col("feasible").desc(), F.when(F.col("feasible"), r("recall")).otherwise(r(F.col("recall") - F.col("false_fire"))).desc(), F.when(F.col("feasible"), r("false_fire")).otherwise(0.0), "t_index"]
    return s.orderBy(*order).limit(1)


def theta_recommendation(foreign: DataFrame, positive: DataFrame, column: str = "act") -> DataFrame:
    """One row: the midpoint of foreign p99 and positive p10 where these leave a clean band, else foreign p99."""
    f = foreign.agg(F.percentile(column, 0.99).alias("foreign_p99"))
    p = positive.agg(F.percentile(column, 0.10).alias("positive_p10"))
    return recommended(f.join(F.broadcast(p)))


def recommended(bars: DataFrame) -> DataFrame:
    """bars: foreign_p99, positive_p10. Whether they leave a clean band, and theta."""
    clean = F.col("foreign_p99") < F.col("positive_p10")
    return bars.select("foreign_p99", "positive_p10", clean.alias("clean_band"), F.when(clean, (F.col("foreign_p99") + F.col("positive_p10")) / 2).otherwise(F.col("foreign_p99")).alias("theta"))


def selectivity_bound(dim: Column | int, background: Column, t: Column) -> Column:
    """max(1 - (1 - t^2)^(dim / 2) / 2, 0) ^ background."""
    half = (F.lit(dim) if isinstance(dim, int) else dim) / 2.0
    return F.pow(F.greatest(1 - 0.5 * F.pow(1 - t * t, half), F.lit(0.0)), background)


def bank_selectivity(cells: DataFrame) -> DataFrame:
    """cells: theta, dim. Per threshold and dimension: n_cells, background (the bank's other cells) and the bound on the chance that one of these cells fires for none of them."""
    groups = cells.groupBy("theta", "dim").agg(F.count(F.lit(1)).alias("n_cells"))
    all_ = groups.agg((F.sum("n_cells") - 1).alias("background"))
    return groups.join(F.broadcast(all_)).select("theta", "dim", "n_cells", "background", F.round(selectivity_bound(F.col("dim"), F.col("background"), F.col("theta")), 6).alias("bound"))


def rejection_verdict(silence: Column) -> Column:
    return F.when(silence > 0.99, "PERFECT").when(silence > 0.95, "GOOD").when(silence > 0.80, "LEAKY").otherwise("BROKEN")
