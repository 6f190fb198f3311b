"""Sweeps: threshold policies over bound groups of several sizes, and what leaks between the parts of a split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators import activation, corpus, gates, geometry
from recollect.session import stored

POLICIES = ("fixed", "theorem3", "calibrated")
TRIAL = "m int, trial long, policy string, theta double, items_fired long, false_fires long, alignment double"


def drawn_number(key: Column, n: int) -> Column:
    """A number below n that follows from the SHA-1 of a key."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % n


def shuffled_ring(items: DataFrame, seed: int = 0) -> DataFrame:
    """item_id, vector and place, from 0 in shuffled order; stored."""
    keyed = items.select("item_id", "vector", corpus.shuffled_key(seed, F.col("item_id")).alias("_key"), F.lit(1).cast("long").alias("_one"))
    return stored(corpus.running_sums(keyed, ["_key", "item_id"], "_one").select("item_id", "vector", F.col("start").alias("place")), "ring")


def drawn_trials(items: DataFrame, sizes: list[int], others: int, share: int = 20, seed: int = 0) -> DataFrame:
    """items: item_id, vector. For each size m one trial per `share` items: m, trial, slot, is_item, item_id, vector.

    The items stand in a shuffled ring. A trial begins at a place that follows from its number; the next m are its items, the `others`
    after them must stay silent. Too few items for the largest trial are an error.
    """
    ring = shuffled_ring(items, seed)
    n = ring.count()
    if n < max(sizes) + others:
        raise ValueError(f"{n} items are too few for {max(sizes)} and {others} others")
    trials = items.sparkSession.range(max(1, n // share)).select(F.col("id").alias("trial"), F.explode(F.array(*map(F.lit, sizes))).alias("m"))
    begun = trials.withColumn("h", drawn_number(F.concat_ws(":", "m", "trial"), n))
    slots = begun.select("m", "trial", "h", F.explode(F.sequence(F.lit(0), F.col("m") + others - 1)).alias("slot"))
    placed = slots.select("m", "trial", "slot", (F.col("slot") < F.col("m")).alias("is_item"), ((F.col("h") + F.col("slot")) % n).alias("place"))
    return placed.join(ring, "place").drop("place")


def random_pairs(items: DataFrame, per_item: int = 1, seed: int = 0) -> DataFrame:
    """items: item_id, vector. Per item and draw another item at a place of the shuffled ring that follows from the item's id: a_id, b_id, draw, cosine. No item is paired with itself; fewer than two give no pair."""
    ring = shuffled_ring(items, seed)
    n = ring.count()
    if n < 2:
        return ring.select(F.col("item_id").alias("a_id"), F.col("item_id").alias("b_id"), F.lit(0).alias("draw"), F.lit(0.0).alias("cosine")).limit(0)
    drawn = ring.select("item_id", "vector", "place", F.explode(F.sequence(F.lit(0), F.lit(per_item - 1))).alias("draw"))
    drawn = drawn.withColumn("to", (F.col("place") + 1 + drawn_number(F.concat_ws(":", "item_id", "draw"), n - 1)) % n)
    other = ring.select(F.col("place").alias("to"), F.col("item_id").alias("b_id"), F.col("vector").alias("b"))
    return drawn.join(other, "to").select(F.col("item_id").alias("a_id"), "b_id", "draw", V.cosine(F.col("vector"), F.col("b")).alias("cosine"))


def anchored(anchor: np.ndarray) -> np.ndarray:
    """The cell of a single item before binding: on the unit sphere in its direction, so that it fires for items of any length above the threshold."""
    return anchor / max(np.linalg.norm(anchor), 1e-12)


def readout(policy: str, m: int, least: float, theta: float = 0.30, eps: float = 0.05, delta: float = 0.05, factor: float = 0.9, safety: float = 0.02) -> float:
    """The threshold at which a cell bound to m items is read: a fixed one, a factor of the bound for m items, or a little below the items' least projection."""
    if policy == "fixed":
        return theta
    return max(geometry.theta_star(m, eps, delta) * factor if policy == "theorem3" else least - safety, 0.0)


def policy_trials(drawn: DataFrame, theta: float = 0.30, steps: int = 300) -> DataFrame:
    """Per trial and policy: m, trial, policy, theta, items_fired, false_fires and alignment (cosine of the cell with the items' mean).

    Items keep their length. A trial whose cell doesn't fire for its own anchor gives no row. The vectors of one trial meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        x, own = np.stack(pdf["vector"].to_list()).astype(float), pdf["is_item"].to_numpy()
        m, items = int(own.sum()), x[own]
        w = anchored(items[0])
        if w @ items[0] <= theta:
            return pd.DataFrame(columns=[c.split()[0] for c in TRIAL.split(", ")])
        total = items.sum(0)
        w = geometry.oja(w, total, theta, steps=steps)
        act = x @ w
        align = float(w @ total / max(np.linalg.norm(w) * np.linalg.norm(total), 1e-12))
        bars = [readout(p, m, float(act[own].min()), theta) for p in POLICIES]
        return pd.DataFrame([(m, int(pdf["trial"].iloc[0]), p, b, int((act[own] > b).sum()), int((act[~own] > b).sum()), align) for p, b in zip(POLICIES, bars, strict=True)], columns=[c.split()[0] for c in TRIAL.split(", ")])

    return drawn.groupBy("m", "trial").applyInPandas(run, TRIAL)


def policy_report(trials: DataFrame) -> DataFrame:
    """Rates by policy and m, over all m, over all policies and over all trials (null: all of them)."""
    # compared before the cube, which makes m null where it counts over all sizes
    t = trials.withColumn("fired", F.col("items_fired") == F.col("m")).withColumn("silent", F.col("false_fires") == 0)
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    rates = rate(F.col("fired") & F.col("silent")).alias("success_rate"), rate(F.col("fired")).alias("all_items_fire_rate"), rate(F.col("silent")).alias("no_others_fire_rate")
    return t.cube("policy", "m").agg(F.count(F.lit(1)).alias("n_trials"), *rates, mean("false_fires"), mean("theta"), mean("alignment"))


def split_leakage(rows: DataFrame, theta: float, disjoint: bool = False) -> DataFrame:
    """rows: row_id, vector, group, part (train or test). One row: how silent a bank of the train rows stays for the test rows, which are queries, and what the parts share.

    n_train, n_test, shared_groups, silence_rate, mean_fires, max_fires, margin_mean (of the greatest activation above theta), verdict.
    disjoint: groups on both sides make the query fail when it runs.
    """
    train = rows.where("part = 'train'").select(F.col("row_id").alias("cell_id"), F.col("vector").alias("weight"), F.lit(0).alias("label"))
    test = rows.where("part = 'test'").select(F.col("row_id").alias("query_id"), "vector", F.lit(0).alias("query_label"))
    sides = rows.groupBy("group").agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b"))
    shared = F.count_if((F.col("a") > 0) & (F.col("b") > 0))
    counts = sides.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_train"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_test"), shared.alias("shared_groups"))
    if disjoint:
        counts = counts.withColumn("shared_groups", F.when(F.col("shared_groups") > 0, F.raise_error(F.concat(F.col("shared_groups").cast("string"), F.lit(" groups are on both sides of the split"))).cast("long")).otherwise(0))
    found = activation.fire_counts(train, test, theta).agg(F.avg((F.col("fires") == 0).cast("int")).alias("silence"), F.avg("fires").alias("mean"), F.max("fires").alias("max_fires"), F.avg(F.col("best") - theta).alias("margin"))
    return counts.join(F.broadcast(found)).select("n_train", "n_test", "shared_groups", F.round("silence", 6).alias("silence_rate"), F.round("mean", 6).alias("mean_fires"), "max_fires", F.round("margin", 6).alias("margin_mean"), gates.rejection_verdict(F.col("silence")).alias("verdict"))
