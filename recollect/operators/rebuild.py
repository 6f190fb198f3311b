"""A bank made anew from its single cells: another whitening, the same labels and thresholds, new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.corpus import global_offsets, running_sums
from recollect.operators.geometry import fit_whitening
from recollect.session import stored


def reference_sample(rows: DataFrame, order: str, most: int, n: int) -> DataFrame:
    """At most `most` of the n rows at an even stride in the order of an integer column, from the first: all of them where there are no more."""
    stride = max(1, n // most)
    placed = global_offsets(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one")
    return placed.where((F.col("start") % stride == 0) & (F.col("start") < stride * most)).drop("_one", "start")


def rebuilt(cells: DataFrame, most: int = 20_000, least: int = 200) -> DataFrame:
    """cells: cell_id, label, theta, kind, text and vector (of the text, by the encoder that the new bank is for). Per new cell: cell_id (from 1), source_id, label, theta and weight.

    Single cells with a text and a vector count; fewer than `least` are an error. The whitening is fitted on `most` of them at an even
    stride and applied to all. Cells of one threshold get ids that follow each other, the threshold of the smallest old id first;
    within one, in the order of old ids. A null threshold is one of its own. Only sums and the whitening pass through the driver.
    """
    there = (F.col("kind") == "single") & (F.coalesce("text", F.lit("")) != "") & F.col("vector").isNotNull()
    kept = stored(cells.where(there).select(F.col("cell_id").alias("source_id"), "label", "theta", "vector"), "singles")
    n = kept.count()
    if n < least:
        raise ValueError(f"{n} single cells with a text are too few to fit a whitening; {least} are needed")
    white = fit_whitening(reference_sample(kept, "source_id", most, n), "vector")
    first = kept.groupBy("theta").agg(F.min("source_id").alias("_first")).withColumnRenamed("theta", "_theta")
    ids = kept.select("source_id", "theta").join(first, F.col("theta").eqNullSafe(F.col("_theta"))).select("source_id", "_first", F.lit(1).cast("long").alias("_one"))
    numbered = running_sums(ids, ["_first", "source_id"], "_one").select("source_id", (F.col("start") + 1).cast("long").alias("cell_id"))
    return white.apply(kept, "vector", "weight").join(numbered, "source_id").select("cell_id", "source_id", "label", "theta", "weight")


def load_report(requests: DataFrame, by: str, ok: Column, quantiles: DataFrame) -> DataFrame:
    """requests: `by`, started (timestamp), latency (seconds), status; quantiles: `by`, p50, p95, p99 of the latencies.

    Per group: requests, wall_seconds (from the first start to the last end), rps, errors (not ok, or without a status), error_rate, the
    quantiles, slowest, and statuses (status:count by status, comma-joined). Without any elapsed time rps is 0. A request without a latency ends as it starts.
    """
    begun, took = F.unix_micros("started"), F.coalesce(F.round(F.col("latency") * 1e6).cast("long"), F.lit(0))
    good = F.count_if(F.coalesce(ok, F.lit(False)))
    per = requests.groupBy(by, "status").agg(F.count(F.lit(1)).alias("c"), good.alias("good"), F.min(begun).alias("a"), F.max(begun + took).alias("b"), F.max("latency").alias("slowest"))
    # a group has as many rows here as there are statuses
    listed = F.array_sort(F.collect_list(F.when(F.col("status").isNotNull(), F.struct(F.col("status").cast("string").alias("s"), "c"))))
    g = per.groupBy(by).agg(F.sum("c").alias("requests"), F.sum("good").alias("good"), ((F.max("b") - F.min("a")) / 1e6).alias("wall"), F.max("slowest").alias("slowest"), listed.alias("l"))
    q = quantiles.select(F.col(by).alias("_by"), "p50", "p95", "p99")
    n, wall = F.col("requests"), F.col("wall")
    return g.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(
        by,
        "requests",
        F.round(wall, 3).alias("wall_seconds"),
        F.round(F.when(wall > 0, n / wall).otherwise(0.0), 6).alias("rps"),
        (n - F.col("good")).alias("errors"),
        F.round((n - F.col("good")) / n, 6).alias("error_rate"),
        "p50",
        "p95",
        "p99",
        "slowest",
        F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["s"], x["c"].cast("string"))), ",").alias("statuses"),
    )
