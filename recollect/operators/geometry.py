"""Isotropy, whitening and binding of vectors. What the driver computes is of the size dim x dim, never of the number of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.vector import cosine, dot, norm


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with n - 1). Each task adds up its own sums and outer products; a tree of sums per entry joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, o = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            n, s, o = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if o is None else o)
        if n:
            values = np.concatenate([[float(n)], s, o.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    sums = vectors.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    n = int(sums[0])
    d = int((-1 + (1 + 4 * (len(sums) - 1)) ** 0.5) / 2 + 0.5)
    mean, outer = sums[1 : d + 1] / n, sums[d + 1 :].reshape(d, d)
    return n, mean, (outer - n * np.outer(mean, mean)) / max(1, n - 1)


@dataclass
class Whitening:
    """x goes to ((x - mean) @ matrix) / (max_norm + 1e-8)."""

    mean: np.ndarray
    matrix: np.ndarray
    max_norm: float
    rows: int

    def apply(self, vectors: DataFrame, column: str = "embedding", to: str = "whitened") -> DataFrame:
        @F.pandas_udf("array<double>")
        def white(v: pd.Series) -> pd.Series:
            there = v.notna()
            x = np.stack(v[there].to_list()).astype(np.float64) if there.any() else np.zeros((0, len(self.mean)))
            rows = iter(((x - self.mean) @ self.matrix / (self.max_norm + 1e-8)).tolist())
            return pd.Series([next(rows) if t else None for t in there], index=v.index, dtype=object)

        return vectors.withColumn(to, white(F.col(column)))

    def as_row(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.mean.tolist(), self.matrix.tolist(), float(self.max_norm), int(self.rows))], "mean array<double>, matrix array<array<double>>, max_norm double, rows long")

    @staticmethod
    def from_row(df: DataFrame, dim: int | None = None) -> Whitening:
        r = df.first()
        if dim is not None and len(r["mean"]) != dim:
            raise ValueError(f"whitening has dimension {len(r['mean'])}, not {dim}")
        return Whitening(np.array(r["mean"]), np.array(r["matrix"]), r["max_norm"], r["rows"])


def fit_whitening(vectors: DataFrame, column: str = "embedding", method: str = "zca", eps: float | None = None, headroom: float = 1.5, k: int | None = None, alpha: float = 0.2) -> Whitening:
    """zca, pca, shrinkage (covariance mixed with alpha of its mean eigenvalue) or abtt (the k greatest directions removed; k: dim // 100, 1 at least).

    eps: the least eigenvalue; None takes max(1e-5, a thousandth of the greatest). headroom multiplies the greatest norm after the transform.
    """
    n, mean, cov = moments(vectors, column)
    d = len(mean)
    if method == "shrinkage":
        cov = (1 - alpha) * cov + alpha * np.trace(cov) / d * np.eye(d)
    value, vector = np.linalg.eigh(cov)
    least = max(1e-5, 1e-3 * value[-1]) if eps is None else eps
    if method == "abtt":
        top = vector[:, ::-1][:, : min(max(1, d // 100) if k is None else k, d, max(1, n - 1))]
        matrix = np.eye(d) - top @ top.T
    elif method == "pca":
        matrix = (vector / np.sqrt(np.maximum(value, least)))[:, ::-1]
    elif method in ("zca", "shrinkage"):
        matrix = (vector / np.sqrt(np.maximum(value, least))) @ vector.T
    else:
        raise ValueError(f"unknown method {method}")
    plain = Whitening(mean, matrix, 1.0 - 1e-8, n)
    longest = plain.apply(vectors, column).agg(F.max(norm(F.col("whitened")))).first()[0] or 0.0
    return Whitening(mean, matrix, headroom * longest, n)


def participation_ratio(cov: np.ndarray) -> float:
    """(sum of eigenvalues)^2 / sum of their squares, from the covariance's entries alone."""
    square = float((cov * cov).sum())
    return float(np.trace(cov)) ** 2 / square if square > 0 else 0.0


def isotropy(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", step: int = 1) -> DataFrame:
    """One row: norms' mean and deviation, and the mean absolute cosine of each row with that whose id is `step` greater."""
    norms = vectors.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm(F.col(column))), 6).alias("norm_mean"), F.round(F.stddev_pop(norm(F.col(column))), 6).alias("norm_std"))
    a = vectors.select(F.col(id_col).alias("i"), F.col(column).alias("a"))
    b = vectors.select((F.col(id_col) - step).alias("i"), F.col(column).alias("b"))
    pairs = a.join(b, "i").agg(F.round(F.avg(F.abs(cosine(F.col("a"), F.col("b")))), 6).alias("mean_abs_cos"), F.count(F.lit(1)).alias("n_pairs"))
    return norms.join(F.broadcast(pairs))


def oja(w: np.ndarray, total: np.ndarray, theta: float, alpha: float = 1.0, dt: float = 0.05, steps: int = 300) -> np.ndarray:
    """Gated Oja steps of w towards the sum of a group's vectors."""
    for _ in range(steps):
        y = float(w @ total)
        w = w + dt * alpha * max(y - theta, 0.0) * y * (total - w * y)
    return w


BOUND = "group_id long, m long, weight array<double>, theta double, min_projection double"


def bind(items: DataFrame, theta: float = 0.30, safety: float = 0.02, steps: int = 300, floor: bool = True, unit_items: bool = True) -> DataFrame:
    """items: group_id, item_id, vector. One bound cell per group: its weight after Oja steps from the first unit vector, and a readout threshold. unit_items: all vectors are brought to unit length first.

    The threshold is the least projection of the group's vectors less `safety`, not below 0 where `floor` holds. A group is
    meant to be small (a handful of cells); its vectors meet in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        x = np.stack(pdf["vector"].to_list()).astype(np.float64)
        first = x[0] / max(np.linalg.norm(x[0]), 1e-12)
        if unit_items:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        w = oja(first, x.sum(0), theta, steps=steps)
        least = float((x @ w).min())
        bar = least - safety
        return pd.DataFrame([(int(pdf["group_id"].iloc[0]), len(x), w.tolist(), max(bar, 0.0) if floor else bar, least)], columns=["group_id", "m", "weight", "theta", "min_projection"])

    return items.groupBy("group_id").applyInPandas(run, BOUND)


def theta_star(m: int, eps: float, delta: float) -> float:
    """The readout threshold that separates m bound items from one more, for items within eps of unit length and delta of orthogonal."""
    a = 1 - eps
    denominator = m**0.5 * a * (a + delta * (m - 1))
    return (a**3 - delta * (m - 1)) / denominator if denominator > 0 else 0.0


def binding_tests(trials: DataFrame, theta: float = 0.30, safety: float = 0.02, steps: int = 300) -> DataFrame:
    """trials: trial, item_id, is_item, vector; a trial's items are bound into a cell, its other vectors must not make it fire.

    Per trial: m, success (all items fire, nothing else does), items_fired, false_fires, least_margin (of the items),
    greatest_other (the margin nearest to a false fire; null without others) and alignment (the cosine of the cell with the
    items' mean). Items keep their length; the threshold is their least projection less `safety`.
    """
    items = trials.where("is_item").select(F.col("trial").alias("group_id"), "item_id", "vector")
    cells = bind(items, theta, safety, steps, floor=False, unit_items=False).select(F.col("group_id").alias("trial"), "weight", F.col("theta").alias("bar"))
    d = trials.join(cells, "trial").withColumn("margin", dot(F.col("weight"), F.col("vector")) - F.col("bar"))
    hit, own = F.col("margin") > 0, F.col("is_item")
    total = F.aggregate(F.collect_list(F.when(own, F.col("vector"))), F.array_repeat(F.lit(0.0), F.size(F.first("weight"))), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    per = d.groupBy("trial").agg(
        F.count_if(own).alias("m"),
        F.count_if(own & hit).alias("items_fired"),
        F.count_if(~own & hit).alias("false_fires"),
        F.min(F.when(own, F.col("margin"))).alias("least_margin"),
        F.max(F.when(~own, F.col("margin"))).alias("greatest_other"),
        F.first("weight").alias("weight"),
        total.alias("total"),
    )
    success = (F.col("items_fired") == F.col("m")) & (F.col("false_fires") == 0)
    return per.select("trial", "m", success.alias("success"), "items_fired", "false_fires", "least_margin", "greatest_other", cosine(F.col("weight"), F.col("total")).alias("alignment"))


def binding_report(tests: DataFrame, success_target: float = 0.92, false_fires_target: float = 1.0) -> DataFrame:
    """Per number of items: n_trials, success_rate, mean_false_fires, mean_alignment and whether both targets are met."""
    g = tests.groupBy("m").agg(F.count(F.lit(1)).alias("n_trials"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("false_fires").alias("mean_false_fires"), F.avg("alignment").alias("mean_alignment"))
    passes = (F.col("success_rate") >= success_target).alias("success_passes"), (F.col("mean_false_fires") <= false_fires_target).alias("false_fires_passes")
    return g.select("m", "n_trials", F.round("success_rate", 6).alias("success_rate"), F.round("mean_false_fires", 6).alias("mean_false_fires"), F.round("mean_alignment", 6).alias("mean_alignment"), *passes)


def whitening_gates(fit_on: DataFrame, measured_on: DataFrame, column: str = "embedding", id_col: str = "vec_id", dim_target: float = 0.95, cos_most: float = 0.05, step: int = 1) -> DataFrame:
    """One row: ZCA fitted on one set and applied to another. The share of effective dimensions and the absolute mean cosine of pairs (ids `step` apart), before and after, and whether these pass.

    Fewer rows to fit on than dimensions and one more are an error.
    """
    white = fit_whitening(fit_on, column, eps=1e-5, headroom=1.0)
    d = len(white.mean)
    if white.rows < d + 1:
        raise ValueError(f"{white.rows} vectors are too few to whiten {d} dimensions")
    after = white.apply(measured_on.select(id_col, column), column)
    share = lambda c: participation_ratio(moments(after, c)[2]) / d

    def cos(c: str) -> DataFrame:
        a, b = after.select(F.col(id_col).alias("i"), F.col(c).alias("a")), after.select((F.col(id_col) - step).alias("i"), F.col(c).alias("b"))
        return a.join(b, "i").agg(F.abs(F.avg(cosine(F.col("a"), F.col("b")))).alias("c"))

    before_dim, after_dim = share(column), share("whitened")
    out = cos(column).withColumnRenamed("c", "cos_before").join(F.broadcast(cos("whitened").withColumnRenamed("c", "cos_after")))
    dims = F.lit(round(before_dim, 4)).alias("dim_before"), F.lit(round(after_dim, 4)).alias("dim_after")
    return out.select(F.lit(white.rows).cast("long").alias("n_fit"), *dims, F.round("cos_before", 5).alias("cos_before"), F.round("cos_after", 5).alias("cos_after"), F.lit(after_dim >= dim_target).alias("dim_pass"), (F.col("cos_after") <= cos_most).alias("cos_pass"))
