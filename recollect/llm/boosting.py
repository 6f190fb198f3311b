"""Gradient boosting on binned features: trees, grown by sums that Spark adds up over all rows, and an additive model of lookup tables, small enough to be trained in memory on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bin_edges(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Borders per feature, midway between neighbouring values; where those are many, at the column's quantiles."""
    out = []
    for column in x.T:
        values, counts = np.unique(column[~np.isnan(column)], return_counts=True)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= bins:
            at = np.searchsorted(counts.cumsum(), np.linspace(0, counts.sum(), bins + 1)[1:-1])
            middle = np.unique(middle[np.clip(at, 1, len(middle)) - 1])
        out.append(middle)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "right") for c, e in zip(x.T, edges)], 1).astype(np.int32) if len(edges) else np.zeros((len(x), 0), np.int32)


@dataclass
class Trees:
    """Boosted trees of one depth: node arrays in breadth-first order, a leaf level of values."""

    edges: list[np.ndarray]
    bias: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    border: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, b: np.ndarray) -> np.ndarray:
        """The sum of the leaves for rows of bins."""
        out = np.full(len(b), self.bias)
        for f, t, v in zip(self.feature, self.border, self.value):
            out += v[_placed(b, f, t, len(v).bit_length() - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(binned(x, self.edges)))


def spread_edges(rows: DataFrame, bins: int = 32) -> dict[str, list[np.ndarray]]:
    """bin_edges of each kind from all of its rows (kind, x: the features as 8-byte numbers, n: how often), by counts that Spark adds up; `bins` borders a feature at most reach the driver."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), np.float64)
            for f in range(x.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(np.full(len(x), f)), pa.array(x[:, f]), b.column("n")], names=["kind", "f", "v", "n"])

    each = rows.select("kind", "x", "n").mapInArrow(values, "kind string, f long, v double, n long").groupBy("kind", "f", "v").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("kind", "f")
    upto = F.floor(F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) * bins / F.sum("n").over(by))
    placed = each.select("kind", "f", "v", F.least(upto, F.lit(bins - 1)).alias("upto"), F.count(F.lit(1)).over(by).alias("m"))
    before = placed.select("*", F.lag("v").over(by.orderBy("v")).alias("u"), F.lag("upto").over(by.orderBy("v")).alias("past"), F.row_number().over(by.orderBy("v")).alias("i"))
    wanted = (F.col("m") <= bins) | (F.col("upto") > F.col("past")) | (F.col("i") == 2) & (F.col("past") > 0)
    held = before.where(F.col("u").isNotNull() & wanted).select("kind", "f", ((F.col("u") + F.col("v")) / 2).alias("edge")).orderBy("kind", "f", "edge").collect()
    seen = each.groupBy("kind").agg((F.max("f") + 1).alias("k")).collect()
    out = {r["kind"]: [[] for _ in range(r["k"])] for r in seen}
    for r in held:
        out[r["kind"]][r["f"]].append(r["edge"])
    return {k: [np.array(e) for e in edges] for k, edges in out.items()}


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def in_bins(rows: DataFrame, edges: dict[str, list[np.ndarray]], also: tuple[str, ...] = ()) -> DataFrame:
    """kind, b (the bins of x, a byte each) and the columns of `also`, equal rows added up in n. Rows of kinds without edges go."""
    sent = rows.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist(), object)
            for k, e in sent.value.items():
                own = pa.Table.from_batches([batch]).filter(pa.array(kinds == k, pa.bool_()))
                if own.num_rows:
                    b = binned(_matrix(own["x"].combine_chunks(), np.float64), e).astype(np.uint8)
                    yield from own.drop_columns("x").append_column("b", pa.array([r.tobytes() for r in b], pa.binary())).combine_chunks().to_batches()

    schema = rows.drop("x").select("kind", *also, "n").schema.add("b", "binary")
    return rows.select("kind", *also, "n", "x").mapInArrow(run, schema).groupBy("kind", *also, "b").agg(F.sum("n").alias("n"))


def spread_trees(rows: DataFrame, edges: dict[str, list[np.ndarray]], rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> dict[str, Trees]:
    """Logistic boosting of each kind's trees on all rows (kind, y, n, b: bins by `edges`), which stay where they are: per level of a tree a pass adds up gradients by node, feature and bin, for all kinds at once, and these sums alone reach the driver.

    Each level splits every node at its best border by second-order gain; the sums of the last one give the leaves. A kind without rows of both labels has no trees.
    """
    sums = {r["kind"]: (r["n"], r["p"]) for r in rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p")).collect()}
    models = {k: Trees(edges[k], float(np.log((p + 0.5) / (n - p + 0.5)))) for k, (n, p) in sorted(sums.items()) if 0 < p < n}
    if not models:
        return {}
    names = list(models)
    n_f, width = len(next(iter(edges.values()))), max(len(e) for k in names for e in edges[k]) + 1
    per, sc = (1 << depth) * n_f * width, rows.sparkSession.sparkContext
    for _ in range(rounds):
        grown: dict[str, tuple[list, list]] = {k: ([], []) for k in names}
        for level in range(depth):
            nodes = 1 << level
            sent = sc.broadcast((models, {k: (np.concatenate(f), np.concatenate(t)) if f else (np.zeros(0, int), np.zeros(0, int)) for k, (f, t) in grown.items()}))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, level=level, nodes=nodes) -> Iterator[pa.RecordBatch]:
                trees, begun = sent.value
                gs, hs = np.zeros((2, len(names) * per))
                for batch in batches:
                    kinds, y, n = (np.array(batch.column(c).to_pylist()) for c in ("kind", "y", "n"))
                    b = _matrix(batch.column("b"), np.uint8).astype(np.int64)
                    for i, k in enumerate(names):
                        own = kinds == k
                        if own.any():
                            p, at = sigmoid(trees[k].raw(b[own])), _placed(b[own], *begun[k], level)
                            cell = (i * per + (at * n_f)[:, None] * width + b[own] + np.arange(n_f) * width).ravel()
                            gs += np.bincount(cell, np.repeat((y[own] - p) * n[own], n_f), len(gs))
                            hs += np.bincount(cell, np.repeat(p * (1 - p) * n[own], n_f), len(hs))
                at = np.flatnonzero(hs)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(gs[at]), pa.array(hs[at])], names=["cell", "g", "h"])

            got = rows.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
            gs, hs = np.zeros((2, len(names) * per))
            gs[got["cell"]], hs[got["cell"]] = got["g"], got["h"]
            for i, k in enumerate(names):
                g, h = (v[i * per :][: nodes * n_f * width].reshape(nodes, n_f, width).cumsum(2) for v in (gs, hs))
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge)
                gain[:, :, -1] = -1
                best = np.round(gain, 9).reshape(nodes, -1).argmax(1)  # sums differ in their last digits from run to run
                f, t = best // width, best % width
                grown[k][0].append(f)
                grown[k][1].append(t)
                if level == depth - 1:
                    here = np.arange(nodes), f, t
                    left, whole = (g[here], h[here]), (g[:, 0, -1], h[:, 0, -1])
                    sides = np.stack([left[0] / (left[1] + ridge), (whole[0] - left[0]) / (whole[1] - left[1] + ridge)], 1)
                    models[k].value.append(rate * sides.ravel())
            sent.unpersist()
        for k in names:
            models[k].feature.append(np.concatenate(grown[k][0]))
            models[k].border.append(np.concatenate(grown[k][1]))
    return models


def _placed(b: np.ndarray, feature: np.ndarray, border: np.ndarray, depth: int) -> np.ndarray:
    """The place of each row within a level of a tree."""
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(depth):
        node = 2 * node + 1 + (b[rows, feature[node]] > border[node])
    return node - ((1 << depth) - 1)


def calibrated_threshold(score: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The score from which isotonic regression of y on the score reaches `precision`, midway to the score below it; above 1 if it never does. y: labels, or shares of label 1 where each score stands for `n` rows."""
    if not len(score):
        return 2.0
    s, at = np.unique(score, return_inverse=True)
    weight = np.ones(len(score)) if n is None else np.asarray(n, float)
    total = np.bincount(at, weight)
    means, counts, starts = [], [], []
    for i, (v, c) in enumerate(zip((np.bincount(at, weight * y) / total).tolist(), total.tolist())):
        means.append(v)
        counts.append(c)
        starts.append(i)
        while len(means) > 1 and means[-2] >= means[-1]:
            m, c = means.pop(), counts.pop()
            starts.pop()
            means[-1] = (means[-1] * counts[-1] + m * c) / (counts[-1] + c)
            counts[-1] += c
    return next((float(s[a] + s[max(a - 1, 0)]) / 2 for m, a in zip(means, starts) if m >= precision), 2.0)


@dataclass
class Additive:
    """A generalised additive model with pairwise terms: a table of scores per feature and per chosen pair of features."""

    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            out += table[b[:, f]]
        if self.pairs:
            c = binned(x, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                out += table[c[:, i], c[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def _step(cell: np.ndarray, size: int, g: np.ndarray, h: np.ndarray, leaves: int, rate: float, ridge: float) -> np.ndarray:
    """One shallow tree on one binned feature, as a table: its best `leaves` intervals, found one border at a time."""
    gs, hs = np.bincount(cell, g, size).cumsum(), np.bincount(cell, h, size).cumsum()
    cuts = [-1, size - 1]
    worth = lambda a, z: (lambda p, q: p * p / (q + ridge))(gs[z] - (gs[a] if a >= 0 else 0), hs[z] - (hs[a] if a >= 0 else 0))
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, z in zip(cuts, cuts[1:]):
            if z - a < 2:
                continue
            k = np.arange(a + 1, z)
            ga, ha = (gs[a], hs[a]) if a >= 0 else (0.0, 0.0)
            left = (gs[k] - ga) ** 2 / (hs[k] - ha + ridge)
            right = (gs[z] - gs[k]) ** 2 / (hs[z] - hs[k] + ridge)
            gain = left + right - worth(a, z)
            if gain.max() > best:
                best, at = float(gain.max()), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    table = np.zeros(size)
    for a, z in zip(cuts, cuts[1:]):
        gd, hd = gs[z] - (gs[a] if a >= 0 else 0), hs[z] - (hs[a] if a >= 0 else 0)
        table[a + 1 : z + 1] = rate * gd / (hd + ridge)
    return table


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, leaves: int = 3, n_pairs: int = 8, bins: int = 64, coarse_bins: int = 8, ridge: float = 2.0) -> Additive:
    """Cyclic boosting: each round gives every feature in turn one shallow tree on the current gradient. Then the pairs that explain most of what is left get tables of their own, boosted likewise."""
    edges, coarse = bin_edges(x, bins), bin_edges(x, coarse_bins)
    b, c, n_f = binned(x, edges), binned(x, coarse), x.shape[1]
    sizes, csizes = [len(e) + 1 for e in edges], [len(e) + 1 for e in coarse]
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(edges, float(np.log(p0 / (1 - p0))), [np.zeros(s) for s in sizes], [], coarse, [])
    raw = np.full(len(y), model.bias)
    for _ in range(rounds):
        for f in range(n_f):
            p = sigmoid(raw)
            table = _step(b[:, f], sizes[f], y - p, p * (1 - p), leaves, rate, ridge)
            model.tables[f] += table
            raw += table[b[:, f]]
    p = sigmoid(raw)
    gains = []
    for i in range(n_f):
        for j in range(i + 1, n_f):
            cell, size = c[:, i] * csizes[j] + c[:, j], csizes[i] * csizes[j]
            g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
            gains.append((float((g * g / (h + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((csizes[i], csizes[j])))
    for _ in range(rounds // 4):
        for t, (i, j) in enumerate(model.pairs):
            p = sigmoid(raw)
            cell, size = c[:, i] * csizes[j] + c[:, j], csizes[i] * csizes[j]
            table = rate * np.bincount(cell, y - p, size) / (np.bincount(cell, p * (1 - p), size) + ridge)
            model.pair_tables[t] += table.reshape(csizes[i], csizes[j])
            raw += table[cell]
    return model
