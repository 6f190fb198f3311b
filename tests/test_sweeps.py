"""Sweeps, leakage and variants against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import geometry
from recollect.operators import sweep as W
from recollect.operators import variants as X


def vectors(spark, n, dims=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "item_id long, vector array<double>")


def test_trials_are_drawn_without_repeats(spark):
    _, items = vectors(spark, 60)
    rows = W.drawn_trials(items, [2, 4], 10, share=10).drop("vector").collect()
    assert {(r["m"], r["trial"]) for r in rows} == {(m, t) for m in (2, 4) for t in range(6)}
    for m in (2, 4):
        for t in range(6):
            own = [r for r in rows if (r["m"], r["trial"]) == (m, t)]
            assert len({r["item_id"] for r in own}) == m + 10 and sum(r["is_item"] for r in own) == m
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, W.drawn_trials(items, [2, 4], 10, share=10).drop("vector").collect()))
    with pytest.raises(ValueError):
        W.drawn_trials(items, [2], 59)


def test_policies_read_the_bound_cell(spark):
    x, items = vectors(spark, 40)
    drawn = W.drawn_trials(items, [3], 5, share=20)
    by = {}
    for r in drawn.collect():
        by.setdefault(r["trial"], []).append((r["slot"], r["is_item"], r["item_id"]))
    got = {(r["trial"], r["policy"]): r for r in W.policy_trials(drawn, 0.3).collect()}
    assert len(got) == 6
    for t, members in by.items():
        own, others = [x[i] for _, a, i in sorted(members) if a], [x[i] for _, a, i in members if not a]
        w = own[0] / np.linalg.norm(own[0])
        for _ in range(300):
            y = w @ sum(own)
            w = w + 0.05 * max(y - 0.3, 0) * y * (sum(own) - w * y)
        for p, bar in (("fixed", 0.3), ("theorem3", max(0.9 * geometry.theta_star(3, 0.05, 0.05), 0)), ("calibrated", max(min(w @ v for v in own) - 0.02, 0))):
            r = got[t, p]
            assert abs(r["theta"] - bar) < 1e-9 and r["items_fired"] == sum(w @ v > bar for v in own) and r["false_fires"] == sum(w @ v > bar for v in others)
    # a cell that its own anchor doesn't reach gives no row
    short = items.withColumn("vector", F.transform("vector", lambda v: v * 0.1))
    assert W.policy_trials(W.drawn_trials(short, [2], 5), 0.3).count() == 0


def test_shared_groups_fail_a_disjoint_split(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", "train"), (2, [0.0, 1.0], "b", "train"), (3, [1.0, 0.0], "c", "test"), (4, [-1.0, 0.0], "c", "test")], "row_id long, vector array<double>, group string, part string")
    r = W.split_leakage(rows, 0.5, True).first()
    assert (r["n_train"], r["n_test"], r["shared_groups"], r["silence_rate"], r["max_fires"], r["margin_mean"]) == (2, 2, 0, 0.5, 1, 0.0)
    leaky = rows.withColumn("group", F.lit("x"))
    assert W.split_leakage(leaky, 0.5).first()["shared_groups"] == 1
    with pytest.raises(Exception, match="both sides"):
        W.split_leakage(leaky, 0.5, True).collect()


def test_overlap_of_fired_cells(spark):
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(50, 2, 4)), rng.normal(size=(5, 2, 4))
    cells = spark.createDataFrame([(i, c[i, 0].tolist(), c[i, 1].tolist()) for i in range(50)], "cell_id long, p array<double>, r array<double>").repartition(3)
    asked = spark.createDataFrame([(i, i if i % 2 else None, q[i, 0].tolist(), q[i, 1].tolist()) for i in range(5)], "query_id long, target_id long, p array<double>, r array<double>")
    act = [q[:, v] @ c[:, v].T for v in (0, 1)]
    fired = [act[0] > 0.5, act[1] > 0.2]
    got = {(r["a"], r["b"]): (r["in_both"], r["in_either"]) for r in X.fired_overlap(cells, asked, {"p": 0.5, "r": 0.2}).collect()}
    assert got == {(a, b): (int((fired[i] & fired[j]).sum()), int((fired[i] | fired[j]).sum())) for i, a in enumerate("pr") for j, b in enumerate("pr")}
    scores = {(r["variant"], r["query_id"]): r for r in X.variant_scores(cells, asked, ["p", "r"]).collect()}
    for v, name in enumerate("pr"):
        for i in range(5):
            assert abs(scores[name, i]["best"] - act[v][i].max()) < 1e-9
            assert scores[name, i]["target"] is None if i % 2 == 0 else abs(scores[name, i]["target"] - act[v][i][i]) < 1e-9


def test_variant_queries_go_in_blocks(spark):
    """More queries than a block holds: each task gets blocks of them, and every query its scores."""
    rng = np.random.default_rng(6)
    w, q = rng.normal(size=(700, 3)), rng.normal(size=(2300, 3))
    cells = spark.createDataFrame([(i, v.tolist(), (-v).tolist()) for i, v in enumerate(w)], "cell_id long, a array<double>, b array<double>")
    asked = spark.createDataFrame([(i, i if i < 700 else None, v.tolist(), v.tolist()) for i, v in enumerate(q)], "query_id long, target_id long, a array<double>, b array<double>")
    assert len(list(X._blocks(asked, ["a", "b"]))) == 2
    got = {(r["variant"], r["query_id"]): (r["target"], r["best"]) for r in X.variant_scores(cells, asked, ["a", "b"]).collect()}
    act = q @ w.T
    assert len(got) == 4600 and np.allclose([got["a", i][1] for i in range(2300)], act.max(1)) and np.allclose([got["b", i][1] for i in range(2300)], -act.min(1))
    assert np.allclose([got["a", i][0] for i in range(700)], act[np.arange(700), np.arange(700)]) and got["a", 900][0] is None
    both = {(r["a"], r["b"]): r["in_both"] for r in X.fired_overlap(cells, asked, {"a": 0.5, "b": 0.5}).collect()}
    assert both["a", "a"] == (act > 0.5).sum() and both["b", "b"] == (-act > 0.5).sum() and both["a", "b"] == 0
