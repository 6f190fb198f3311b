"""Rebuilt banks, load and controller reports, ends of rankings and ranking by texts against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import evaluation, rebuild
from recollect.operators import reports as P
from recollect.operators import retrieval as R

CELLS = "cell_id long, label string, theta double, kind string, text string, vector array<double>"


def test_a_rebuilt_bank_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(230, 4)) @ rng.normal(size=(4, 4)) + 2
    theta = [(0.5, 0.3, None)[i % 3] for i in range(230)]
    rows = [(i * 3, f"l{i}", theta[i], "bound" if i == 5 else "single", ("", None)[i % 2] if i in (7, 8) else "t", None if i == 9 else x[i].tolist()) for i in range(230)]
    got = sorted(rebuild.rebuilt(spark.createDataFrame(rows, CELLS).repartition(5), most=50).collect())
    kept = [i for i in range(230) if i not in (5, 7, 8, 9)]
    stride = len(kept) // 50
    fit = x[kept[::stride][:50]]
    value, vector = np.linalg.eigh(np.cov(fit.T))
    matrix = vector / np.sqrt(np.maximum(value, max(1e-5, 1e-3 * value[-1]))) @ vector.T
    longest = np.linalg.norm((fit - fit.mean(0)) @ matrix, axis=1).max()
    order = [i for t in (0.5, 0.3, None) for i in kept if theta[i] == t]
    assert [(r["cell_id"], r["source_id"], r["label"], r["theta"]) for r in got] == [(k + 1, i * 3, f"l{i}", theta[i]) for k, i in enumerate(order)]
    assert np.allclose([r["weight"] for r in got], (x[order] - fit.mean(0)) @ matrix / (1.5 * longest), atol=1e-6)


def test_too_few_cells_are_no_bank(spark):
    rows = [(i, "l", 0.3, "single", "t", [1.0, float(i)]) for i in range(199)] + [(199, "l", 0.3, "bound", "t", [1.0, 2.0])]
    with pytest.raises(ValueError, match="199"):
        rebuild.rebuilt(spark.createDataFrame(rows, CELLS))
    with pytest.raises(ValueError):
        rebuild.rebuilt(spark.createDataFrame([], CELLS))


def test_the_reference_sample_is_an_even_one(spark):
    rows = spark.createDataFrame([(i * 2,) for i in range(25)], "id long")
    sample = lambda most: sorted(r["id"] for r in rebuild.reference_sample(rows, "id", most, 25).collect())
    assert sample(10) == [i * 4 for i in range(10)]
    assert sample(30) == [i * 2 for i in range(25)]


def test_load_reports_of_odd_requests(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(0), 1.0, 200), ("a", at(1), 3.0, 500), ("a", at(2), None, None), ("b", at(5), 0.0, 200), ("b", at(5), 0.0, 200), (None, at(0), 2.0, 503)]
    t = spark.createDataFrame(rows, "who string, started timestamp, latency double, status int")
    got = {r["who"]: r for r in rebuild.load_report(t, "who", F.col("status") == 200, evaluation.latency_linear(t, "latency", "who")).collect()}
    a, b, none = got["a"], got["b"], got[None]
    assert (a["requests"], a["wall_seconds"], a["rps"], a["errors"], a["error_rate"], a["statuses"], a["p50"], a["slowest"]) == (3, 4.0, 0.75, 2, 0.666667, "200:1,500:1", 2.0, 3.0)
    assert (b["rps"], b["wall_seconds"], b["errors"], b["statuses"]) == (0.0, 0.0, 0, "200:2")
    assert (none["errors"], none["error_rate"], none["statuses"]) == (1, 1.0, "503:1")
    assert rebuild.load_report(t.limit(0), "who", F.col("status") == 200, evaluation.latency_linear(t.limit(0), "latency", "who")).count() == 0


def test_controllers_that_answer_badly(spark):
    good, bad = '{"action": "write", "confidence": 2}', '{"action": "wri'
    rows = [
        ("write", "write", good, None, "The sea is salt", None, None),
        ("write", "write", bad, good, "Remember the sea", None, None),
        ("write", "write", bad, bad, "lost", None, None),
        ("query", "bind", "so: " + good, None, None, ["a", "b", "a"], ["a", "c"]),
        ("bind", "bind", good, None, None, ["c"], ["c"]),
        ("bind", "bind", good, None, None, [], ["c"]),
        ("query", "query", None, None, None, None, None),
    ]
    t = spark.createDataFrame([("x", *r) for r in rows], "config string, expected string, routed string, answer string, retry string, to_write string, proposed array<string>, known array<string>")
    got = P.controller_report(t, "config").first()
    assert (got["turns"], got["recovered"], got["write_quality"]) == (7, 1, 0.5)
    assert got["json_validity"] == pytest.approx(4 / 7, abs=1e-6) and got["malformed_rate"] == pytest.approx(2 / 7, abs=1e-6)
    assert got["routing_accuracy"] == pytest.approx(4 / 7, abs=1e-6) and got["bind_precision"] == pytest.approx((2 / 3 + 1) / 2, abs=1e-6)
    assert P.controller_report(t.where("routed = 'query'"), "config").first()["bind_precision"] is None


def test_both_ends_of_a_ranking(spark):
    pairs = spark.createDataFrame([(1, c, a) for c, a in ((1, 0.5), (2, 0.9), (3, 0.5), (4, -0.1), (5, 0.9))], "query_id long, cell_id long, act double")
    got = {(r["end"], r["place"]): r["cell_id"] for r in P.extreme_pairs(pairs, 3).collect()}
    assert got == {("top", 1): 2, ("top", 2): 5, ("top", 3): 1, ("bottom", 1): 4, ("bottom", 2): 1, ("bottom", 3): 3}
    assert P.extreme_pairs(pairs.limit(1), 3).count() == 2 and P.extreme_pairs(pairs.limit(0), 3).count() == 0


def test_cells_without_a_text_rank_last(spark):
    found = spark.createDataFrame([(1, c, c) for c in range(1, 6)], "query_id long, cell_id long, rank int")
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, -3.0), (1, 3, 0.5), (1, 4, None), (1, 5, 0.5)], "query_id long, cell_id long, score double")
    texts = spark.createDataFrame([(1, ""), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "cell_id long, text string")
    order = lambda **o: [r["cell_id"] for r in R.reranked_texts(found, scores, texts, 5, **o).orderBy("new_rank").collect()]
    assert order() == [3, 5, 2, 1, 4]
    assert order(min_score=-5.0) == [3, 5, 2]
