"""Queries over drawn trials and over splits of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from recollect.operators import geometry
from recollect.operators import sweep as W
from recollect.operators import variants as X
from recollect.plans.dense import _MOMENTS, _ROOT
from recollect.session import stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_DRAWN = """n AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY sha1('0:' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings), z AS (SELECT max(n) AS n FROM n),
t AS (SELECT m, trial, n, ('0x' || substring(sha1(m || ':' || trial), 1, 8))::BIGINT % n AS h FROM (SELECT unnest(range(greatest(1, n // 20))) AS trial, n FROM z), (SELECT unnest([2, 3, 4]) AS m)),
j AS (SELECT m, trial, n, h, unnest(range(m + 20)) AS slot FROM t), x AS (SELECT j.m, j.trial, slot, slot < j.m AS own, vec_id, n.x FROM j JOIN n ON n.place = (h + slot) % j.n)"""


@query(f"WITH {_DRAWN} SELECT m, trial, slot::INT AS slot, own AS is_item, vec_id AS item_id FROM x")
def drawn_trials(spark, d):
    """Who is in which trial, and who must stay silent in it."""
    return W.drawn_trials(_items(spark, d), [2, 3, 4], 20).drop("vector")


def _items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY sha1('0:' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings), d AS (SELECT *, unnest([0, 1]) AS draw FROM n), p AS (SELECT *, (place + 1 + ('0x' || substring(sha1(vec_id || ':' || draw), 1, 8))::BIGINT % (n - 1)) % n AS t FROM d)
SELECT p.vec_id AS a_id, n.vec_id AS b_id, draw, round(list_cosine_similarity(p.x, n.x), 6) AS cosine FROM p JOIN n ON n.place = p.t""")
def random_pairs(spark, d):
    """Two random partners per vector, the baseline for confused pairs."""
    p = W.random_pairs(_items(spark, d), 2)
    return p.withColumn("cosine", F.round("cosine", 6))


_STAR = "greatest(CASE WHEN sqrt(w.m) * 0.95 * (0.95 + 0.05 * (w.m - 1)) > 0 THEN (0.95 ^ 3 - 0.05 * (w.m - 1)) / (sqrt(w.m) * 0.95 * (0.95 + 0.05 * (w.m - 1))) ELSE 0 END * 0.9, 0)"


@query(f"""WITH RECURSIVE {_DRAWN}, g AS (SELECT m, trial, list_transform(arg_min(x, slot), lambda v: v / greatest(sqrt(list_inner_product(arg_min(x, slot), arg_min(x, slot))), 1e-12)) AS first FROM x WHERE own GROUP BY m, trial),
s AS (SELECT m, trial, list(v ORDER BY i) AS total FROM (SELECT m, trial, i, sum(v) AS v FROM (SELECT m, trial, unnest(range(1, 65)) AS i, unnest(x) AS v FROM x WHERE own) GROUP BY m, trial, i) GROUP BY m, trial),
k AS (SELECT g.m, g.trial, first, total, list_inner_product(first, total) AS ft, list_inner_product(total, total) AS tt FROM g JOIN s USING (m, trial)),
o AS (SELECT m, trial, 0 AS n, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM k UNION ALL SELECT m, trial, n + 1, a - c * y * a, b + c - c * y * b FROM (SELECT o.*, y, 0.05 * greatest(y - 0.3, 0) * y AS c FROM (SELECT o.*, a * ft + b * tt AS y FROM o JOIN k USING (m, trial) WHERE n < 300) o)),
w AS (SELECT k.m, k.trial, total, list_transform(list_zip(first, total), lambda v: a * v[1] + b * v[2]) AS weight FROM o JOIN k USING (m, trial) WHERE n = 300),
p AS (SELECT x.m, x.trial, own, list_inner_product(weight, x) AS act FROM w JOIN x USING (m, trial)), l AS (SELECT m, trial, min(act) AS least FROM p WHERE own GROUP BY m, trial),
b AS (SELECT w.m, w.trial, 'fixed' AS policy, 0.3::DOUBLE AS theta FROM w UNION ALL SELECT w.m, w.trial, 'theorem3', {_STAR} FROM w UNION ALL SELECT m, trial, 'calibrated', greatest(least - 0.02, 0) FROM l),
r AS (SELECT b.m, b.trial, policy, any_value(theta) AS theta, count(*) FILTER (own AND act > theta) AS fired, count(*) FILTER (NOT own AND act > theta) AS wrong FROM b JOIN p USING (m, trial) GROUP BY b.m, b.trial, policy),
u AS (SELECT r.m, policy, theta, (fired = r.m)::INT AS f, (wrong = 0)::INT AS q, wrong, list_cosine_similarity(weight, total) AS align FROM r JOIN w ON w.m = r.m AND w.trial = r.trial)
SELECT policy, m, count(*) AS n_trials, round(avg(f * q), 6) AS success_rate, round(avg(f), 6) AS all_items_fire_rate, round(avg(q), 6) AS no_others_fire_rate, round(avg(wrong), 6) AS mean_false_fires, round(avg(theta), 6) AS mean_theta, round(avg(align), 6) AS mean_alignment FROM u GROUP BY CUBE (policy, m)""")
def policy_sweep(spark, d):
    """Three readout policies over groups of two, three and four."""
    return W.policy_report(W.policy_trials(W.drawn_trials(_items(spark, d), [2, 3, 4], 20)))


_SPLITS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT 'rows' AS split, *, CASE WHEN vec_id % 100 = 0 THEN 'test' ELSE 'train' END AS part FROM e UNION ALL SELECT 'groups', *, CASE WHEN label % 5 <> 0 THEN 'train' ELSE 'test' END FROM e WHERE label % 5 <> 0 OR vec_id % 100 < 10),
c AS (SELECT split, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test FROM p GROUP BY split), h AS (SELECT split, count(*) FILTER (k = 2) AS shared_groups FROM (SELECT split, label, count(DISTINCT part) AS k FROM p GROUP BY split, label) GROUP BY split),
f AS (SELECT a.split, a.vec_id, count(*) FILTER (list_inner_product(a.v, b.v) > 0.35) AS fires, max(list_inner_product(a.v, b.v)) AS best FROM p a JOIN p b ON a.split = b.split AND a.part = 'test' AND b.part = 'train' GROUP BY a.split, a.vec_id),
g AS (SELECT split, avg((fires = 0)::INT) AS silence, avg(fires) AS mean, max(fires) AS max_fires, avg(best - 0.35) AS margin FROM f GROUP BY split)"""


@query(f"""WITH {_SPLITS} SELECT g.split, n_train, n_test, shared_groups, round(silence, 6) AS silence_rate, round(mean, 6) AS mean_fires, max_fires, round(margin, 6) AS margin_mean, CASE WHEN silence > 0.99 THEN 'PERFECT' WHEN silence > 0.95 THEN 'GOOD' WHEN silence > 0.80 THEN 'LEAKY' ELSE 'BROKEN' END AS verdict FROM g JOIN c USING (split) JOIN h USING (split)""")
def split_leakage(spark, d):
    """A split by rows, which leaves neighbours on both sides, beside one by groups, which may share none."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))
    by_row = e.withColumn("part", F.when(F.col("row_id") % 100 == 0, "test").otherwise("train"))
    by_group = e.where("group % 5 <> 0 OR row_id % 100 < 10").withColumn("part", F.when(F.col("group") % 5 != 0, "train").otherwise("test"))
    rows = W.split_leakage(by_row, 0.35).select(F.lit("rows").alias("split"), "*")
    return rows.unionByName(W.split_leakage(by_group, 0.35, disjoint=True).select(F.lit("groups").alias("split"), "*"))


# Variants: a bank of the even ids, asked for cells of it as they are and mixed with their neighbours, and for others.
_VARIANTS = ["raw", "centred", "zca"]
_SPACES = f"""{_MOMENTS}, mx AS (SELECT cov AS a, trace AS scale FROM co), {_ROOT}, y AS (SELECT 'raw' AS variant, vec_id, x AS v FROM e UNION ALL SELECT 'centred', vec_id, x FROM xs UNION ALL SELECT 'zca', vec_id, w FROM wh),
b AS (SELECT variant, vec_id AS cell_id, list_transform(v, lambda z: z / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS w FROM y WHERE vec_id % 2 = 0),
k AS (SELECT vec_id AS query_id, CASE vec_id % 100 WHEN 0 THEN 'exact' WHEN 50 THEN 'paraphrase' WHEN 25 THEN 'near_miss' ELSE 'unrelated' END AS kind FROM e WHERE vec_id % 100 IN (0, 25, 50, 75)),
m AS (SELECT p.variant, query_id, kind, CASE WHEN kind IN ('paraphrase', 'near_miss') THEN list_transform(list_zip(p.v, n.v), lambda z: 0.6 * z[1] + 0.4 * z[2]) ELSE p.v END AS v FROM k JOIN y p ON p.vec_id = query_id LEFT JOIN y n ON n.vec_id = query_id + 1 AND n.variant = p.variant),
q AS (SELECT variant, query_id, kind, list_transform(v, lambda z: z / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS qv FROM m),
s AS (SELECT b.variant, query_id, kind, cell_id, list_inner_product(qv, w) AS act FROM q JOIN b ON b.variant = q.variant),
p AS (SELECT variant, query_id, any_value(kind) IN ('exact', 'paraphrase') AS positive, any_value(kind) AS kind, max(act) AS best, max(act) FILTER (cell_id = query_id) AS target FROM s GROUP BY variant, query_id),
r AS (SELECT *, CASE WHEN positive THEN target ELSE best END AS score FROM p), z AS (SELECT variant, min(score) - 1e-9 AS lo, CASE WHEN max(score) <= min(score) - 1e-9 THEN min(score) + 1e-6 ELSE max(score) END + 1e-9 AS hi FROM r GROUP BY variant),
g AS (SELECT variant, i, lo + (hi - lo) * i / 255 AS t FROM z, (SELECT unnest(range(256)) AS i)), w AS (SELECT g.variant, i, t, avg((score > t)::INT) FILTER (positive) AS recall, avg((score > t)::INT) FILTER (NOT positive) AS wrong FROM g JOIN r ON r.variant = g.variant GROUP BY g.variant, i, t),
h AS (SELECT variant, t, wrong <= 0.1 AS feasible FROM w QUALIFY row_number() OVER (PARTITION BY variant ORDER BY (wrong <= 0.1) DESC, CASE WHEN wrong <= 0.1 THEN round(recall, 9) ELSE round(recall - wrong, 9) END DESC, CASE WHEN wrong <= 0.1 THEN round(wrong, 9) ELSE 0 END, i) = 1)"""


def _spaces(spark, d):
    """(cells, queries) in all variants, stored."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    white = geometry.fit_whitening(e, "v")
    variants = {"raw": None, "centred": geometry.Whitening(white.mean, np.eye(len(white.mean)), 1.0, white.rows), "zca": white}
    r = F.col("vec_id") % 100
    asked = e.where(r.isin(0, 25, 50, 75)).withColumn("kind", F.when(r == 0, "exact").when(r == 50, "paraphrase").when(r == 25, "near_miss").otherwise("unrelated"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("next"))
    mixed = F.when(F.col("kind").isin("paraphrase", "near_miss"), F.zip_with("v", "next", lambda a, b: 0.6 * a + 0.4 * b)).otherwise(F.col("v"))
    asked = asked.join(following, "vec_id", "left").select(F.col("vec_id").alias("query_id"), "kind", F.when(F.col("kind").isin(*X.POSITIVE), F.col("vec_id")).alias("target_id"), mixed.alias("v"))
    cells = stored(X.in_variants(e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "cell_id"), "cell_id", "v", variants), "cells")
    queries = stored(X.in_variants(asked, "query_id", "v", variants, ("kind", "target_id")), "asked")
    return cells, queries


@query(f"""WITH RECURSIVE {_SPACES}, l AS (SELECT variant, quantile_cont(score, 0.05) AS low FROM r WHERE positive GROUP BY variant)
SELECT r.variant, round(t, 6) AS threshold, feasible, round(avg((score > t)::INT) FILTER (kind = 'exact'), 6) AS exact_recall, round(avg((score > t)::INT) FILTER (kind = 'paraphrase'), 6) AS paraphrase_recall, round(avg((score > t)::INT) FILTER (kind = 'near_miss'), 6) AS near_miss_false_fires, round(avg((score > t)::INT) FILTER (kind = 'unrelated'), 6) AS unrelated_false_fires,
round(avg((best <= t)::INT), 6) AS silence_rate, round(quantile_cont(score - t, 0.5) FILTER (positive), 6) AS median_positive_margin, round(quantile_cont(score - t, 0.05) FILTER (positive), 6) AS p05_positive_margin, round(quantile_cont(score - t, 0.95) FILTER (NOT positive), 6) AS p95_negative_margin, round(avg((score >= low)::INT) FILTER (NOT positive), 6) AS margin_overlap
FROM r JOIN h USING (variant) JOIN l USING (variant) GROUP BY r.variant, t, feasible""")
def variant_evaluation(spark, d):
    """Recall, false fires and margins of each variant at its own best threshold."""
    cells, queries = _spaces(spark, d)
    return X.variant_report(X.variant_scores(cells, queries, _VARIANTS), queries.select("query_id", "kind"), _VARIANTS)


@query(f"""WITH RECURSIVE {_SPACES}, f AS (SELECT s.variant, query_id, cell_id FROM s WHERE act > 0.4), c AS (SELECT variant, count(*) AS n FROM f GROUP BY variant), v AS (SELECT unnest(['raw', 'centred', 'zca']) AS a),
x AS (SELECT f.variant AS a, o.variant AS b, count(*) AS n FROM f JOIN f o USING (query_id, cell_id) GROUP BY f.variant, o.variant)
SELECT v.a, u.a AS b, coalesce(x.n, 0)::BIGINT AS in_both, (coalesce(ca.n, 0) + coalesce(cb.n, 0) - coalesce(x.n, 0))::BIGINT AS in_either FROM v, v u LEFT JOIN x ON x.a = v.a AND x.b = u.a LEFT JOIN c ca ON ca.variant = v.a LEFT JOIN c cb ON cb.variant = u.a""")
def variant_overlap(spark, d):
    """How many cells fire in two variants at once, at a threshold of 0.4."""
    cells, queries = _spaces(spark, d)
    return X.fired_overlap(cells, queries, {v: 0.4 for v in _VARIANTS})
