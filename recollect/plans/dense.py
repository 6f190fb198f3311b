"""Queries over vectors: retrieval, gates, thresholds, metrics, geometry. The query set is each vector whose id is divisible by 100."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators import activation as N
from recollect.operators import corpus, evaluation, gates, geometry, governance
from recollect.operators import retrieval as R
from recollect.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: All pairs of the query set and the cells.
PAIRS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS query_label FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS w, label FROM embeddings),
s AS (SELECT query_id, query_label, cell_id, label, list_inner_product(qv, w) AS act FROM q, c)"""
#: The best n cells per query by activation, silent ones too.
RANKED = PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, cell_id) AS rank FROM s QUALIFY rank <= {n})"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The best k cells per query by activation, with both labels."""
    e = _vectors(spark, d)
    q = R.as_queries(e)
    found = R.topk(R.as_cells(e), q, k, by="act", include_silent=True)
    labels = e.select(F.col("vec_id").alias("cell_id"), "label")
    return found.join(labels, "cell_id").join(F.broadcast(q.select("query_id", "query_label")), "query_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""WITH {PAIRS}, f AS (SELECT query_id, cell_id, act, act - 0.22 AS margin FROM s WHERE act - 0.22 > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(margin, 9) DESC, cell_id)::INT AS rank, cell_id, round(act, 6) AS act, round(margin, 6) AS margin, true AS fired FROM f QUALIFY rank <= 10""")
def dense_topk(spark, d):
    e = _vectors(spark, d)
    return _rounded(R.topk(R.as_cells(e), R.as_queries(e), 10), "act", "margin")


@query(f"""WITH {RANKED.format(n=10)} SELECT query_id, rank::INT AS rank, cell_id, round(act, 6) AS act, round(act - 0.22, 6) AS margin, act - 0.22 > 0 AS fired FROM r""")
def topk_include_silent(spark, d):
    e = _vectors(spark, d)
    return _rounded(R.topk(R.as_cells(e), R.as_queries(e), 10, by="act", include_silent=True), "act", "margin")


@query(f"""WITH {PAIRS}, f AS (SELECT query_id, cell_id, act FROM s WHERE cell_id % 7 <> 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, cell_id)::INT AS rank, cell_id, round(act, 6) AS act FROM f QUALIFY rank <= 10""")
def topk_tombstoned(spark, d):
    e = _vectors(spark, d)
    gone = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("base_cell_id"))
    live = R.without_tombstones(R.as_cells(e), gone).select("cell_id", "weight", "theta")
    return _rounded(R.topk(live, R.as_queries(e), 10, by="act", include_silent=True), "act").select("query_id", "rank", "cell_id", "act")


@query("""SELECT vec_id AS cell_id, label, 'base' AS source FROM embeddings WHERE vec_id % 2 = 0
UNION ALL SELECT vec_id + 1000000000, label, 'overlay' FROM embeddings WHERE vec_id % 2 = 1""")
def overlay_merge(spark, d):
    c = R.as_cells(_vectors(spark, d))
    overlay = c.where("cell_id % 2 = 1").withColumn("cell_id", F.col("cell_id") + 1_000_000_000)
    return R.with_overlay(c.where("cell_id % 2 = 0"), overlay).select("cell_id", "label", "source")


@query(f"""WITH {PAIRS}, f AS (SELECT query_id, cell_id, act - 0.22 AS margin FROM s WHERE act - 0.22 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(margin, 9) DESC, cell_id)::INT AS rank FROM f QUALIFY rank <= 5)
SELECT query_id, rank, cell_id, md5(text) AS text_md5 FROM r LEFT JOIN documents ON doc_id = cell_id""")
def fired_with_text(spark, d):
    e = _vectors(spark, d)
    top = R.topk(R.as_cells(e), R.as_queries(e), 5)
    return top.join(table(spark, d, "documents"), F.col("cell_id") == F.col("doc_id"), "left").select("query_id", "rank", "cell_id", F.md5("text").alias("text_md5"))


@query("""SELECT theta, count(*) AS n FROM (SELECT CASE label % 3 WHEN 0 THEN 0.22 WHEN 1 THEN 0.30 ELSE 0.5 END::DOUBLE AS theta FROM embeddings) GROUP BY theta""")
def theta_distribution(spark, d):
    theta = F.when(F.col("label") % 3 == 0, 0.22).when(F.col("label") % 3 == 1, 0.30).otherwise(0.5)
    return _vectors(spark, d).groupBy(theta.alias("theta")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id AS cell_id, CASE WHEN label % 2 = 0 AND label % 3 = 0 THEN 0.22 WHEN label % 3 = 0 THEN 0.30 ELSE 0.5 END::DOUBLE AS theta FROM embeddings""")
def theta_migration(spark, d):
    """Single cells (even label) at the old threshold move to the new one; others stay."""
    old = F.when(F.col("label") % 3 == 0, 0.30).otherwise(0.5)
    return _vectors(spark, d).select(F.col("vec_id").alias("cell_id"), F.when((F.col("label") % 2 == 0) & (old == 0.30), 0.22).otherwise(old).alias("theta"))


@query(f"""WITH {RANKED.format(n=10)}, t AS (SELECT query_id, max(act) FILTER (rank = 1) AS a, max(act) FILTER (rank = 2) AS b FROM r GROUP BY query_id)
SELECT query_id, round(a, 6) AS top1, round(b, 6) AS top2, round(a - b, 6) AS gate_margin, a - b >= 0.015 AS fires, CASE WHEN a - b >= 0.015 THEN 'margin above' ELSE 'margin below' END AS reason FROM t""")
def silence_gate(spark, d):
    return _rounded(gates.gate(_ranked(spark, d, 10).select("query_id", "act")), "top1", "top2", "gate_margin")


@query(f"""WITH {RANKED.format(n=2)}, t AS (SELECT query_id, max(act) - min(act) AS m FROM r GROUP BY query_id), g AS (SELECT unnest(range(9)) * 0.005 AS threshold)
SELECT round(threshold, 3)::DOUBLE AS threshold, count(*) FILTER (m >= threshold) AS answered, count(*) FILTER (m < threshold) AS silent FROM t, g GROUP BY 1""")
def gate_threshold_sweep(spark, d):
    margins = gates.gate(_ranked(spark, d, 2).select("query_id", "act")).select("gate_margin")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i * 0.005))
    rows = margins.select("gate_margin", grid.alias("t"))
    return rows.groupBy(F.round("t", 3).alias("threshold")).agg(F.count_if(F.col("gate_margin") >= F.col("t")).alias("answered"), F.count_if(F.col("gate_margin") < F.col("t")).alias("silent"))


@query(f"""WITH {RANKED.format(n=10)} SELECT query_id, round(max(act) FILTER (rank = 1) - avg(act) FILTER (rank > 1), 6) AS margin_rest FROM r GROUP BY query_id""")
def margin_vs_rest(spark, d):
    return _rounded(gates.margin_vs_rest(_ranked(spark, d, 10)), "margin_rest")


def _bank(spark, d) -> tuple[DataFrame, DataFrame]:
    e = _vectors(spark, d)
    return R.as_cells(e), R.as_queries(e)


@query(f"""WITH {PAIRS}, b AS (SELECT quantile_cont(act, 0.95) AS bar FROM s WHERE label <> query_label), p AS (
SELECT 'fixed' AS policy, CASE WHEN act > 0.22 THEN 'fire' ELSE 'silent' END AS decision FROM s
UNION ALL SELECT 'quantile', CASE WHEN act > bar + 1e-12 THEN 'fire' ELSE 'silent' END FROM s, b
UNION ALL SELECT 'band', CASE WHEN act >= 0.3 THEN 'fire' WHEN act <= 0.15 THEN 'silent' ELSE 'ambiguous' END FROM s
UNION ALL SELECT 'two_stage', CASE WHEN act <= 0.15 THEN 'silent' WHEN act >= 0.25 + 0.02 THEN 'fire' ELSE 'ambiguous' END FROM s)
SELECT policy, decision, count(*)::BIGINT AS n FROM p GROUP BY policy, decision""")
def threshold_policies(spark, d):
    """How each policy decides over all pairs: pairs are counted between the policies' bounds, and a policy adds up intervals."""
    cells, q = _bank(spark, d)
    bar = N.quantile(cells, q, N.OTHER, 0.95)
    bounds = sorted({0.15, 0.22, math.nextafter(0.25 + 0.02, 0), math.nextafter(0.3, 0), bar + 1e-12})
    counted = N.counts_above(cells, q, bounds)
    # a value within each interval stands for all in it
    inner = [bounds[0] - 1, *[(a + b) / 2 for a, b in zip(bounds, bounds[1:])], bounds[-1] + 1]
    a = F.element_at(F.array(*map(F.lit, inner)), (F.col("place") + 1).cast("int"))
    per = {"fixed": gates.fixed(a, F.lit(0.22)), "quantile": gates.fixed(a, F.lit(bar + 1e-12)), "band": gates.band(a, 0.15, 0.3), "two_stage": gates.two_stage(a, 0.15, 0.25, 0.02)}
    rows = counted.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("decision")) for k, v in per.items()])).alias("x"))
    return rows.groupBy("x.policy", "x.decision").agg(F.sum("n").alias("n"))


_SWEEP = PAIRS + """, x AS (SELECT act AS score, label = query_label AS positive FROM s WHERE cell_id <> query_id), b AS (SELECT min(score) - 1e-9 AS lo, max(score) + 1e-9 AS hi FROM x),
g AS (SELECT i AS t_index, lo + (hi - lo) * i / 255 AS t FROM b, (SELECT unnest(range(256)) AS i)),
w AS (SELECT t_index, t, avg((score > t)::INT) FILTER (positive) AS recall, avg((score > t)::INT) FILTER (NOT positive) AS false_fire FROM g, x GROUP BY ALL)"""


def _swept(spark, d) -> DataFrame:
    """The sweep of 256 thresholds over all pairs but those of a query with its own cell."""
    cells, q = _bank(spark, d)
    lo, hi = N.summary(cells, q).where(F.col("kind") != N.SELF).agg(F.min("lo"), F.max("hi")).first()
    edges = [lo - 1e-9 + (hi - lo + 2e-9) * i / 255 for i in range(256)]
    counts = N.counts_above(cells, q, edges).where(F.col("kind") != N.SELF).select("place", (F.col("kind") == N.SAME).alias("positive"), "n")
    return gates.sweep_of_counts(counts, spark.createDataFrame(list(enumerate(edges)), "t_index int, t double"))


@query(f"""WITH {_SWEEP} SELECT t_index::INT AS t_index, round(t, 6) AS t, round(recall, 6) AS recall, round(false_fire, 6) AS false_fire FROM w""")
def threshold_sweep(spark, d):
    return _rounded(_swept(spark, d), "t", "recall", "false_fire")


@query(f"""WITH {_SWEEP} SELECT round(t, 6) AS t, round(recall, 6) AS recall, round(false_fire, 6) AS false_fire, false_fire <= 0.1 AS feasible FROM w
ORDER BY (false_fire <= 0.1) DESC, CASE WHEN false_fire <= 0.1 THEN round(recall, 9) ELSE round(recall - false_fire, 9) END DESC, CASE WHEN false_fire <= 0.1 THEN round(false_fire, 9) ELSE 0 END, t_index LIMIT 1""")
def best_threshold(spark, d):
    return _rounded(gates.best_of_sweep(_swept(spark, d)), "t", "recall", "false_fire").select("t", "recall", "false_fire", "feasible")


@query(f"""WITH {PAIRS}, p AS (SELECT quantile_cont(act, 0.99) FILTER (label <> query_label) AS f, quantile_cont(act, 0.10) FILTER (label = query_label AND cell_id <> query_id) AS p FROM s)
SELECT round(f, 6) AS foreign_p99, round(p, 6) AS positive_p10, f < p AS clean_band, round(CASE WHEN f < p THEN (f + p) / 2 ELSE f END, 6) AS theta FROM p""")
def theta_recommendation(spark, d):
    cells, q = _bank(spark, d)
    f, p = N.quantile(cells, q, N.OTHER, 0.99), N.quantile(cells, q, N.SAME, 0.10)
    bars = spark.createDataFrame([(f, p)], "foreign_p99 double, positive_p10 double")
    return _rounded(gates.recommended(bars), "foreign_p99", "positive_p10", "theta")


@query(f"""WITH {PAIRS} SELECT query_id, cell_id, round(act, 6) AS act, label = query_label AS same_label FROM s WHERE cell_id <> query_id AND act > 0.22
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, cell_id) <= 20""")
def confusion_pairs(spark, d):
    """Of each query the 20 closest other cells that fire for it."""
    r = _ranked(spark, d, 21).where("cell_id <> query_id AND act > 0.22")
    w = Window.partitionBy("query_id").orderBy("rank")
    r = r.withColumn("n", F.row_number().over(w)).where("n <= 20")
    return r.select("query_id", "cell_id", F.round("act", 6).alias("act"), (F.col("label") == F.col("query_label")).alias("same_label"))


@query(f"""WITH {PAIRS}, x AS (SELECT act, label = query_label AS same FROM s WHERE cell_id <> query_id)
SELECT round(avg(act) FILTER (same), 6) AS mean_same, round(avg(act) FILTER (NOT same), 6) AS mean_other, round((avg(act) FILTER (same) - avg(act) FILTER (NOT same)) / sqrt((var_pop(act) FILTER (same) + var_pop(act) FILTER (NOT same)) / 2), 4) AS cohens_d,
round(quantile_cont(act, 0.95) FILTER (NOT same), 6) AS other_p95 FROM x""")
def confusion_effect_size(spark, d):
    cells, q = _bank(spark, d)
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    m = N.summary(cells, q).agg(of(N.SAME, "mean").alias("a"), of(N.OTHER, "mean").alias("b"), of(N.SAME, "variance").alias("va"), of(N.OTHER, "variance").alias("vb"))
    effect = (F.col("a") - F.col("b")) / F.sqrt((F.col("va") + F.col("vb")) / 2)
    return m.select(F.round("a", 6).alias("mean_same"), F.round("b", 6).alias("mean_other"), F.round(effect, 4).alias("cohens_d"), F.lit(round(N.quantile(cells, q, N.OTHER, 0.95), 6)).alias("other_p95"))


@query(f"""WITH {PAIRS} SELECT query_id AS cell_id, round(max(act) FILTER (cell_id = query_id), 6) AS own, round(max(act) FILTER (cell_id <> query_id), 6) AS best_other, max(act) FILTER (cell_id <> query_id) <= 0.95 AS separated FROM s GROUP BY query_id""")
def separation_report(spark, d):
    r = N.separation(*_bank(spark, d))
    return r.select(F.col("query_id").alias("cell_id"), F.round("own", 6).alias("own"), F.round("best_other", 6).alias("best_other"), (F.col("best_other") <= 0.95).alias("separated"))


@query(f"""WITH {PAIRS}, p AS (SELECT query_id, count(*) FILTER (act > 0.5) AS fires, max(act) AS best FROM s WHERE cell_id % 100 <> 0 GROUP BY query_id), a AS (SELECT avg((fires = 0)::INT) AS silence, avg(fires) AS mean_fires, max(fires) AS max_fires, avg(best - 0.5) AS margin_mean, quantile_cont(best - 0.5, 0.5) AS margin_median FROM p)
SELECT round(silence, 6) AS silence_rate, round(mean_fires, 6) AS mean_fires, max_fires, round(margin_mean, 6) AS margin_mean, round(margin_median, 6) AS margin_median, CASE WHEN silence > 0.99 THEN 'PERFECT' WHEN silence > 0.95 THEN 'GOOD' WHEN silence > 0.80 THEN 'LEAKY' ELSE 'BROKEN' END AS verdict FROM a""")
def rejection_report(spark, d):
    """Held-out vectors (the query set) against the bank of all others at a threshold of 0.5."""
    e = _vectors(spark, d)
    cells, q = R.as_cells(e.where("vec_id % 100 <> 0"), 0.5), R.as_queries(e)
    p = N.fire_counts(cells, q, 0.5).select("fires", (F.col("best") - 0.5).alias("margin"))
    a = p.agg(F.avg((F.col("fires") == 0).cast("int")).alias("silence"), F.avg("fires").alias("mean_fires"), F.max("fires").alias("max_fires"), F.avg("margin").alias("m"), F.percentile("margin", 0.5).alias("h"))
    return a.select(F.round("silence", 6).alias("silence_rate"), F.round("mean_fires", 6).alias("mean_fires"), "max_fires", F.round("m", 6).alias("margin_mean"), F.round("h", 6).alias("margin_median"), gates.rejection_verdict(F.col("silence")).alias("verdict"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, cell_id) AS rank FROM s),
p AS (SELECT query_id, min(rank) FILTER (cell_id = query_id) AS own, avg((label = query_label)::INT) FILTER (rank <= 5) AS purity FROM r GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg((own IS NOT NULL AND own <= 1)::INT), 6) AS recall_at_1, round(avg((own IS NOT NULL AND own <= 5)::INT), 6) AS recall_at_k, round(avg(coalesce(1.0 / own, 0)), 6)::DOUBLE AS mrr, round(avg(purity), 6) AS purity_at_k FROM p""")
def retrieval_eval(spark, d):
    return evaluation.retrieval_eval(_ranked(spark, d, 5), N.own_ranks(*_bank(spark, d)))


@query(f"""WITH {RANKED.format(n=5)} SELECT query_id, rank::INT AS rank, cell_id, round(act, 6) AS act, CASE WHEN act - 0.22 > 0 THEN 'above_threshold' ELSE 'below_threshold' END AS status FROM r""")
def candidate_status(spark, d):
    return R.candidate_status(_ranked(spark, d, 5))


@query(f"""WITH {RANKED.format(n=20)}, t AS (SELECT query_id, cell_id, rank, 1.0 / (1 + cell_id % 11) AS score FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cell_id) AS new_rank FROM t QUALIFY new_rank <= 5)
SELECT query_id, cell_id, rank::INT AS rank, new_rank::INT AS new_rank FROM n WHERE score >= 0.3""")
def rerank_with_floor(spark, d):
    r = _ranked(spark, d, 20)
    scores = r.select("query_id", "cell_id", (1.0 / (1 + F.col("cell_id") % 11)).alias("score"))
    return R.reranked(r, scores, 5, 0.3).select("query_id", "cell_id", "rank", "new_rank")


@query(f"""WITH {RANKED.format(n=8)}, o AS (SELECT q.query_id, c.cell_id FROM q, c WHERE c.label = q.query_label AND c.cell_id % 3 = 0), x AS (SELECT r.query_id, r.rank, r.cell_id FROM r ANTI JOIN o ON r.query_id = o.query_id AND r.cell_id = o.cell_id WHERE r.cell_id <> r.query_id),
k AS (SELECT query_id, cell_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot FROM x QUALIFY slot <= 2), z AS (SELECT query_id, cell_id AS top1, unnest([1, 2]) AS slot FROM r WHERE rank = 1)
SELECT z.query_id, z.slot::INT AS slot, coalesce(k.cell_id, top1) AS cell_id, k.cell_id IS NULL AS filled FROM z LEFT JOIN k ON z.query_id = k.query_id AND z.slot = k.slot""")
def neighbors_self_excluded(spark, d):
    """Two neighbours per chunk; its own cell, and a third of the cells of its label, are its sources and no neighbours."""
    e = _vectors(spark, d)
    q = R.as_queries(e)
    own = F.broadcast(q.select("query_id", F.col("query_label").alias("label"))).join(e, "label").where("vec_id % 3 = 0").select("query_id", F.col("vec_id").alias("cell_id"))
    own = own.unionByName(q.select("query_id", F.col("query_id").alias("cell_id"))).distinct()
    return corpus.neighbors_without_self(_ranked(spark, d, 8), own, 2)


@query("""SELECT count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm_mean, round(stddev_pop(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm_std,
(SELECT round(avg(abs(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) AS mean_abs_cos, (SELECT count(*) FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) AS n_pairs FROM embeddings""")
def isotropy_norms(spark, d):
    return geometry.isotropy(_vectors(spark, d))


@query("""WITH u AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), v AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i)
SELECT round((sum(c) FILTER (i = j)) ^ 2 / sum(c * c), 4) AS participation_ratio FROM v""")
def participation_ratio(spark, d):
    _, _, cov = geometry.moments(_vectors(spark, d))
    return spark.createDataFrame([(round(geometry.participation_ratio(cov), 4),)], "participation_ratio double")


#: Mean and covariance of the vectors chosen as lists of numbers: cov is a list of rows; xs: all vectors, less the mean of those chosen.
_MOMENTS_OF = """e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(x) AS v FROM e), mn AS (SELECT i, avg(v) AS m FROM u WHERE {chosen} GROUP BY i), cx AS (SELECT vec_id, i, v - m AS v FROM u JOIN mn USING (i)),
cv AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS c FROM (FROM cx WHERE {chosen}) a JOIN cx b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
co AS (SELECT list(r ORDER BY i) AS cov, sum(tr) AS trace FROM (SELECT i, list(c ORDER BY j) AS r, sum(c) FILTER (i = j) AS tr FROM cv GROUP BY i)), xs AS (SELECT vec_id, list(v ORDER BY i) AS x FROM cx GROUP BY vec_id)"""
_MOMENTS = _MOMENTS_OF.format(chosen="true")
_PRODUCT = "list_transform({a}, lambda r: list_transform({b}, lambda c: list_inner_product(r, c)))"  # of symmetric matrices
#: The inverse square root of a symmetric matrix `a`: y goes to its root and z to the inverse, as (3 - z y) / 2 goes to 1.
_ROOT = f"""one AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS i),
ns AS (
  SELECT 0 AS n, list_transform(a, lambda r: list_transform(r, lambda v: v / scale)) AS y, one.i AS z FROM mx, one
  UNION ALL
  SELECT n + 1, {_PRODUCT.format(a="y", b="t")}, {_PRODUCT.format(a="t", b="z")}
  FROM (SELECT n, y, z, list_transform(list_zip(one.i, {_PRODUCT.format(a="z", b="y")}), lambda p: list_transform(list_zip(p[1], p[2]), lambda v: (3 * v[1] - v[2]) / 2)) AS t FROM ns, one WHERE n < 40)),
rt AS (SELECT list_transform(z, lambda r: list_transform(r, lambda v: v / sqrt(scale))) AS matrix FROM ns, mx WHERE n = 40),
wh AS (SELECT vec_id, list_transform(matrix, lambda r: list_inner_product(r, x)) AS w FROM xs, rt)"""


def _whitened(matrix: str, headroom: float, out: str = "list_transform(w, lambda v: round(v / (longest + 1e-8), 4) + 0.0) AS whitened") -> str:
    return f"WITH RECURSIVE {_MOMENTS}, {matrix}, lo AS (SELECT {headroom} * max(sqrt(list_inner_product(w, w))) AS longest FROM wh) SELECT vec_id, {out} FROM wh, lo"


def _rounded_vectors(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.transform("whitened", lambda v: F.round(v, 4) + 0.0).alias("whitened"))


_SHRUNK = "list_transform(cov, lambda r, i: list_transform(r, lambda v, j: 0.8 * v + CASE WHEN i = j THEN 0.2 * trace / 64 ELSE 0 END))"


@query(_whitened(f"mx AS (SELECT cov AS a, trace AS scale FROM co), {_ROOT}", 1.5))
def whiten_zca(spark, d):
    e = _vectors(spark, d)
    return _rounded_vectors(geometry.fit_whitening(e).apply(e))


@query(
    _whitened(
        f"""pw AS (
  SELECT 0 AS n, list_transform(cov, lambda r: list_transform(r, lambda v: v / trace)) AS p FROM co
  UNION ALL
  SELECT n + 1, list_transform(q, lambda r: list_transform(r, lambda v: v / list_sum(list_transform(q, lambda s, i: s[i])))) FROM (SELECT n, {_PRODUCT.format(a="p", b="p")} AS q FROM pw WHERE n < 24)),
wh AS (SELECT vec_id, list_transform(list_zip(x, list_transform(p, lambda r: list_inner_product(r, x))), lambda v: v[1] - v[2]) AS w FROM xs, pw WHERE n = 24)""",
        1.5,
    )
)
def whiten_abtt(spark, d):
    """The direction of the greatest variance goes; the SQL finds its projector by squaring the covariance over and over."""
    e = _vectors(spark, d)
    return _rounded_vectors(geometry.fit_whitening(e, method="abtt").apply(e))


@query(_whitened(f"mx AS (SELECT cov AS a, trace AS scale FROM co), {_ROOT}", 1.0, "round(sqrt(list_inner_product(w, w)) / (longest + 1e-8), 5) AS norm"))
def whiten_pca(spark, d):
    """Norms after PCA whitening: axes have no sign of their own, and a turn of the axes leaves norms as they are."""
    e = _vectors(spark, d)
    white = geometry.fit_whitening(e, method="pca", headroom=1.0).apply(e)
    return white.select("vec_id", F.round(V.norm(F.col("whitened")), 5).alias("norm"))


@query(_whitened(f"mx AS (SELECT {_SHRUNK} AS a, trace AS scale FROM co), {_ROOT}", 1.0))
def whiten_shrinkage(spark, d):
    e = _vectors(spark, d)
    return _rounded_vectors(geometry.fit_whitening(e, method="shrinkage", headroom=1.0).apply(e))


@query("""WITH RECURSIVE x AS (SELECT vec_id // 4 AS group_id, vec_id, list_transform(embedding::DOUBLE[], lambda v: v / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS x FROM embeddings),
g AS (SELECT group_id, arg_min(x, vec_id) AS first, count(*) AS m FROM x GROUP BY group_id),
s AS (SELECT group_id, list(v ORDER BY i) AS total FROM (SELECT group_id, i, sum(v) AS v FROM (SELECT group_id, unnest(range(1, 65)) AS i, unnest(x) AS v FROM x) GROUP BY ALL) GROUP BY group_id),
k AS (SELECT g.group_id, m, first, total, list_inner_product(first, total) AS ft, list_inner_product(total, total) AS tt FROM g JOIN s USING (group_id)),
o AS (
  SELECT group_id, 0 AS n, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM k
  UNION ALL
  SELECT group_id, n + 1, a - c * y * a, b + c - c * y * b
  FROM (SELECT o.*, y, 0.05 * greatest(y - 0.3, 0) * y AS c FROM (SELECT o.*, a * ft + b * tt AS y FROM o JOIN k USING (group_id) WHERE n < 300) o)),
w AS (SELECT k.group_id, m, list_transform(list_zip(first, total), lambda v: a * v[1] + b * v[2]) AS weight FROM o JOIN k USING (group_id) WHERE n = 300),
p AS (SELECT w.group_id, min(list_inner_product(weight, x)) AS least FROM w JOIN x USING (group_id) GROUP BY w.group_id)
SELECT group_id, m, round(greatest(least - 0.02, 0), 6) AS theta, round(least, 6) AS min_projection, list_transform(weight, lambda v: round(v, 4) + 0.0) AS weight FROM w JOIN p USING (group_id)""")
def oja_bind_quads(spark, d):
    """Groups of four vectors by id bound into one cell each; the steps settle."""
    return _bound_groups(spark, d, 4)


@query(f"""WITH RECURSIVE {_MOMENTS_OF.format(chosen="vec_id % 2 = 0")}, mx AS (SELECT cov AS a, trace AS scale FROM co), {_ROOT},
m AS (SELECT vec_id, x AS b, w FROM wh JOIN e USING (vec_id) WHERE vec_id % 2 = 1), b0 AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(b) AS v, unnest(w) AS z FROM m),
b1 AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v, z - avg(z) OVER (PARTITION BY i) AS z FROM b0),
b2 AS (SELECT p.i, q.i AS j, sum(p.v * q.v) AS cv, sum(p.z * q.z) AS cz FROM b1 p JOIN b1 q ON p.vec_id = q.vec_id GROUP BY p.i, q.i),
b3 AS (SELECT (sum(cv) FILTER (i = j)) ^ 2 / sum(cv * cv) / 64 AS dv, (sum(cz) FILTER (i = j)) ^ 2 / sum(cz * cz) / 64 AS dz FROM b2),
c AS (SELECT abs(avg(list_cosine_similarity(p.b, q.b))) AS cb, abs(avg(list_cosine_similarity(p.w, q.w))) AS ca FROM m p JOIN m q ON q.vec_id = p.vec_id + 2)
SELECT (SELECT count(*) FROM e WHERE vec_id % 2 = 0) AS n_fit, round(dv, 4) AS dim_before, round(dz, 4) AS dim_after, round(cb, 5) AS cos_before, round(ca, 5) AS cos_after, dz >= 0.95 AS dim_pass, ca <= 0.05 AS cos_pass FROM b3, c""")
def whitening_gates(spark, d):
    """Fitted on vectors of even ids, measured on the others."""
    e = _vectors(spark, d)
    return geometry.whitening_gates(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), step=2)


@query("""WITH RECURSIVE x AS (SELECT vec_id // 20 AS trial, vec_id, vec_id % 20 < 3 AS own, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT trial, list_transform(arg_min(x, vec_id), lambda v: v / greatest(sqrt(list_inner_product(arg_min(x, vec_id), arg_min(x, vec_id))), 1e-12)) AS first, count(*) AS m FROM x WHERE own GROUP BY trial),
s AS (SELECT trial, list(v ORDER BY i) AS total FROM (SELECT trial, i, sum(v) AS v FROM (SELECT trial, unnest(range(1, 65)) AS i, unnest(x) AS v FROM x WHERE own) GROUP BY ALL) GROUP BY trial),
k AS (SELECT g.trial, m, first, total, list_inner_product(first, total) AS ft, list_inner_product(total, total) AS tt FROM g JOIN s USING (trial)),
o AS (
  SELECT trial, 0 AS n, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM k
  UNION ALL
  SELECT trial, n + 1, a - c * y * a, b + c - c * y * b
  FROM (SELECT o.*, y, 0.05 * greatest(y - 0.3, 0) * y AS c FROM (SELECT o.*, a * ft + b * tt AS y FROM o JOIN k USING (trial) WHERE n < 300) o)),
w AS (SELECT k.trial, m, total, list_transform(list_zip(first, total), lambda v: a * v[1] + b * v[2]) AS weight FROM o JOIN k USING (trial) WHERE n = 300),
p AS (SELECT x.trial, own, list_inner_product(weight, x) AS act FROM w JOIN x USING (trial)), q AS (SELECT trial, min(act) FILTER (own) - 0.02 AS bar FROM p GROUP BY trial),
t AS (SELECT p.trial, count(*) FILTER (own AND act > bar) AS fired, count(*) FILTER (NOT own AND act > bar) AS wrong FROM p JOIN q USING (trial) GROUP BY p.trial)
SELECT w.m, count(*) AS n_trials, round(avg((fired = m AND wrong = 0)::INT), 6) AS success_rate, round(avg(wrong), 6) AS mean_false_fires, round(avg(list_cosine_similarity(weight, total)), 6) AS mean_alignment, avg((fired = m AND wrong = 0)::INT) >= 0.92 AS success_passes, avg(wrong) <= 1 AS false_fires_passes
FROM t JOIN w USING (trial) GROUP BY w.m""")
def binding_calibration(spark, d):
    """Trials of twenty vectors by id: three are bound, the others must stay silent."""
    e = _vectors(spark, d).select(F.expr("vec_id div 20").alias("trial"), F.col("vec_id").alias("item_id"), (F.col("vec_id") % 20 < 3).alias("is_item"), F.col("embedding").alias("vector"))
    return geometry.binding_report(geometry.binding_tests(e))


@query()
def oja_bind(spark, d):
    """Groups of eight: the sum of their vectors is so long that Euler steps of 0.05 don't settle but go on swinging, so that the last digits of a sum decide the outcome and SQL can't tell it."""
    return _bound_groups(spark, d, 8)


def _bound_groups(spark, d, m: int) -> DataFrame:
    e = _vectors(spark, d).select(F.expr(f"vec_id div {m}").alias("group_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return _rounded(geometry.bind(e), "theta", "min_projection").select("group_id", "m", "theta", "min_projection", F.transform("weight", lambda v: F.round(v, 4) + 0.0).alias("weight"))


@query("""WITH t AS (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT vec_id AS cell_id, round(n, 6) AS norm, round(n - 0.05, 6) AS theta_norm, round(1 - 0.05 / 0.9, 6) AS cosine_bar FROM t""")
def build_cells(spark, d):
    n = V.norm(F.col("embedding"))
    return _vectors(spark, d).select(F.col("vec_id").alias("cell_id"), F.round(n, 6).alias("norm"), F.round(n - 0.05, 6).alias("theta_norm"), F.round(F.lit(1 - 0.05 / 0.9), 6).alias("cosine_bar"))


@query("""WITH c AS (SELECT CASE label % 3 WHEN 0 THEN 0.22 WHEN 1 THEN 0.30 ELSE 0.5 END::DOUBLE AS theta, len(embedding) AS dim FROM embeddings), g AS (SELECT theta, dim, count(*) AS n_cells FROM c GROUP BY theta, dim), n AS (SELECT count(*) AS n FROM c)
SELECT theta, dim::INT AS dim, n_cells, n - 1 AS background, round(pow(greatest(1 - 0.5 * pow(1 - theta * theta, dim / 2.0), 0), n - 1), 6) AS bound FROM g, n""")
def selectivity_bounds(spark, d):
    """How likely a cell is to stay silent for all others of the bank, by its threshold."""
    theta = F.when(F.col("label") % 3 == 0, 0.22).when(F.col("label") % 3 == 1, 0.30).otherwise(0.5)
    cells = _vectors(spark, d).select(theta.alias("theta"), F.size("embedding").alias("dim"))
    return gates.bank_selectivity(cells)


@query("""SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha1(concat('0:', vec_id)), vec_id) <= 5""")
def stratified_probes(spark, d):
    return corpus.stratified(_vectors(spark, d), "label", "vec_id", 5).select("label", "vec_id")


@query("""SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings) WHERE r % 9 = 0""")
def strided_sample(spark, d):
    return corpus.strided(_vectors(spark, d).select("vec_id"), "vec_id", 9)


@query(f"""WITH {PAIRS}, f AS (SELECT unnest([10, 25, 50, 75, 100]) AS percent) SELECT percent, query_id, round(max(act), 6) AS best FROM f, s WHERE cell_id % 100 < percent GROUP BY ALL""")
def bank_scaling(spark, d):
    """Each query's best cell within growing shares of the bank."""
    return _rounded(N.best_within(*_bank(spark, d), [10, 25, 50, 75, 100]), "best").withColumn("percent", F.col("percent").cast("int"))


@query("""SELECT sum(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS base_cells, sum(CASE WHEN vec_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS overlay_cells, coalesce(max(CASE WHEN vec_id % 2 = 0 THEN vec_id END), -1) AS base_max FROM embeddings""")
def overlay_counts(spark, d):
    even = F.col("vec_id") % 2 == 0
    return _vectors(spark, d).agg(F.count_if(even).alias("base_cells"), F.count_if(~even).alias("overlay_cells"), F.coalesce(F.max(F.when(even, F.col("vec_id"))), F.lit(-1)).alias("base_max"))


@query("""WITH a AS (SELECT greatest(499, coalesce(max(vec_id), 0)) AS x FROM embeddings), n AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, label FROM embeddings WHERE vec_id % 50 = 0) SELECT x + i AS cell_id, label FROM a, n""")
def overlay_add(spark, d):
    """New cells get ids above the base's greatest, in order."""
    e = _vectors(spark, d)
    top = max(499, e.agg(F.coalesce(F.max("vec_id"), F.lit(0))).first()[0])
    none = spark.createDataFrame([], "cell_id long, label int, theta double")
    new = e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("order"))
    return governance.add_cells(none, new, top, top).select("cell_id", "label")
