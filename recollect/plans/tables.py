"""Queries over events, labels and conversations: latencies, rates, limits, risk, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import corpus, evaluation, governance
from recollect.session import table
from recollect.streaming import limits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(value) AS n FROM events GROUP BY event_type""")
def latency_percentiles_linear(spark, d):
    return evaluation.latency_linear(table(spark, d, "events"), "value", "event_type")


@query("""WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, round(v[1 + round_even(0.5 * (n - 1), 0)::INT], 6) AS p50, round(v[1 + round_even(0.95 * (n - 1), 0)::INT], 6) AS p95, n FROM l""")
def latency_percentiles_nearest(spark, d):
    return evaluation.latency_nearest(table(spark, d, "events"), "value", "event_type")


_WILSON = """CASE WHEN n > 0 THEN least(greatest(({p} / n + 1.959963984540054 ^ 2 / (2 * n)) / (1 + 1.959963984540054 ^ 2 / n) {s} 1.959963984540054 * sqrt({p} / n * (1 - {p} / n) / n + 1.959963984540054 ^ 2 / (4 * n * n)) / (1 + 1.959963984540054 ^ 2 / n), 0), 1) ELSE 0 END"""


@query(f"""WITH t AS (SELECT 'quality' AS label, count(quality)::DOUBLE AS n, count(*) FILTER (quality = 1)::DOUBLE AS p FROM labels UNION ALL SELECT 'toxic', count(toxic)::DOUBLE, count(*) FILTER (toxic = 1)::DOUBLE FROM labels)
SELECT label, n::BIGINT AS n, p::BIGINT AS positive, round({_WILSON.format(p="p", s="-")}, 6) AS low, round({_WILSON.format(p="p", s="+")}, 6) AS high, CASE WHEN p = 0 AND n > 0 THEN least(1, 3 / n) END AS upper_three FROM t""")
def wilson_rates(spark, d):
    l = table(spark, d, "labels").select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("v")) for c in ("quality", "toxic")])).alias("x")).select("x.*")
    t = l.groupBy("label").agg(F.count("v").alias("n"), F.count_if(F.col("v") == 1).alias("positive"))
    low, high = evaluation.wilson(F.col("positive"), F.col("n"))
    return t.select("label", "n", "positive", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), evaluation.rule_of_three(F.col("positive"), F.col("n")).alias("upper_three"))


@query("""WITH j AS (SELECT quality, length(text) AS score FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest([0, 50, 100, 500, 1000, 5000, 20000]) AS threshold)
SELECT threshold, count(*) FILTER (score >= threshold) AS answered, round(avg((score >= threshold)::INT), 6) AS coverage, round(coalesce(avg((quality = 0)::INT) FILTER (score >= threshold), 0), 6) AS risk FROM g, j GROUP BY threshold""")
def risk_coverage(spark, d):
    """Answering only where a score (here the text's length) reaches a threshold: how much is answered, and how much of that is wrong."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.char_length("text").alias("score")), "doc_id").select("quality", "score")
    rows = j.select("quality", "score", F.explode(F.array(*map(F.lit, (0, 50, 100, 500, 1000, 5000, 20000)))).alias("threshold"))
    on = F.col("score") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(on).alias("answered"), F.round(F.avg(on.cast("int")), 6).alias("coverage"), F.round(F.coalesce(F.avg(F.when(on, (F.col("quality") == 0).cast("int"))), F.lit(0.0)), 6).alias("risk"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS hits FROM events""")
def rate_limit_sliding(spark, d):
    return limits.hits_in_window(table(spark, d, "events")).select("event_id", "hits")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (
  SELECT user_id, event_id, n, true AS allowed, [t] AS kept FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, len(still) < 3, CASE WHEN len(still) < 3 THEN list_append(still, t) ELSE still END
  FROM (SELECT e.*, list_filter(w.kept, lambda x: x >= e.t - 86400) AS still FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, allowed FROM w""")
def rate_limit_allowed(spark, d):
    return limits.limited(table(spark, d, "events"), 3, 86_400.0).select("event_id", "allowed")


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def conversation_assembly(spark, d):
    return corpus.conversations_joined(table(spark, d, "conversations"))


@query("""SELECT user_id AS cell_id, arg_max(event_type, (ts, event_id)) AS reason FROM events GROUP BY user_id""")
def tombstone_latest(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.col("event_type").alias("reason"), F.struct("ts", "event_id").alias("ts"))
    return governance.current_tombstones(log).select("cell_id", "reason")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def newest_history(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 20").select("user_id", "event_id")


@query("""WITH l AS (SELECT (user_id % 5)::INT AS layer, (avg(value) - 10) / (100 - 10) AS share FROM events GROUP BY ALL)
SELECT arg_max(layer, share) AS top_layer, round(max(share), 6) AS top_share, max(share) >= 0.5 AS dominates FROM l""")
def layer_attribution(spark, d):
    """Values of events as losses with one of five layers switched off, between 100 without memory and 10 with all layers."""
    losses = table(spark, d, "events").groupBy((F.col("user_id") % 5).cast("int").alias("layer")).agg(F.avg("value").alias("suppressed_loss"))
    return evaluation.layer_attribution(losses, without=100.0, full=10.0)


@query("""WITH m AS (SELECT avg(value) FILTER (event_id % 3 = 0) AS n, avg(value) FILTER (event_id % 3 = 1) AS r, avg(value) FILTER (event_id % 3 = 2) AS t FROM events)
SELECT round(n, 6) AS "none", round(r, 6) AS random, round(t, 6) AS "real", r - n >= 0.041 AS ignorance_ok, n - t >= 0.167 AS gap_ok, t <= 60 AS ceiling_ok, r - n >= 0.041 AND n - t >= 0.167 AND t <= 60 AS accepted FROM m""")
def acceptance_gates(spark, d):
    """Values of events as losses of three modes."""
    third = F.col("event_id") % 3
    mode = F.when(third == 0, "none").when(third == 1, "random").otherwise("real")
    return evaluation.acceptance(table(spark, d, "events").select(mode.alias("mode"), F.col("value").alias("loss")), ceiling=60.0)


@query("""SELECT round(avg(value), 6) AS mean_loss, round(stddev_samp(value) / sqrt(count(value)), 6) AS stderr, event_type AS mode FROM events GROUP BY event_type""")
def loss_by_mode(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("mode"))
    return e.agg(F.round(F.avg("value"), 6).alias("mean_loss"), F.round(F.stddev_samp("value") / F.sqrt(F.count("value")), 6).alias("stderr"))
