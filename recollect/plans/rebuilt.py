"""Queries over rebuilt banks, load tests, controllers under stress and candidates ranked anew by their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import evaluation, rebuild
from recollect.operators import intents as I
from recollect.operators import reports as P
from recollect.operators import retrieval as R
from recollect.operators.corpus import global_offsets
from recollect.plans import changes, dense
from recollect.plans.sql import content
from recollect.session import stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


_KEPT = """si AS (SELECT vec_id, label, CASE label % 3 WHEN 0 THEN 0.22 WHEN 1 THEN 0.30 ELSE 0.5 END::DOUBLE AS theta, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings JOIN documents ON vec_id = doc_id WHERE text <> '' AND vec_id % 7 <> 3),
rf AS (SELECT vec_id FROM si WHERE place % greatest(1, n // 300) = 0 AND place < 300 * greatest(1, n // 300))"""
# Eighteen steps: the root is then right to 1e-13. Further ones add up errors of rounding, which after forty are 1e-7 and turn last digits.
_ROOT = dense._ROOT.replace("n < 40", "n < 18").replace("n = 40", "n = 18")
_IN = "vec_id IN (SELECT vec_id FROM rf)"


@query(f"""WITH RECURSIVE {_KEPT}, {dense._MOMENTS_OF.format(chosen=_IN)}, mx AS (SELECT cov AS a, trace AS scale FROM co), {_ROOT}, lo AS (SELECT 1.5 * max(sqrt(list_inner_product(w, w))) AS longest FROM wh WHERE {_IN}),
nu AS (SELECT vec_id, row_number() OVER (ORDER BY first, vec_id) AS cell_id FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY theta) AS first FROM si))
SELECT cell_id, vec_id AS source_id, label, theta, list_transform(w, lambda v: round(v / (longest + 1e-8), 4) + 0.0) AS weight FROM si JOIN nu USING (vec_id) JOIN wh USING (vec_id), lo""")
def rebuilt_bank(spark, d):
    """Vectors as single cells with the documents of their ids as texts; one id in seven is a bound cell, and stays out. Stores tables while it is defined."""
    theta = F.when(F.col("label") % 3 == 0, 0.22).when(F.col("label") % 3 == 1, 0.30).otherwise(0.5)
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), "label", theta.alias("theta"), F.when(F.col("vec_id") % 7 == 3, "bound").otherwise("single").alias("kind"), F.col("embedding").alias("vector"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), "text")
    out = rebuild.rebuilt(cells.join(texts, "cell_id"), most=300, least=100)
    return out.withColumn("weight", F.transform("weight", lambda v: F.round(v, 4) + 0.0))


@query("""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS a, value, epoch_us(ts) + round(value * 1e6)::BIGINT AS b, event_type AS status FROM events),
st AS (SELECT day, string_agg(status || ':' || c, ',' ORDER BY status) AS statuses FROM (SELECT day, status, count(*) AS c FROM r GROUP BY ALL) GROUP BY day),
g AS (SELECT day, count(*) AS requests, (max(b) - min(a)) / 1e6 AS wall, count(*) FILTER (status = 'error') AS errors, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS slowest FROM r GROUP BY day)
SELECT day, requests, round(wall, 3) AS wall_seconds, round(CASE WHEN wall > 0 THEN requests / wall ELSE 0 END, 6) AS rps, errors, round(errors / requests, 6) AS error_rate, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, slowest, statuses FROM g JOIN st USING (day)""")
def load_report(spark, d):
    """Events as requests by day: their type is the status, their value the seconds that they took."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").cast("timestamp").alias("started"), F.col("value").alias("latency"), F.col("event_type").alias("status"))
    return rebuild.load_report(e, "day", F.col("status") != "error", evaluation.latency_linear(e, "latency", "day"))


_EXPECTED = "CASE (seq // 1000 + seq % 1000) % 8 WHEN 1 THEN 'write' WHEN 2 THEN 'query' WHEN 4 THEN 'query' WHEN 5 THEN 'write' ELSE 'delete' END"


@query(f"""WITH t AS (SELECT 'keywords' AS config, seq, intent, to_write FROM ({changes.ORACLES["keyword_intents"]}) UNION ALL SELECT 'patterns', seq, intent, to_write FROM ({changes.ORACLES["pattern_intents"]})),
v AS (SELECT *, {_EXPECTED} AS expected, (seq // 1000) % 5 <> 0 AS first, (seq // 1000) % 10 <> 0 AS second, regexp_matches(trim(coalesce(to_write, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(?i)^(remember|note|store|save|memorize|memorise|record|log)') AS verb, trim(coalesce(to_write, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank FROM t)
SELECT config, count(*) AS turns, round(avg(first::INT), 6) AS json_validity, count(*) FILTER (NOT first AND second) AS recovered, round(avg((NOT first AND NOT second)::INT), 6) AS malformed_rate, round(avg(((first OR second) AND intent = expected)::INT), 6) AS routing_accuracy,
round(avg((NOT blank AND NOT verb)::INT) FILTER (intent = 'write' AND (first OR second)), 6) AS write_quality FROM v GROUP BY config""")
def controller_stress(spark, d):
    """Two controllers over instructions made of whole conversations, of which the form tells the right intent. One conversation in five cuts the first JSON short, one in ten the second one too. No instruction asks to bind, so the precision of bindings is left out."""
    conv = F.floor(F.col("seq") / 1000)
    form = (conv + F.col("seq") % 1000) % 8
    expected = F.when(form.isin(1, 5), "write").when(form.isin(2, 4), "query").otherwise("delete")
    none = F.array().cast("array<string>")
    said = changes._instructions(spark, d)
    made = []
    for name, route in (("keywords", I.by_keywords), ("patterns", I.by_patterns)):
        r = said.select("seq", route(F.col("text")).alias("i")).select("seq", "i.intent", "i.confidence", "i.to_write")
        whole = F.to_json(F.struct(F.col("intent").alias("action"), "confidence", F.lit("by form").alias("reason")))
        cut = lambda every: F.when(conv % every == 0, F.substring(whole, 1, 15)).otherwise(whole)  # noqa: B023, E731
        made.append(r.select(F.lit(name).alias("config"), expected.alias("expected"), F.col("intent").alias("routed"), cut(5).alias("answer"), cut(10).alias("retry"), "to_write", none.alias("proposed"), none.alias("known")))
    return P.controller_report(made[0].unionByName(made[1]), "config").drop("bind_precision")


@query(f"""WITH {dense.RANKED.format(n=10)}, p AS (SELECT query_id, cell_id, act, round(act, 9) AS a FROM r WHERE cell_id <> query_id),
x AS (SELECT 'top' AS "end", row_number() OVER (ORDER BY a DESC, query_id, cell_id) AS place, query_id, cell_id, act FROM p UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY a, query_id, cell_id), query_id, cell_id, act FROM p)
SELECT "end", place::INT AS place, query_id, cell_id, round(act, 6) AS act FROM x WHERE place <= 25""")
def extreme_confusions(spark, d):
    """The 25 most and the 25 least alike among each query's ten best other cells."""
    r = stored(dense._ranked(spark, d, 10).where("cell_id <> query_id").select("query_id", "cell_id", "act"), "pairs")
    return P.extreme_pairs(r, 25).withColumn("act", F.round("act", 6))


def _words(c: str) -> str:
    return f"list_distinct({content(c)})"


@query(f"""WITH {dense.RANKED.format(n=20)}, b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS m, {_words("text")} AS asked FROM benchmark), t AS (SELECT doc_id AS cell_id, CASE WHEN doc_id % 9 <> 4 THEN text END AS text FROM documents),
z AS (SELECT query_id, r.cell_id, rank, coalesce(text, '') = '' AS gone, len(list_filter({_words("text")}, lambda w: list_contains(asked, w))) / nullif(len(asked), 0) AS share FROM r JOIN b ON i = query_id % m LEFT JOIN t ON t.cell_id = r.cell_id),
n AS (SELECT *, CASE WHEN gone THEN '-inf'::DOUBLE ELSE coalesce(share, '-inf'::DOUBLE) END AS score FROM z)
SELECT query_id, cell_id, rank::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cell_id)::INT AS new_rank, CASE WHEN score > '-inf'::DOUBLE THEN round(score, 6) END AS score FROM n QUALIFY new_rank <= 8""")
def rerank_by_words(spark, d):
    """Each query's best 20 cells in the order of the share of a benchmark item's words that their documents hold; the item is that at the place query_id mod their number. One document in nine counts as missing, and comes last."""
    items = table(spark, d, "benchmark")
    m = items.count()
    placed = global_offsets(items.select("item_id", F.array_distinct(X.content_tokens(F.col("text"))).alias("asked"), F.lit(1).cast("long").alias("_one")), "item_id", "_one")
    found = stored(dense._ranked(spark, d, 20), "pool")
    docs = table(spark, d, "documents").where("doc_id % 9 <> 4").select(F.col("doc_id").alias("cell_id"), "text")
    pool = found.select("query_id", "cell_id", (F.col("query_id") % max(m, 1)).alias("start")).join(placed.select("start", "asked"), "start")
    # only the words of documents that are in a pool are taken
    words = docs.join(found.select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", F.array_distinct(X.content_tokens(F.col("text"))).alias("has"))
    share = F.size(F.array_intersect("asked", "has")) / F.nullif(F.size("asked"), F.lit(0))
    scores = pool.join(words, "cell_id", "left").select("query_id", "cell_id", share.alias("score"))
    out = R.reranked_texts(found, scores, docs, 8)
    return out.select("query_id", "cell_id", "rank", "new_rank", F.when(F.col("score") > float("-inf"), F.round("score", 6)).alias("score"))
