"""Queries that report on verdicts and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import factcheck
from recollect.operators import reports as P
from recollect.plans.dense import RANKED, _ranked
from recollect.plans.texts import _DETECT
from recollect.plans.texts import _VERDICT as _TURNS
from recollect.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# Pairs of a claim and a candidate: the same, a part of it, another number, another duty, or another matter.
_KINDS = ["exact", "paraphrase", "near_miss", "near_miss", "unrelated"]
_PAIRED = """WITH fp AS (
  SELECT conv_id, turn, t || ' they must approve 12 units' AS query, CASE turn % 5 WHEN 0 THEN t || ' they must approve 12 units' WHEN 1 THEN 'must approve 12 units they' WHEN 2 THEN t || ' they must approve 15 units'
    WHEN 3 THEN t || ' they may approve 12 units' ELSE 'some other matter of ' || reverse(t) END AS candidate, (['exact', 'paraphrase', 'near_miss', 'near_miss', 'unrelated'])[1 + turn % 5] AS kind
  FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations))"""
_VERDICT = _PAIRED + ", de AS" + _TURNS.split(", de AS", 1)[1].replace("SELECT conv_id, turn,", "SELECT conv_id, turn, kind,", 1)


def _pairs(spark, d) -> DataFrame:
    c, t, k = table(spark, d, "conversations"), F.lower("text"), F.col("turn") % 5
    said = lambda x: F.concat(t, F.lit(x))
    candidate = (
        F.when(k == 0, said(" they must approve 12 units")).when(k == 1, "must approve 12 units they").when(k == 2, said(" they must approve 15 units")).when(k == 3, said(" they may approve 12 units")).otherwise(F.concat(F.lit("some other matter of "), F.reverse(t)))
    )
    return c.select("conv_id", "turn", said(" they must approve 12 units").alias("query"), candidate.alias("candidate"), F.element_at(F.array(*map(F.lit, _KINDS)), (k + 1).cast("int")).alias("kind"))


_ANY_FLIP = " OR ".join(f"{k}_flip" for k in _DETECT)
_CASE = f"CASE WHEN {_ANY_FLIP} THEN 'reject' WHEN ok THEN 'accept' ELSE 'ambiguous' END"
_LABEL = "CASE conv_id % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'neutral' ELSE '' END"
_OBSERVED = f"""{_VERDICT}, ob AS (SELECT conv_id, turn, kind, {_CASE} AS verdict, CASE WHEN kind IN ('exact', 'paraphrase') THEN 'accept' ELSE 'reject' END AS expected, {_LABEL} AS nli_label FROM de)"""


def _observed(spark, d) -> DataFrame:
    c = F.col("conv_id") % 4
    label = F.when(c == 0, "entailment").when(c == 1, "contradiction").when(c == 2, "neutral").otherwise("")
    want = F.when(F.col("kind").isin("exact", "paraphrase"), "accept").otherwise("reject")
    return P.observed(factcheck.with_verdict(_pairs(spark, d)).select("conv_id", "turn", "kind", "verdict", want.alias("expected"), label.alias("nli_label")))


@query(f"""{_OBSERVED}
SELECT conv_id, turn, verdict, verdict = 'accept' AS answered, verdict = 'accept' AND expected = 'reject' AS false_accept, verdict <> 'accept' AND expected = 'accept' AS over_refusal, NOT (verdict = 'accept' AND expected = 'reject') AS safe,
  CASE WHEN nli_label = '' THEN 'not_provided' WHEN (verdict, nli_label) IN (('accept', 'entailment'), ('reject', 'contradiction'), ('ambiguous', 'neutral')) THEN 'agreement'
    WHEN verdict = 'accept' AND nli_label = 'contradiction' THEN 'inspect_urgently' WHEN verdict = 'reject' AND nli_label = 'entailment' THEN 'possible_over_refusal' ELSE 'review' END AS nli_agreement FROM ob""")
def audit_observations(spark, d):
    return _observed(spark, d).select("conv_id", "turn", "verdict", "answered", "false_accept", "over_refusal", "safe", "nli_agreement")


_Z = "1.959963984540054"
_BOUND = "CASE WHEN n > 0 THEN least(greatest((p / n + {z} ^ 2 / (2 * n)) / (1 + {z} ^ 2 / n) {s} {z} * sqrt(p / n * (1 - p / n) / n + {z} ^ 2 / (4 * n * n)) / (1 + {z} ^ 2 / n), 0), 1) ELSE 0 END"


@query(f"""{_OBSERVED}, me AS (
  SELECT 'coverage' AS metric, count(*) FILTER (verdict = 'accept')::DOUBLE AS p, count(*)::DOUBLE AS n FROM ob
  UNION ALL SELECT 'false_accept_rate', count(*) FILTER (verdict = 'accept' AND expected = 'reject'), count(*) FILTER (expected = 'reject') FROM ob
  UNION ALL SELECT 'over_refusal_rate', count(*) FILTER (verdict <> 'accept' AND expected = 'accept'), count(*) FILTER (expected = 'accept') FROM ob
  UNION ALL SELECT 'accuracy_among_answered', count(*) FILTER (verdict = 'accept' AND expected = 'accept'), count(*) FILTER (verdict = 'accept') FROM ob)
SELECT metric, p::BIGINT AS positive, n::BIGINT AS n, CASE WHEN n > 0 THEN round(p / n, 6) END AS rate, round({_BOUND.format(z=_Z, s="-")}, 6)::DOUBLE AS low, round({_BOUND.format(z=_Z, s="+")}, 6)::DOUBLE AS high FROM me""")
def audit_metrics(spark, d):
    return P.audit_metrics(_observed(spark, d))


@query(f"""{_OBSERVED}
SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg((verdict = 'reject')::INT), 6) AS reject_rate, round(avg((verdict = 'accept')::INT), 6) AS accept_rate, round(avg((verdict = 'ambiguous')::INT), 6) AS ambiguous_rate FROM ob GROUP BY ROLLUP (kind)""")
def flip_type_rates(spark, d):
    return P.verdict_rates(_observed(spark, d), "kind")


@query(f"""{_VERDICT}, sy AS (
  SELECT 'all' AS system, conv_id, turn, kind, {_CASE} AS primary_verdict FROM de
  UNION ALL SELECT 'no_modal', conv_id, turn, kind, CASE WHEN {" OR ".join(f"{k}_flip" for k in _DETECT if k != "modal")} THEN 'reject' WHEN ok THEN 'accept' ELSE 'ambiguous' END FROM de),
k AS (SELECT *, primary_verdict = 'accept' AS said, turn % 3 > 0 AS recalled FROM sy)
SELECT system, round(avg(recalled::INT) FILTER (kind IN ('exact', 'paraphrase')), 6) AS candidate_recall, round(avg(said::INT), 6) AS accept_rate, round(avg(said::INT) FILTER (kind = 'paraphrase'), 6) AS paraphrase_accept_rate,
  round(avg((primary_verdict = 'reject')::INT) FILTER (kind = 'near_miss'), 6) AS near_miss_reject_rate, round(avg((primary_verdict = 'reject')::INT) FILTER (kind = 'unrelated'), 6) AS unrelated_reject_rate,
  round(avg((primary_verdict = 'ambiguous')::INT), 6) AS ambiguous_rate, round(avg(said::INT) FILTER (kind IN ('near_miss', 'unrelated')), 6) AS false_accept_rate,
  round(avg((primary_verdict = 'reject')::INT) FILTER (kind = 'exact'), 6) AS false_reject_rate, round(avg((said AND kind IN ('near_miss', 'unrelated'))::INT), 6) AS unsupported_rate FROM k GROUP BY system""")
def confusion_by_system(spark, d):
    """The fact check with all detectors and without that of duties, on pairs of four kinds."""
    pairs = _pairs(spark, d)
    judged = lambda name, without: factcheck.with_verdict(pairs, without=without).select(F.lit(name).alias("system"), "turn", "kind", F.col("verdict").alias("primary"))
    rows = judged("all", None).unionByName(judged("no_modal", "modal"))
    said = (F.col("primary") == "accept").cast("int")
    return P.confusion(rows.select("system", "kind", "primary", said.alias("accepted"), (F.col("turn") % 3 > 0).alias("recalled"), F.col("kind").isin("exact", "paraphrase").alias("faithful")))


@query(f"""{_VERDICT}, v AS (SELECT {_CASE} AS after, CASE WHEN {" OR ".join(f"{k}_flip" for k in _DETECT if k != "number")} THEN 'reject' WHEN ok THEN 'accept' ELSE 'ambiguous' END AS before FROM de)
SELECT before, after, count(*) AS n FROM v GROUP BY before, after""")
def detector_regression(spark, d):
    """What changes when the detector of numbers is switched on."""
    pairs = _pairs(spark, d)
    return P.regression(factcheck.with_verdict(pairs, without="number"), factcheck.with_verdict(pairs), ["conv_id", "turn"], "verdict")


# Right cells: the best 20 of each query, a cell being right if its text holds one of two words that follow from the query's id.
_WORDS = "['the', 'und'], ['que', 'der'], ['et', 'ing']"
_RIGHT = f"""{RANKED.format(n=20)}, kw AS (
  SELECT query_id, rank, act, lower(coalesce(text, '')) AS t, ([{_WORDS}])[1 + query_id // 100 % 3] AS words, coalesce(length(text), 0) AS size, cell_id FROM r LEFT JOIN documents ON doc_id = cell_id),
hd AS (SELECT *, contains(t, words[1]) OR contains(t, words[2]) AS holds, row_number() OVER (PARTITION BY query_id ORDER BY size DESC, cell_id) AS rank2 FROM kw)"""


def _right(spark, d) -> DataFrame:
    """Per query the cells by rank (act, size, cell_id, text) and its words."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), "text")
    cells = _ranked(spark, d, 20).join(texts, "cell_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "act", "cell_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"), "text"))).alias("cells"))
    words = F.array(*[F.array(*map(F.lit, w)) for w in (("the", "und"), ("que", "der"), ("et", "ing"))])
    return cells.withColumn("words", F.element_at(words, (F.floor(F.col("query_id") / 100) % 3 + 1).cast("int")))


@query(f"""WITH {_RIGHT}, p AS (SELECT query_id, min(rank) FILTER (holds) AS before, min(rank2) FILTER (holds) AS after FROM hd GROUP BY query_id)
SELECT query_id, before::INT AS before, after::INT AS after, CASE WHEN before IS NULL THEN 'cant_help' WHEN before <= 3 AND after <= 3 THEN 'indifferent' WHEN before > 3 AND after <= 3 THEN 'helps' ELSE 'neutral' END AS status FROM p""")
def rerank_help(spark, d):
    """The rank of the first right cell by activation and by another score (here the text's length)."""
    by_size = F.array_sort(F.transform("cells", lambda c: F.struct((-c["size"]).alias("s"), c["cell_id"].alias("i"), c["text"].alias("text"))))
    ranks = _right(spark, d).select("query_id", P.keyword_rank(F.transform("cells", lambda c: c["text"]), F.col("words")).alias("before"), P.keyword_rank(F.transform(by_size, lambda c: c["text"]), F.col("words")).alias("after"))
    return ranks.select("query_id", "before", "after", P.rerank_status(F.col("before"), F.col("after")).alias("status"))


@query(f"""WITH {_RIGHT}, g AS (SELECT w AS "window", f AS "floor" FROM (SELECT unnest([1, 3, 5, 10]) AS w), (SELECT unnest([0.2, 0.3, 0.4, 0.5]) AS f)),
e AS (SELECT g."window", g."floor", query_id, bool_or(holds AND rank <= g."window" AND act >= g."floor") AS ok FROM g, hd GROUP BY ALL)
SELECT "window"::INT AS "window", "floor"::DOUBLE AS "floor", count(*) AS n, count(*) FILTER (ok) AS eligible FROM e GROUP BY ALL""")
def rescue_grid(spark, d):
    holds = lambda c: F.exists("words", lambda k: F.contains(F.lower(F.coalesce(c["text"], F.lit(""))), k))
    rows = _right(spark, d).select(F.transform("cells", lambda c: F.struct(c["act"].alias("act"), holds(c).alias("supports"))).alias("cells"))
    return P.grid(rows, [1, 3, 5, 10], [0.2, 0.3, 0.4, 0.5])


@query(f"""WITH {_RIGHT}, p AS (SELECT query_id, max(act) FILTER (rank = 1) - max(act) FILTER (rank = 2) AS margin, min(rank) FILTER (holds) AS pool, min(rank) FILTER (holds AND rank <= 5) AS top, bool_or(holds AND rank <= 3 AND act >= 0.3) AS eligible FROM hd GROUP BY query_id),
qq AS (SELECT *, query_id % 300 = 0 AS ok, query_id % 500 = 0 AS same, query_id % 400 = 0 AS hit, query_id % 200 = 0 AS grounded, margin >= 0.55 AS fires FROM p)
SELECT query_id, CASE WHEN ok THEN 'OK' WHEN same THEN 'DECOMPOSER' WHEN pool IS NULL THEN 'RETRIEVAL' WHEN top <= 5 AND NOT fires THEN 'GATE' WHEN coalesce(top, 99) > 5 THEN 'RETRIEVAL' WHEN NOT hit THEN 'GENERATOR' WHEN NOT grounded THEN 'VERIFIER' ELSE 'UNCLASSIFIED' END AS failure,
  CASE WHEN fires THEN CASE WHEN grounded THEN 'grounded' ELSE 'silence_drift' END WHEN eligible AND grounded THEN 'rescued' WHEN eligible THEN 'silence_drift' ELSE 'silence_gate' END AS decision FROM qq""")
def failure_stages(spark, d):
    """The stage at which each question fails, and what a rescue would make of it; whether the text generator hit and was grounded follows from the id."""
    texts = F.transform("cells", lambda c: c["text"])
    a = lambda i: F.get("cells", F.lit(i))["act"]
    holds = lambda c: F.exists("words", lambda k: F.contains(F.lower(F.coalesce(c["text"], F.lit(""))), k))
    i = F.col("query_id")
    r = _right(spark, d).select(
        "query_id",
        (a(0) - a(1)).alias("margin"),
        P.keyword_rank(texts, F.col("words")).alias("pool"),
        P.keyword_rank(F.slice(texts, 1, 5), F.col("words")).alias("top"),
        F.exists(F.slice("cells", 1, 3), lambda c: holds(c) & (c["act"] >= 0.3)).alias("eligible"),
    )
    grounded, fires = i % 200 == 0, F.col("margin") >= 0.55
    asked = F.when(i % 500 == 0, "q").otherwise("another q")
    stage = P.failure(i % 300 == 0, F.lit("Q "), asked, F.col("pool"), F.col("top"), 5, fires, i % 400 == 0, grounded)
    outcome = F.when(grounded, "grounded").otherwise("silence_drift")
    return r.select("query_id", stage.alias("failure"), P.effective_decision(F.col("margin"), outcome, F.col("eligible"), 0.55).alias("decision"))


@query(f"""WITH {RANKED.format(n=10)}, p AS (SELECT query_id, max(act) FILTER (rank = 1) AS a, max(act) FILTER (rank = 2) AS b, avg(act) FILTER (rank > 1) AS m, stddev_pop(act) FILTER (rank > 1) AS sd, sum(act) AS s FROM r GROUP BY query_id),
v AS (SELECT 'top1' AS signal, a AS v FROM p UNION ALL SELECT 'margin', a - b FROM p UNION ALL SELECT 'margin_rest', a - m FROM p UNION ALL SELECT 'deviations', (a - m) / nullif(sd, 0) FROM p UNION ALL SELECT 'share', a / nullif(s, 0) FROM p),
t AS (SELECT unnest([0.1, 0.25, 0.5, 0.65, 1.0, 10.0, 30.0]) AS threshold)
SELECT signal, threshold::DOUBLE AS threshold, count(*) FILTER (v >= threshold) AS fires FROM v, t GROUP BY ALL""")
def gate_signals(spark, d):
    return P.gate_signals(_ranked(spark, d, 10), [0.1, 0.25, 0.5, 0.65, 1.0, 10.0, 30.0])


@query("""WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'grounded_via_rescue' WHEN 'view' THEN 'grounded_normal' ELSE 'silence_gate' END AS decision, event_id % 3 = 0 AS kw_hit FROM events),
f AS (SELECT *, decision = 'grounded_via_rescue' AS rescued, decision IN ('grounded_via_rescue', 'grounded_normal') AS grounded FROM e)
SELECT count(*) AS n, count(*) FILTER (grounded) AS grounded, count(*) FILTER (grounded AND kw_hit) AS grounded_kw_hit, count(*) FILTER (grounded AND NOT kw_hit) AS grounded_kw_miss, count(*) FILTER (rescued AND kw_hit) AS rescued_kw_hit, count(*) FILTER (rescued AND NOT kw_hit) AS rescued_kw_miss FROM f""")
def multihop_counts(spark, d):
    t = F.col("event_type")
    label = F.when(t == "click", "grounded_via_rescue").when(t == "view", "grounded_normal").otherwise("silence_gate")
    return P.multihop_counts(table(spark, d, "events").select(label.alias("decision"), (F.col("event_id") % 3 == 0).alias("kw_hit")))


@query("""WITH c AS (SELECT CASE WHEN n_chars % 100 / 100.0 >= 0.5 THEN 'low' ELSE 'high' END AS kind, doc_id % 4 <> 0 AND source IS NOT NULL AS got, source AS top1 FROM documents),
f AS (SELECT kind, top1, count(*) AS c FROM c WHERE got GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY c DESC, top1) AS r FROM f QUALIFY r <= 3), s AS (SELECT kind, string_agg(top1 || ':' || c, ',' ORDER BY r) AS top3 FROM r GROUP BY kind)
SELECT c.kind, count(*) AS total, count(*) FILTER (got) AS retrieved, coalesce(any_value(top3), '') AS top3 FROM c LEFT JOIN s ON c.kind = s.kind GROUP BY c.kind""")
def chunk_tallies(spark, d):
    """Documents as chunks: the share of empty tokens follows from their length, the first cell is their source."""
    docs = table(spark, d, "documents")
    return P.chunk_tallies(docs.select((F.col("n_chars") % 100 / 100.0).alias("low_share"), (F.col("doc_id") % 4 == 0).alias("skipped"), F.col("source").alias("top1")), 0.5)


@query(f"""WITH {RANKED.format(n=20)}, f AS (SELECT cell_id, arg_min(act, query_id) AS act FROM r WHERE act >= 0.25 GROUP BY cell_id) SELECT cell_id, round(act, 6) AS act FROM f ORDER BY round(act, 9) DESC, cell_id LIMIT 30""")
def probed_cells(spark, d):
    """What several probes find together, the first one that finds a cell counting."""
    found = _ranked(spark, d, 20).select(F.col("query_id").alias("probe"), "cell_id", "act")
    return P.probed_cells(found, 0.25, 30).select("cell_id", F.round("act", 6).alias("act"))


@query("""WITH r AS (SELECT (event_id % 6)::INT AS position, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS ratio FROM events), p AS (SELECT position, count(ratio) FILTER (NOT isnan(ratio)) AS n, avg(ratio) FILTER (NOT isnan(ratio)) AS mean, stddev_samp(ratio) FILTER (NOT isnan(ratio)) AS deviation FROM r GROUP BY position)
SELECT position, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM p""")
def ratios_by_position(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 6).cast("int").alias("position"), F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")).alias("ratio"))
    return P.ratios_by_position(rows).select("position", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("""WITH r AS (SELECT event_type AS config, CASE user_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'write' ELSE 'delete' END AS expected, CASE WHEN event_id % 5 = 0 THEN 'query' ELSE CASE user_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'write' ELSE 'delete' END END AS routed, event_id % 2 = 0 AS recalls, value > 20 AS used, event_id % 7 > 0 AS cited FROM events)
SELECT config, round(avg((routed = expected)::INT), 6) AS routing_accuracy, round(avg(used::INT) FILTER (expected = 'query' AND recalls), 6) AS recall, round(avg((NOT used)::INT) FILTER (expected = 'query' AND NOT recalls), 6) AS refusal_accuracy,
  count(*) FILTER (expected = 'query' AND NOT recalls AND used) AS unsupported, round(avg(cited::INT) FILTER (expected = 'query' AND recalls AND used), 6) AS attribution FROM r GROUP BY config""")
def routing_report(spark, d):
    u = F.col("user_id") % 3
    want = F.when(u == 0, "query").when(u == 1, "write").otherwise("delete")
    e, i = table(spark, d, "events"), F.col("event_id")
    rows = e.select(F.col("event_type").alias("config"), want.alias("expected"), F.when(i % 5 == 0, "query").otherwise(want).alias("routed"), (i % 2 == 0).alias("recalls"), (F.col("value") > 20).alias("used"), (i % 7 > 0).alias("cited_right"))
    return P.routing_report(rows, "config")


@query("""SELECT count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS short_circuits, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 <> 1) AS valid, count(*) FILTER (event_id % 4 <> 0 AND event_id % 3 = 1) AS malformed FROM events""")
def judge_counts(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, 'so: {"verdict": "Accept"}').when(i % 3 == 1, "I can not say").otherwise('{"verdict": "ambiguous"} .')
    return P.judge_counts(table(spark, d, "events").select(F.when(i % 4 == 0, "reject").otherwise("accept").alias("deterministic"), raw.alias("raw")))
