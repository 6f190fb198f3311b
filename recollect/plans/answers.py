"""Queries over answers: the assistant's turns are checked against the conversation's user turns as cells; the question is the turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import answercheck as A
from recollect.operators import answerflow, intents, reports, splits
from recollect.operators import retrieval as R
from recollect.plans.dense import RANKED
from recollect.plans.sql import content, numerics, tokens, word_list
from recollect.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _answers(spark, d) -> DataFrame:
    """conv_id, turn, question, answer, cells and the forms of the cells' texts, made once for each conversation."""
    c = table(spark, d, "conversations")
    cells = c.where("turn % 2 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("cell_id"), "text"))).alias("cells"))
    cells = cells.select("conv_id", "cells", A.cell_forms(F.col("cells")).alias("forms"))
    q = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    asked = c.where("turn % 2 = 1").withColumnRenamed("text", "answer").join(q, ["conv_id", "turn"])
    return asked.join(cells, "conv_id").select("conv_id", "turn", "question", "answer", "cells", "forms")


_ANSWERS = """ce AS (
  SELECT conv_id, list({'cell_id': turn, 'text': text} ORDER BY turn) AS cells, lower(string_agg(text, ' ' ORDER BY turn)) AS blob
  FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id),
an AS (
  SELECT a.conv_id, a.turn, b.text AS question, a.text AS answer, cells, blob
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 JOIN ce ON ce.conv_id = a.conv_id
  WHERE a.turn % 2 = 1)"""


def _form(c: str) -> str:
    """The anchor form of a text in SQL."""
    bare = f"lower(regexp_replace({c}, '(?i)[''’]s\\b', '', 'g'))"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _runs(c: str) -> str:
    """Runs of capitalised words in SQL, repeated ones too. Letters beyond ASCII end no word, so they become underscores first."""
    titles = "|".join(h for h in X.HONORIFICS if "." not in h)
    plain = word_list(sorted({*X.NO_NAMES, *X.STOP_WORDS, *X.MONTHS, *X.SHORT_MONTHS}))
    pattern = X.NAME_RUN.replace("'", "''")
    norm = f"trim(regexp_replace({_form('s')}, '^(?:(?:{titles})(?: |$))+', ''))"
    found = f"list_transform(regexp_extract_all(regexp_replace(coalesce({c}, ''), '[À-ÖØ-öø-ɏ]', '_', 'g'), '{pattern}'), lambda s: {{'span': s, 'norm': {norm}}})"
    return f"list_filter({found}, lambda r: length(r.norm) >= 3 AND len(list_filter(string_split(r.norm, ' '), lambda p: NOT list_contains({plain}, p))) > 0)"


def _first_of_each(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: y.norm), x.norm) = i)"


def _named(source: str, answer: str = "answer") -> str:
    """CTEs that end in `nm`: names, anchors (marks), forms of the cells and names of the answer that the question lacks (novel)."""
    return f"""r0 AS (SELECT *, {_runs("question")} AS q0, {_runs(answer)} AS a0 FROM {source}),
r1 AS (
  SELECT *, {_first_of_each("q0")} AS qr, {_first_of_each("a0")} AS ar, {_form("coalesce(question, '')")} AS qn,
    list_transform(cells, lambda c: {_form("coalesce(c.text, '')")}) AS forms, list_distinct(list_filter({content("question")}, lambda t: length(t) >= 3)) AS words
  FROM r0),
r2 AS (SELECT *, list_transform(qr, lambda r: r.norm) AS norms, list_filter(ar, lambda r: r.norm <> '' AND NOT contains(qn, r.norm)) AS novel FROM r1),
nm AS (
  SELECT *, CASE WHEN len(list_filter(norms, lambda n: contains(n, ' '))) > 0 THEN list_filter(norms, lambda n: contains(n, ' '))
    WHEN len(norms) > 0 THEN norms ELSE words END AS marks FROM r2)"""


_UNANCHORED = """CASE WHEN len(marks) > 0 THEN list_transform(list_filter(novel,
    lambda r: len(list_filter(forms, lambda f: contains(f, r.norm) AND len(list_filter(marks, lambda a: contains(f, a))) > 0)) = 0), lambda r: r.span) ELSE [] END"""
_COHERENT = """(len({t}) > 0 AND len(list_filter({t}, lambda z: regexp_matches(z, '^[a-z]{{3,}}$') AND regexp_matches(z, '[aeiouy]'))) > 0
    AND (len({t}) < 3 OR list_max(list_transform(list_distinct({t}), lambda z: len(list_filter({t}, lambda y: y = z)))) * 2 <= len({t})))"""
_OVERLAP = f"(len(list_distinct({content('question')})) < 2 OR len(list_filter({content('question')}, lambda z: contains(blob, z))) > 0)"
_UNCITED = f"list_filter({numerics('{a}')}, lambda z: NOT list_contains({numerics('question')}, z) AND NOT contains(blob, lower(z)))"
_ASKED = f"list_filter({content('{a}')}, lambda z: NOT list_contains({content('question')}, z))"


@query(f"""WITH {_ANSWERS}, t AS (SELECT conv_id, turn, {_ASKED.format(a="answer")} AS t, {tokens("blob")} AS b FROM an)
SELECT conv_id, turn, len(t)::INT AS total, len(list_filter(t, lambda z: list_contains(b, z)))::INT AS covered FROM t""")
def token_coverage(spark, d):
    covered, total = A.coverage(F.col("answer"), F.col("question"), A.cell_blob(F.col("cells")))
    return _answers(spark, d).select("conv_id", "turn", total.alias("total"), covered.alias("covered"))


@query(f"""WITH {_ANSWERS} SELECT conv_id, turn, len({_UNCITED.format(a="answer")})::INT AS n_uncited FROM an""")
def uncited_numerics(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.size(A.uncited_numbers(F.col("answer"), F.col("question"), A.cell_blob(F.col("cells")))).alias("n_uncited"))


@query(f"""WITH t AS (SELECT item_id, {tokens("text")} AS t FROM benchmark) SELECT item_id, {_COHERENT.format(t="t")} AS ok FROM t""")
def query_coherence(spark, d):
    return table(spark, d, "benchmark").select("item_id", A.coherent(F.col("text")).alias("ok"))


@query(f"""WITH {_ANSWERS} SELECT conv_id, turn, {_OVERLAP} AS ok FROM an""")
def evidence_overlap(spark, d):
    return _answers(spark, d).select("conv_id", "turn", A.overlapping(F.col("question"), A.cell_blob(F.col("cells"))).alias("ok"))


@query(f"""WITH {_ANSWERS}, {_named("an")} SELECT conv_id, turn, len(marks)::INT AS n_anchors, array_to_string({_UNANCHORED}, '|') AS unanchored FROM nm""")
def anchor_colocation(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.size(A.anchors(F.col("question"))).alias("n_anchors"), F.array_join(A.unanchored(F.col("answer"), F.col("question"), F.col("forms")), "|").alias("unanchored"))


_CLEAN = """ac AS (
  SELECT *, regexp_replace(regexp_replace(answer, '\\[[0-9]+\\]', ' ', 'g'), '\\b(?:' || array_to_string(list_transform(cells, lambda c: c.cell_id::VARCHAR), '|') || ')\\b', ' ', 'g') AS bare FROM an)"""
#: Verdicts of answers, in `ve`: covered, total, n_uncited, n_unanchored, coherent, overlap.
_CHECKED = f"""{_CLEAN}, {_named("ac", "bare")},
v0 AS (
  SELECT *, {_ASKED.format(a="bare")} AS said, {tokens("blob")} AS held, len({_UNCITED.format(a="bare")}) AS n_uncited, len({_UNANCHORED}) AS n_unanchored, {tokens("question")} AS qt, {_OVERLAP} AS overlap FROM nm),
v1 AS (SELECT *, len(said) AS total, len(list_filter(said, lambda z: list_contains(held, z))) AS covered, {_COHERENT.format(t="qt")} AS coherent FROM v0),
ve AS (
  SELECT *, CASE WHEN NOT coherent THEN 'incoherent question' WHEN NOT overlap THEN 'no overlap of question and cells'
    WHEN total = 0 AND n_uncited = 0 THEN 'nothing to verify' WHEN total = 0 THEN 'uncited number'
    WHEN covered / total >= 0.5 AND n_uncited = 0 AND n_unanchored = 0 THEN 'covered'
    WHEN covered / total < 0.5 AND n_uncited > 0 THEN 'low coverage and uncited number' WHEN covered / total < 0.5 THEN 'low coverage'
    WHEN n_uncited > 0 THEN 'uncited number' ELSE 'unanchored name' END AS reason FROM v1)"""


@query(f"""WITH {_ANSWERS}, {_CHECKED}
SELECT conv_id, turn, covered::INT AS covered, total::INT AS total, n_uncited::INT AS n_uncited, n_unanchored::INT AS n_unanchored, reason IN ('covered', 'nothing to verify') AS grounded, reason FROM ve""")
def answer_verification(spark, d):
    return A.verified(_answers(spark, d)).select("conv_id", "turn", "covered", "total", F.size("uncited").alias("n_uncited"), F.size("unanchored").alias("n_unanchored"), "grounded", "reason")


def _claims(source: str, id_sql: str, column: str) -> str:
    """CTEs that end in `cl`: id, claim_index, start, end, claim. RE2 has no look-behind: a sentence's last mark is matched and put back."""
    refused = " AND ".join(f"NOT contains(lower(bare), '{r}')" for r in A.REFUSALS)
    edges = "'" + A.CLAIM_EDGES.replace("\t\r\n", "") + "' || chr(9) || chr(10) || chr(13)"
    return f"""m AS (
  SELECT {id_sql} AS id, string_split(regexp_replace(coalesce({column}, ''), '([.!?;])(\\s+)|({A.CLAUSE_END})', '\\1' || chr(1) || '\\2\\3' || chr(1), 'g'), chr(1)) AS parts FROM {source}),
f AS (SELECT id, parts, unnest(range(1, len(parts) + 1, 2)) AS i FROM m),
g AS (SELECT id, i, parts[i] AS part, coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))), 0)::INT AS pos FROM f),
b AS (
  SELECT id, i, pos + length(part) - length(regexp_replace(part, '^\\s+', '')) AS start, regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') AS claim FROM g),
e AS (SELECT *, trim(regexp_replace(claim, '{A.CITATION}', '', 'g'), {edges}) AS bare FROM b),
cl AS (
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS claim_index, start::INT AS start, (start + length(claim))::INT AS "end", claim
  FROM e WHERE length(bare) >= {A.MIN_CLAIM} AND {refused})"""


@query(f"""WITH {_claims("benchmark", "item_id", "text")} SELECT * FROM cl""")
def claim_decomposition(spark, d):
    return A.claims(table(spark, d, "benchmark"), "item_id", "text")


_ID = "conv_id * 1000 + turn"


@query(f"""WITH {_ANSWERS}, {_claims("an", _ID, "answer")},
j AS (SELECT cl.*, question, cells FROM cl JOIN an ON cl.id = {_ID}),
r0 AS (SELECT *, {_runs("question")} AS q0, {_runs("claim")} AS c0 FROM j),
r1 AS (
  SELECT *, list_transform(q0, lambda r: r.norm) AS marks, list_transform({_first_of_each("c0")}, lambda r: r.norm) AS said,
    list_transform(list_filter({numerics("claim")}, lambda z: NOT list_contains({numerics("question")}, z)), lambda z: {_form("z")}) AS numbers,
    list_transform(cells, lambda c: {{'cell_id': c.cell_id, 'form': {_form("coalesce(c.text, '')")}}}) AS formed FROM r0),
r2 AS (SELECT *, list_concat(numbers, list_filter(said, lambda n: len(list_filter(marks, lambda m: contains(m, n) OR contains(n, m))) = 0)) AS signals FROM r1),
r3 AS (SELECT *, len(signals) = 0 AS skipped, list_filter(formed, lambda c: len(list_filter(signals, lambda s: NOT contains(c.form, s))) = 0)[1].cell_id AS first FROM r2)
SELECT id, claim_index, skipped, CASE WHEN NOT skipped THEN first END AS supporter, skipped OR first IS NOT NULL AS ok FROM r3""")
def claim_support(spark, d):
    a = _answers(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    rows = A.claims(a, "id").join(a.select("id", "question"), "id")
    return A.claim_support(rows, a.select("id", "cells")).select("id", "claim_index", "skipped", "supporter", "ok")


_RANKS = f"""{_ANSWERS}, {_named("an")}, k AS (SELECT conv_id, turn, cells, forms, novel, list_transform(marks, lambda m: {_form("m")}) AS marked, unnest(range(len(cells)))::INT AS rank FROM nm),
v AS (SELECT conv_id, turn, rank, cells[rank + 1].cell_id AS cell_id, cells[rank + 1].text AS text, list_transform(list_filter(novel, lambda r: contains(forms[rank + 1], r.norm)), lambda r: r.span) AS names, list_filter(marked, lambda m: m <> '' AND contains(forms[rank + 1], m)) AS anchors, len(novel) AS n FROM k),
su AS (SELECT *, n > 0 AND len(names) = n AS supports_all FROM v)"""


@query(f"""WITH {_RANKS} SELECT conv_id, turn, rank, cell_id, coalesce(text, '') <> '' AS has_text, array_to_string(names, '|') AS names, array_to_string(list_sort(anchors), '|') AS anchors, supports_all, supports_all AND len(anchors) > 0 AS validates FROM su""")
def rank_support(spark, d):
    """What each cell of an answer holds of its names and of the question's anchors."""
    r = A.rank_support(_answers(spark, d), ["conv_id", "turn"])
    return r.withColumns({"names": F.array_join("names", "|"), "anchors": F.array_join(F.array_sort("anchors"), "|")})


@query(f"""WITH {_RANKS}, z AS (SELECT conv_id, turn, list({{'c': cell_id, 't': text}} ORDER BY rank) FILTER (supports_all AND len(anchors) > 0) AS kept FROM su GROUP BY conv_id, turn)
SELECT conv_id, turn, kept IS NULL AS refused, coalesce(array_to_string(list_transform(kept, lambda k: k.c), ','), '') AS cited, md5(CASE WHEN kept IS NULL THEN 'Memory is silent: no candidate was verified as a match.' ELSE 'From verified memory:' || chr(10) || array_to_string(list_transform(kept, lambda k: '- (' || k.c || ') ' || coalesce(k.t, '')), chr(10)) END) AS text_md5 FROM z""")
def verified_answers(spark, d):
    """Answers from the cells that bear them out alone; none where no cell does."""
    answers = _answers(spark, d)
    texts = answers.select("conv_id", "turn", F.explode("cells").alias("c")).select("conv_id", "turn", "c.cell_id", "c.text")
    r = A.rank_support(answers, ["conv_id", "turn"]).select("conv_id", "turn", "rank", "cell_id", "validates").join(texts, ["conv_id", "turn", "cell_id"])
    g = r.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("rank", "cell_id", "text", F.col("validates").alias("accepted")))).alias("c"))
    said = g.select("conv_id", "turn", A.verified_answer(F.col("c")).alias("a"))
    return said.select("conv_id", "turn", "a.refused", F.array_join(F.transform("a.cited", lambda c: c.cast("string")), ",").alias("cited"), F.md5("a.text").alias("text_md5"))


_RESCUED = """rs AS (
  SELECT *, CASE WHEN len(marks) > 0 THEN novel[1].span END AS prim, list_transform(marks, lambda m: {mark}) AS marked FROM {source}),
rp AS (SELECT *, {form} AS pf FROM rs),
rw AS (
  SELECT *, CASE WHEN pf <> '' THEN list_position(list_transform(forms, lambda f: contains(f, pf) AND len(list_filter(marked, lambda m: contains(f, m))) > 0), true) END AS place FROM rp),
re AS (
  SELECT *, CASE WHEN prim IS NULL OR pf = '' THEN 'reject_no_primary' WHEN coalesce(place, 0) < 1 THEN 'reject_no_supporting_cell'
    WHEN place > 3 THEN 'reject_outside_window' WHEN {act} < 0.4::DOUBLE THEN 'reject_below_floor' ELSE 'rescue' END AS rescue_outcome FROM rw)"""


@query(f"""WITH {_ANSWERS}, {_named("an")}, {_RESCUED.format(mark=_form("m"), form=_form("prim"), source="nm", act="0.6::DOUBLE - (place - 1) * 0.1::DOUBLE")}
SELECT conv_id, turn, rescue_outcome AS outcome, CASE WHEN place >= 1 THEN (place - 1)::INT END AS support_rank FROM re""")
def rescue_decision(spark, d):
    a = _answers(spark, d).withColumn("cells", F.transform("cells", lambda c, i: F.struct(c["cell_id"], c["text"], (F.lit(0.6) - i * 0.1).alias("act"))))
    return A.rescue(a).select("conv_id", "turn", "outcome", "support_rank")


# The answer pipeline: each query vector asks with the beginning of its document; the draft is the beginning of the best cell's document, some with words put in.
def _asked(spark, d, threshold: float) -> DataFrame:
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    found = R.topk(R.as_cells(e), R.as_queries(e), 10, by="act", include_silent=True)
    label = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "lang", "source"))
    sources = docs.select(F.col("doc_id").alias("cell_id"), F.when(F.col("doc_id") % 5 != 3, F.col("text")).alias("text"), label.alias("label"))
    return answerflow.answered(_drafts(spark, d, found), found, sources, threshold)


def _drafts(spark, d, found) -> DataFrame:
    """query_id, question and draft."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    best = found.where("rank = 1").select("query_id", F.col("cell_id").alias("doc_id")).join(docs.select("doc_id", F.col("text").alias("said")), "doc_id").select("query_id", "said")
    more = F.when(F.col("query_id") % 300 == 100, " and 1987 of Old Zanzibar").when(F.col("query_id") % 500 == 200, " said Ann Miller").otherwise("")
    own = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return R.as_queries(e).select("query_id").join(own, "query_id").join(best, "query_id").select("query_id", "question", F.concat("said", more).alias("draft"))


def _flow(threshold: float, name: str) -> str:
    """CTEs that end in `name`: the outcome per question."""
    return f"""hd AS (
  SELECT query_id, rank, cell_id, act, CASE WHEN doc_id % 5 <> 3 THEN text END AS text, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source END AS label FROM r LEFT JOIN documents ON doc_id = cell_id),
sh AS (
  SELECT query_id, list({{'cell_id': cell_id, 'text': text, 'act': act}} ORDER BY rank) FILTER (coalesce(text, '') <> '') AS cells, max(act) FILTER (rank = 1) AS top1, max(act) FILTER (rank = 2) AS top2,
    coalesce(bool_or(act >= 0.4::DOUBLE) FILTER (rank <= 3), false) AS plausible,
    list(coalesce(trim(label), CASE WHEN coalesce(text, '') <> '' THEN substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END END) ORDER BY rank) FILTER (rank <= 3) AS topics
  FROM hd GROUP BY query_id),
qs AS (
  SELECT r.query_id, o.text AS question, b.text || CASE WHEN r.query_id % 300 = 100 THEN ' and 1987 of Old Zanzibar' WHEN r.query_id % 500 = 200 THEN ' said Ann Miller' ELSE '' END AS answer
  FROM r JOIN documents o ON o.doc_id = r.query_id JOIN documents b ON b.doc_id = r.cell_id WHERE r.rank = 1),
an AS (SELECT qs.*, coalesce(cells, []) AS cells, lower(array_to_string(list_transform(coalesce(cells, []), lambda c: c.text), ' ')) AS blob, top1 - top2 AS margin, plausible, topics FROM qs JOIN sh USING (query_id)),
{_CHECKED}, {_RESCUED.format(mark=_form("m"), form=_form("prim"), source="ve", act="cells[place].act")},
ot AS (
  SELECT *, margin >= {threshold} AS fires, len(cells) < 1 AS bare_cells, reason IN ('covered', 'nothing to verify') AS grounded FROM re),
{name} AS (
  SELECT *, (fires OR plausible) AND NOT bare_cells AS looked_at, (fires OR plausible) AND NOT bare_cells AND grounded AND (fires OR rescue_outcome = 'rescue') AS given,
    'gate: ' || CASE WHEN fires THEN 'margin above' ELSE 'margin below' END AS stopped FROM ot)"""


_OUTCOME = "CASE WHEN given THEN 'grounded' WHEN fires AND looked_at THEN 'silence_drift' ELSE 'silence_gate' END"
_WHY = """CASE WHEN given THEN '' WHEN NOT fires AND NOT plausible THEN stopped WHEN bare_cells THEN CASE WHEN fires THEN 'gate passed, no source text' ELSE stopped || '; no source text' END
    WHEN fires THEN 'verify: ' || reason WHEN NOT grounded THEN stopped || '; verify: ' || reason ELSE stopped || '; rescue: ' || rescue_outcome END"""


@query(f"""WITH {RANKED.format(n=10)}, {_flow(0.015, "fl")}
SELECT query_id, {_OUTCOME} AS outcome, {_WHY} AS reason, fires, round(margin, 6) AS gate_margin, CASE WHEN looked_at THEN grounded END AS grounded, CASE WHEN looked_at THEN covered END::INT AS covered, CASE WHEN looked_at THEN total END::INT AS total,
  CASE WHEN looked_at AND grounded AND NOT fires THEN rescue_outcome END AS rescue, array_to_string(CASE WHEN looked_at THEN list_transform(cells, lambda c: c.cell_id::VARCHAR) ELSE [] END, ',') AS citations,
  array_to_string(list_filter(topics, lambda t: t IS NOT NULL), ' | ') AS topics, NOT given AS silent FROM fl""")
def answer_pipeline(spark, d):
    f = _asked(spark, d, 0.015)
    return f.withColumns({"gate_margin": F.round("gate_margin", 6), "citations": F.array_join(F.transform("citations", lambda c: c.cast("string")), ","), "topics": F.array_join(F.transform("topics", lambda t: t["topic"]), " | ")})


@query(f"""WITH {RANKED.format(n=10)}, {_flow(0.015, "fl")}, s2 AS (
  SELECT query_id, {_OUTCOME} AS first, given, fires OR margin >= 0.004 AS wide, looked_at, grounded, bare_cells FROM fl),
s3 AS (SELECT query_id, first, NOT given AND wide AND NOT bare_cells AND grounded AS from_second FROM s2)
SELECT query_id, CASE WHEN from_second THEN 'grounded' ELSE first END AS outcome, from_second FROM s3""")
def answer_two_passes(spark, d):
    """Where the pass with the usual gate stays silent, the answer of a pass with a wider gate counts if it has one."""
    return answerflow.two_passes(_asked(spark, d, 0.015), _asked(spark, d, 0.004)).select("query_id", "outcome", "from_second")


@query(f"""WITH {RANKED.format(n=10)}, {_flow(0.015, "fl")}, cl AS (SELECT CASE WHEN query_id % 200 = 0 THEN 'known' ELSE 'foreign' END AS class, {_OUTCOME} AS outcome FROM fl)
SELECT class, count(*) AS n, count(*) FILTER ((class = 'known') = (outcome = 'grounded')) AS correct, round(avg(((class = 'known') = (outcome = 'grounded'))::INT), 6) AS accuracy,
  count(*) FILTER (outcome = 'grounded') AS grounded, count(*) FILTER (outcome = 'silence_gate') AS silence_gate, count(*) FILTER (outcome = 'silence_drift') AS silence_drift FROM cl GROUP BY class""")
def outcome_accuracy(spark, d):
    known = F.when(F.col("query_id") % 200 == 0, "known").otherwise("foreign")
    rows = _asked(spark, d, 0.015).select(known.alias("class"), "outcome").withColumn("expected", F.when(F.col("class") == "known", "grounded").otherwise("silence"))
    return answerflow.accuracy_by_class(rows, "class", "expected")


@query(f"""WITH {RANKED.format(n=10)}, {_flow(0.015, "fl")}, e AS (SELECT CASE WHEN NOT given THEN {_OUTCOME} WHEN fires THEN 'grounded_normal' ELSE 'grounded_via_rescue' END AS decision, contains(lower(answer), 'und') OR contains(lower(answer), 'the') AS kw_hit FROM fl),
f AS (SELECT *, decision = 'grounded_via_rescue' AS rescued, decision IN ('grounded_via_rescue', 'grounded_normal') AS grounded FROM e)
SELECT count(*) AS n, count(*) FILTER (grounded) AS grounded, count(*) FILTER (grounded AND kw_hit) AS grounded_kw_hit, count(*) FILTER (grounded AND NOT kw_hit) AS grounded_kw_miss, count(*) FILTER (rescued AND kw_hit) AS rescued_kw_hit, count(*) FILTER (rescued AND NOT kw_hit) AS rescued_kw_miss FROM f""")
def pipeline_multihop_counts(spark, d):
    """How the answer pipeline's questions end, and whether the drafts given hold one of two words."""
    e = table(spark, d, "embeddings")
    found = R.topk(R.as_cells(e), R.as_queries(e), 10, by="act", include_silent=True)
    said = _drafts(spark, d, found).select("query_id", (F.contains(F.lower("draft"), F.lit("und")) | F.contains(F.lower("draft"), F.lit("the"))).alias("kw_hit"))
    label = F.when(F.col("outcome") != "grounded", F.col("outcome")).when(F.col("fires"), "grounded_normal").otherwise("grounded_via_rescue")
    return reports.multihop_counts(_asked(spark, d, 0.015).select("query_id", label.alias("decision")).join(said, "query_id"))


@query(f"""WITH {RANKED.format(n=10)}, {_flow(0.015, "fl")}, w AS (SELECT *, {_WHY} AS why, coalesce(looked_at AND grounded AND NOT fires, false) AS tried FROM fl)
SELECT query_id, CASE WHEN given AND tried THEN 'grounded_via_rescue' WHEN given THEN 'grounded_normal' WHEN starts_with(why, 'verify') THEN 'silence_drift' WHEN tried THEN 'silence_rescue_reject' ELSE 'silence_gate' END AS decision,
  CASE WHEN NOT given THEN 'silence' WHEN contains(lower(answer), 'und') OR contains(lower(answer), 'the') THEN 'grounded' ELSE 'wrong' END AS mode FROM w""")
def decision_labels(spark, d):
    """The label of each question's outcome, and whether what is said holds one of two words."""
    e = table(spark, d, "embeddings")
    found = R.topk(R.as_cells(e), R.as_queries(e), 10, by="act", include_silent=True)
    j = _asked(spark, d, 0.015).select("query_id", "silent", "reason", "rescue").join(_drafts(spark, d, found), "query_id")
    return j.select("query_id", reports.decision_label(F.col("silent"), F.col("reason"), F.col("rescue")).alias("decision"), reports.mode_verdict(F.col("draft"), F.col("silent"), F.array(F.lit("und"), F.lit("the"))).alias("mode"))


@query(f"""WITH {RANKED.format(n=10)} SELECT query_id, array_to_string(list(cell_id ORDER BY rank) FILTER (act > 0.22 AND cell_id % 2 = 0), ',') AS kept, count(*) FILTER (cell_id % 2 = 0)::INT AS n_claimed FROM r GROUP BY query_id""")
def claims_within_fired(spark, d):
    """Of the even ids that an answer claims, those that have fired."""
    e = table(spark, d, "embeddings")
    found = R.topk(R.as_cells(e), R.as_queries(e), 10, by="act", include_silent=True)
    g = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cell_id", "fired"))).alias("s"))
    ids = lambda cond: F.transform(F.filter("s", cond), lambda x: x["cell_id"])
    claimed = ids(lambda x: x["cell_id"] % 2 == 0)
    kept = intents.within_fired(claimed, ids(lambda x: x["fired"]))
    return g.select("query_id", F.nullif(F.array_join(F.transform(kept, lambda c: c.cast("string")), ","), F.lit("")).alias("kept"), F.size(claimed).alias("n_claimed"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(list_filter(list_transform(regexp_split_to_array('  ' || chr(10) || 'Sub-Question: SUBQUESTION ' || CASE WHEN turn % 3 = 0 THEN '' ELSE text END || chr(13) || chr(10) || CASE WHEN turn % 2 = 0 THEN 'next' ELSE '' END, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(trim(x), '(?i)^\s*(SUB-?QUESTION\s*:?\s*)+', ''))), lambda x: x <> '')[1], ''), role) AS question FROM conversations""")
def sub_questions(spark, d):
    """The first line of a rewritten question that says something, else the question itself."""
    said = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))
    raw = F.concat(F.lit("  \nSub-Question: SUBQUESTION "), said, F.lit("\r\n"), F.when(F.col("turn") % 2 == 0, "next").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", splits.sub_question(raw, F.col("role")).alias("question"))


@query(r"""SELECT conv_id, turn, md5('{"said": {"text": "' || regexp_replace(text, '[{}]', '', 'g') || '"}}') AS json_md5 FROM conversations""")
def json_in_answers(spark, d):
    """From the first brace to the last one of an answer with words around."""
    said = F.concat(F.lit('Sure: {"said": {"text": "'), F.regexp_replace("text", "[{}]", ""), F.lit('"}} and\nno more'))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.first_json(said)).alias("json_md5"))


@query(f"""WITH {RANKED.format(n=10)}, {_flow(-10, "fl")}, e AS (SELECT margin, {_OUTCOME} AS outcome, contains(lower(answer), 'und') OR contains(lower(answer), 'the') AS kw_hit FROM fl), t AS (SELECT unnest([0.0, 0.005, 0.01, 0.02, 0.05, 0.5]::DOUBLE[]) AS threshold),
x AS (SELECT threshold, kw_hit, CASE WHEN coalesce(margin >= threshold, false) THEN outcome ELSE 'silence_gate' END AS now FROM e, t)
SELECT threshold, count(*) AS n, count(*) FILTER (now = 'grounded') AS grounded, count(*) FILTER (now = 'grounded' AND kw_hit) AS grounded_kw_hit, count(*) FILTER (now = 'grounded' AND NOT kw_hit) AS grounded_kw_miss, count(*) FILTER (now = 'silence_gate') AS silence_gate, count(*) FILTER (now = 'silence_drift') AS silence_drift FROM x GROUP BY threshold""")
def multihop_sweep(spark, d):
    """What becomes of the pipeline's questions at several gates."""
    e = table(spark, d, "embeddings")
    found = R.topk(R.as_cells(e), R.as_queries(e), 10, by="act", include_silent=True)
    said = _drafts(spark, d, found).select("query_id", (F.contains(F.lower("draft"), F.lit("und")) | F.contains(F.lower("draft"), F.lit("the"))).alias("kw_hit"))
    rows = _asked(spark, d, -10.0).select("query_id", F.col("gate_margin").alias("margin"), "outcome").join(said, "query_id")
    return reports.multihop_sweep(rows, [0.0, 0.005, 0.01, 0.02, 0.05, 0.5])
