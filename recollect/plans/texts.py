"""Queries over texts: tokens, fingerprints, BM25 and the cascade, fact and answer checks, corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import answerflow, corpus, factcheck, lexical
from recollect.operators import retrieval as R
from recollect.session import release, scratch_path, table
from recollect.sources.files import exists

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9'']+')"
CONTENT = "list_filter(" + TOKENS + ", lambda t: length(t) >= 2 AND NOT list_contains(" + _list(X.STOP_WORDS) + ", t))"
FACT = "list_filter(" + TOKENS + ", lambda t: NOT list_contains(" + _list(X.FACT_STOP_WORDS) + ", t))"
NORMAL = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def _tok(c):
    return TOKENS.format(c=c)


def _content(c):
    return CONTENT.format(c=c)


@query(f"SELECT doc_id, len({_tok('text')})::INT AS n_tokens, len(list_distinct({_tok('text')}))::INT AS n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"SELECT doc_id, md5(array_to_string({_content('text')}, ' ')) AS tokens_md5, len({_content('text')})::INT AS n FROM documents")
def content_tokens(spark, d):
    t = X.content_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(t, " ")).alias("tokens_md5"), F.size(t).alias("n"))


@query(f"SELECT fp, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha1({NORMAL.format(c='text')}) AS fp FROM documents WHERE {NORMAL.format(c='text')} <> '') GROUP BY fp")
def fingerprint_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fp")).where("fp IS NOT NULL")
    return docs.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents), b AS (SELECT DISTINCT sha1({NORMAL.format(c='text')}) AS fp FROM benchmark WHERE length(text) >= 20), p AS (SELECT DISTINCT sha1({NORMAL.format(c='text')}) AS fp FROM l WHERE length(text) >= 20)
SELECT (SELECT count(*) FROM p) AS n_bank, (SELECT count(*) FROM b) AS n_corpus, (SELECT count(*) FROM b WHERE fp IN (SELECT fp FROM p)) AS n_shared, round((SELECT count(*) FROM b WHERE fp IN (SELECT fp FROM p)) / (SELECT count(*) FROM b), 6) AS ratio, (SELECT count(*) FROM b WHERE fp IN (SELECT fp FROM p)) / (SELECT count(*) FROM b) <= 0.001 AS passes""")
def disjointness_report(spark, d):
    """Lines of the documents against the benchmark's texts."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("text"))
    return corpus.disjointness(corpus.fingerprints(lines), corpus.fingerprints(table(spark, d, "benchmark")))


@query(f"""SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {NORMAL.format(c='text')} ORDER BY doc_id) = 1""")
def ordered_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(X.normal_paragraph(F.col("text")), 256).alias("k"))
    return corpus.keep_first(docs, F.col("k"), "doc_id").select("doc_id")


_BM25 = f"""d AS (SELECT doc_id, {_content('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM d) GROUP BY ALL),
f AS (SELECT token, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p, st GROUP BY token), mi AS (SELECT avg(raw) AS m FROM f),
a AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({_content('text')}) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, p.doc_id, sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / avgdl))) AS score FROM a JOIN f USING (token) JOIN p USING (token) JOIN d ON d.doc_id = p.doc_id, st, mi GROUP BY query_id, p.doc_id HAVING score > 0)"""


_indexes: dict[tuple, str] = {}


def document_index(spark, d):
    """The index over the documents of a folder: built and saved once per application, then read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes or not exists(spark, f"{_indexes[key]}/manifest"):
        built = lexical.build_index(table(spark, d, "documents").select("doc_id", "text"))
        folder = scratch_path(spark, "index")
        lexical.save_index(built, folder)
        release(built["tokenised"])
        _indexes[key] = folder
    return lexical.load_index(spark, _indexes[key])


@query(f"""WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM sc QUALIFY rank <= 10""")
def bm25_topk(spark, d):
    index = document_index(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25_topk(index, q).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"""SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_content('text')})) AS token FROM documents) GROUP BY token""")
def document_frequency(spark, d):
    return document_index(spark, d)["terms"]


def _queries_with_vectors(spark, d, words: bool):
    """Benchmark items with the vector of the cell of the same id; without words: texts of function words alone."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("text") if words else F.when(F.col("item_id") % 2 == 0, "what is the of and").otherwise(F.col("text"))).alias("text"))
    return b.join(v, "query_id")


_CELLS = "c AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS w FROM embeddings), q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON vec_id = item_id)"


def _cascade(spark, d, words):
    q = _queries_with_vectors(spark, d, words)
    e = table(spark, d, "embeddings")
    dense = R.topk(R.as_cells(e), q.select("query_id", "vector"), 5, by="act", include_silent=True)
    index = document_index(spark, d)
    out = lexical.cascade(index, q, R.as_cells(e), dense, 200, 5)
    return out.select("query_id", "rank", "cell_id", F.round("act", 6).alias("act"), "path")


_LEX = """o AS (SELECT query_id, doc_id AS cell_id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 200),
l AS (SELECT query_id, cell_id, list_inner_product(qv, w) AS act FROM o JOIN q USING (query_id) JOIN c USING (cell_id)), k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, cell_id)::INT AS rank, cell_id, round(act, 6) AS act, 'cascade' AS path FROM l QUALIFY rank <= 5),
e AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qv, w), 9) DESC, cell_id)::INT AS rank, cell_id, round(list_inner_product(qv, w), 6) AS act, 'dense' AS path FROM q, c QUALIFY rank <= 5)
SELECT * FROM k UNION ALL SELECT * FROM e WHERE query_id NOT IN (SELECT query_id FROM o)"""


@query(f"WITH {_BM25}, {_CELLS}, {_LEX}")
def hybrid_cascade(spark, d):
    return _cascade(spark, d, True)


_STOPPED = _BM25.replace("FROM benchmark)", "FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'what is the of and' ELSE text END AS text FROM benchmark))")


@query(f"WITH {_STOPPED}, {_CELLS}, {_LEX}")
def hybrid_dense_fallback(spark, d):
    return _cascade(spark, d, False)


@query("""SELECT doc_id AS id, 0 AS prio FROM documents WHERE doc_id % 2 = 1 AND contains(lower(text), 'license') UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 0 AND contains(lower(text), 'license') ORDER BY prio, id LIMIT 20""")
def cell_search(spark, d):
    """Texts that hold a word, those of the overlay (odd ids) first, 20 in all."""
    docs = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 1, 0).otherwise(1).alias("prio")).orderBy("prio", "id").limit(20)


# Fact checks: each turn of a conversation against the next one, some of them with words put in that turn facts around.
_MADE = {0: " must approve 12 units on monday", 1: " may reject 15 units on tuesday", 2: " approved ten units in Paris", 3: " never rejected 10 units in London"}
_PAIRS = "pr AS (SELECT conv_id, turn, text || CASE turn % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _MADE.items()) + " END AS text FROM conversations), fp AS (SELECT a.conv_id, a.turn, a.text AS query, b.text AS candidate FROM pr a JOIN pr b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_NUMS = "list_distinct(list_concat(flatten(list_transform(" + TOKENS + ", lambda t: regexp_extract_all(t, '[0-9]+'))), list_transform(list_filter(" + TOKENS + ", lambda t: list_contains(" + _list(X.NUMBER_WORDS) + ", t)), lambda t: map {{" + ", ".join(f"'{k}': '{v}'" for k, v in X.NUMBER_WORDS.items()) + "}}[t])))"
_NOUNS = "list_distinct(list_filter(list_transform(list_filter(list_slice(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9'']+'), 2, 1000000), lambda t: regexp_matches(t, '^[A-Z]')), lambda t: lower(t)), lambda t: NOT list_contains(" + _list(X.WEEKDAYS + X.MONTHS) + ", t)))"


def _more(a, b):
    return f"(len(list_filter({a}, lambda z: NOT list_contains({b}, z))) > 0 AND len(list_filter({b}, lambda z: NOT list_contains({a}, z))) > 0)"


def _set(c, words):
    return f"list_sort(list_distinct(list_filter({_tok(c)}, lambda t: list_contains({_list(words)}, t))))"


def _days(words):
    a, b = _set("query", words), _set("candidate", words)
    return f"(len({a}) > 0 AND len({b}) > 0 AND {a} <> {b})"


def _opposed(pairs):
    p = "[" + ", ".join(f"['{a}', '{b}']" for a, b in pairs) + "]"
    q, c = _tok("query"), _tok("candidate")
    return f"len(list_filter({p}, lambda z: (list_contains({q}, z[1]) AND list_contains({c}, z[2])) OR (list_contains({q}, z[2]) AND list_contains({c}, z[1])))) > 0"


_DETECT = {
    "number": _more(_NUMS.format(c="query"), _NUMS.format(c="candidate")),
    "entity": _more(_NOUNS.format(c="query"), _NOUNS.format(c="candidate")),
    "date": f"({_days(X.WEEKDAYS)} OR {_days(X.MONTHS)})",
    "negation": f"(len({_set('query', X.NEGATIONS)}) > 0) <> (len({_set('candidate', X.NEGATIONS)}) > 0)",
    "antonym": _opposed(X.ANTONYMS),
    "modal": _opposed(X.MODALS),
}


def _pairs(spark, d):
    c = table(spark, d, "conversations")
    extra = F.when(F.lit(False), "")
    for k, v in _MADE.items():
        extra = extra.when(F.col("turn") % 4 == k, v)
    c = c.select("conv_id", "turn", F.concat("text", extra).alias("text"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return c.withColumnRenamed("text", "query").join(nxt, ["conv_id", "turn"])


def _detector(name):
    def run(spark, d):
        return _pairs(spark, d).select("conv_id", "turn", factcheck.DETECTORS[name](F.col("query"), F.col("candidate")).alias("flip"))

    run.__name__ = f"fact_{name}"
    run.__doc__ = f"The {name} detector on pairs of turns."
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f"WITH {_PAIRS} SELECT conv_id, turn, {_DETECT[name]} AS flip FROM fp"


for _name in _DETECT:
    _detector(_name)

_KEY = "list_sort(list_distinct(" + FACT + "))"
_HELD = "(least(len({a}), len({b})) >= 3 AND (CASE WHEN len({a}) <= len({b}) THEN len(list_filter({a}, lambda z: NOT list_contains({b}, z))) ELSE len(list_filter({b}, lambda z: NOT list_contains({a}, z))) END) = 0)".format(a=_KEY.format(c="query"), b=_KEY.format(c="candidate"))
_FLIPS = ", ".join(f"{v} AS {k}_flip" for k, v in _DETECT.items())
_VERDICT = f"WITH {_PAIRS}, de AS (SELECT conv_id, turn, {_FLIPS}, ({_KEY.format(c='query')} = {_KEY.format(c='candidate')} OR {_HELD}) AS ok FROM fp)"


@query(f"{_VERDICT} SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"{k}_flip" for k in _DETECT) + " THEN 'reject' WHEN ok THEN 'accept' ELSE 'ambiguous' END AS verdict FROM de")
def fact_verdict(spark, d):
    return factcheck.with_verdict(_pairs(spark, d)).select("conv_id", "turn", "verdict")


@query(
    _VERDICT
    + " "
    + " UNION ALL ".join(f"SELECT '{x}' AS without, count(*) FILTER ({h}) AS rejected, count(*) FILTER (NOT ({h}) AND ok) AS accepted, count(*) FILTER (NOT ({h}) AND NOT ok) AS ambiguous FROM de" for x in ["none", *_DETECT] for h in [" OR ".join(f"{k}_flip" for k in _DETECT if k != x)])
)
def detector_ablation(spark, d):
    return factcheck.ablation(_pairs(spark, d))


@query("""SELECT event_id AS query_id, CASE WHEN value < 10 AND NOT (value * 2 < 15) THEN 'answer' WHEN value < 10 THEN 'silence' ELSE 'answer' END AS outcome, value < 10 AND NOT (value * 2 < 15) AS from_second FROM events""")
def two_pass_fallback(spark, d):
    """Where the first pass is silent, the second, of a wider reach, is asked."""
    e = table(spark, d, "events").select(F.col("event_id").alias("query_id"), "value")
    one = e.select("query_id", F.when(F.col("value") < 10, "silence").otherwise("answer").alias("outcome"))
    two = e.where("value < 10").select("query_id", F.when(F.col("value") * 2 < 15, "silence").otherwise("answer").alias("outcome"))
    silent = (F.col("outcome") == "silence").alias("silent")
    return answerflow.two_passes(one.select("*", silent), two.select("*", silent)).select("query_id", "outcome", "from_second")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, pos, last_value(CASE WHEN length(line) <= 60 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS title FROM l""")
def forward_fill_title(spark, d):
    """Short lines serve as titles of the lines below them."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    title = F.when((F.length("line") <= 60) & (F.col("line") != ""), F.col("line"))
    return corpus.forward_filled(lines, "doc_id", "pos", title).select("doc_id", F.col("pos").cast("long").alias("pos"), "title")


@query(r"""WITH g AS (SELECT source, count(*) AS n, sha1(concat('0:', source)) AS k FROM documents GROUP BY source), t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), u AS (SELECT *, coalesce(sum(CASE WHEN b < 300 THEN 0 ELSE n END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tb FROM t)
SELECT source, n, CASE WHEN b < 300 THEN 'train' ELSE 'test' END AS part, (CASE WHEN b < 300 THEN least(n, 300 - b) ELSE least(n, 100 - tb) END)::BIGINT AS taken FROM u WHERE b < 300 OR tb < 100""")
def article_split(spark, d):
    return corpus.group_split(table(spark, d, "documents"), "source", 300, 100)


@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: length(p) >= 40))::INT AS n_paragraphs, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: length(p) >= 40), '|')) AS paragraphs_md5 FROM documents""")
def paragraph_split(spark, d):
    p = X.paragraphs(F.col("text"), "\n", 40)
    return table(spark, d, "documents").select("doc_id", F.size(p).alias("n_paragraphs"), F.md5(F.array_join(p, "|")).alias("paragraphs_md5"))


@query(r"""WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS paras FROM documents),
f AS (
  SELECT doc_id, paras, 0 AS i, '' AS open, []::VARCHAR[] AS closed FROM d
  UNION ALL
  SELECT doc_id, paras, i + 1,
    CASE WHEN length(p) > 700 THEN '' WHEN open = '' THEN p WHEN length(open) + 2 + length(p) <= 700 THEN open || chr(10) || chr(10) || p ELSE p END,
    list_concat(CASE WHEN open = '' OR (length(p) <= 700 AND length(open) + 2 + length(p) <= 700) THEN [] ELSE [open] END,
      CASE WHEN length(p) > 700 THEN list_filter(list_transform(range(0, greatest(ceil((length(p) - 700) / 620), 0)::BIGINT + 1), lambda k: trim(substring(p, k * 620 + 1, 700))), lambda c: c <> '') ELSE [] END)
  FROM (SELECT *, paras[i + 1] AS p FROM f WHERE i < len(paras))),
c AS (
  SELECT doc_id, i, unnest(closed) AS text, unnest(range(len(closed))) AS k FROM f
  UNION ALL SELECT doc_id, i, open, 1000000 FROM f WHERE i = len(paras) AND open <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k))::INT AS chunk, length(text)::INT AS chars, length(text) >= 40 AS accepted, md5(text) AS text_md5 FROM c""")
def greedy_chunks(spark, d):
    return corpus.greedy_chunks(table(spark, d, "documents"), separator=r"\n").select("doc_id", "chunk", F.length("text").alias("chars"), "accepted", F.md5("text").alias("text_md5"))


_NTOK = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


@query(f"""WITH n AS (SELECT doc_id, {_NTOK} AS n FROM documents), o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS s FROM n WHERE n > 0), t AS (SELECT doc_id, s, n, unnest(range((s // 64)::BIGINT, ((s + n - 1) // 64 + 1)::BIGINT)) AS chunk_id FROM o)
SELECT chunk_id, sum(least(s + n, (chunk_id + 1) * 64) - greatest(s, chunk_id * 64))::BIGINT AS n_tokens, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM t GROUP BY chunk_id""")
def token_chunks(spark, d):
    return corpus.token_chunks(table(spark, d, "documents"))


@query(r"""WITH n AS (SELECT doc_id, len(regexp_split_to_array(trim(text), '\s+'))::BIGINT AS n FROM documents), o AS (SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start FROM n) SELECT doc_id, n, start FROM o WHERE start < 100000""")
def token_budget_fill(spark, d):
    return corpus.budget_fill(table(spark, d, "documents"), 100_000)


@query("""WITH t AS (SELECT item_id AS doc_id, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark) SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next_token FROM t QUALIFY next_token IS NOT NULL""")
def next_token_pairs(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", " ", -1)).alias("pos", "token"))
    return corpus.next_pairs(t).select("doc_id", F.col("pos").cast("long").alias("pos"), "token", "next_token")


@query(r"""SELECT doc_id, lang, length(trim(text)) AS chars FROM documents WHERE lang = 'en' AND length(trim(text)) >= 200""")
def long_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length(F.trim("text")).cast("long").alias("chars"))
    return docs.where("lang = 'en' AND chars >= 200")


@query(r"""SELECT item_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, greatest(8, len(regexp_split_to_array(trim(text), '\s+')) // 2)), ' ') AS half FROM benchmark""")
def half_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.half_query(F.col("text")).alias("half"))


@query(r"""SELECT doc_id, CASE WHEN regexp_extract('[' || lang || '] ' || source, '^\[([^\]]+)\]', 1) = '' THEN 'NONE' ELSE regexp_extract('[' || lang || '] ' || source, '^\[([^\]]+)\]', 1) END AS domain FROM documents""")
def label_domain(spark, d):
    return table(spark, d, "documents").select("doc_id", X.domain_of(F.concat(F.lit("["), "lang", F.lit("] "), "source")).alias("domain"))


@query("""SELECT doc_id, list_slice(list_concat(list_transform(list_slice(string_split(text, ' '), 1, 64), lambda w: length(w)), list_resize([]::BIGINT[], 64, 0)), 1, 64)::INT[] AS tokens FROM documents""")
def padded_tokens(spark, d):
    """The lengths of a document's first words as tokens, filled to 64 with 0."""
    t = F.transform(F.slice(F.split("text", " ", -1), 1, 64), F.length)
    return table(spark, d, "documents").select("doc_id", corpus.padded(t, 64, 0).alias("tokens"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("""SELECT item_id, contains(lower(text), 'license') OR contains(lower(text), 'the') AS hit FROM benchmark""")
def keyword_hits(spark, d):
    words = F.array(F.lit("license"), F.lit("the"))
    return table(spark, d, "benchmark").select("item_id", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("hit"))
