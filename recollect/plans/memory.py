"""Queries over banks as they change and over retrieval in several passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.operators import governance, lexical, multihop
from recollect.operators import retrieval as R
from recollect.operators.segments import Segments
from recollect.plans.dense import RANKED
from recollect.plans.texts import _BM25, _list, document_index
from recollect.session import scratch_path, table
from recollect.sources import commits as C
from recollect.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Two passes: the question of a query is the first sentence of its document.
_HOPS = rf"""{RANKED.format(n=10)}, u AS (SELECT DISTINCT query_id, split_part(text, '. ', 1) AS question FROM q JOIN documents ON doc_id = query_id),
x AS (SELECT query_id, rank, unnest(regexp_extract_all(regexp_replace(text, '{multihop.FOREIGN_WORD}', '_', 'g'), '{multihop.NAME}', 1)) AS name, unnest(range(len(regexp_extract_all(regexp_replace(text, '{multihop.FOREIGN_WORD}', '_', 'g'), '{multihop.NAME}', 1)))) AS i FROM r JOIN documents ON doc_id = cell_id WHERE rank <= 3),
y AS (SELECT x.query_id, name, rank, i FROM x JOIN u ON u.query_id = x.query_id WHERE NOT list_contains({_list(multihop.SENTENCE_OPENERS)}, name) AND NOT contains(lower(question), lower(name)) QUALIFY row_number() OVER (PARTITION BY x.query_id, lower(name) ORDER BY rank, i) = 1),
n AS (SELECT query_id, list(name ORDER BY rank, i)[1:6] AS names FROM y GROUP BY query_id), asked AS (SELECT u.query_id AS item_id, coalesce(names, []) AS names, trim(question || ' ' || array_to_string(coalesce(names, []), ' ')) AS text FROM u LEFT JOIN n ON n.query_id = u.query_id)"""
_HOP_SCORES = _BM25.replace("FROM benchmark)", "FROM asked)").replace("d AS (", "dd AS (", 1).replace("FROM d)", "FROM dd)").replace("avgdl FROM d)", "avgdl FROM dd)").replace("JOIN d ON", "JOIN dd d ON").replace("p AS (SELECT doc_id", "pp AS (SELECT doc_id", 1).replace("FROM p, st", "FROM pp, st").replace("JOIN p USING (token)", "JOIN pp p USING (token)")


def _hops(spark, d):
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    texts = docs.select(F.col("doc_id").alias("cell_id"), "text")
    q = R.as_queries(e)
    questions = docs.select(F.col("doc_id").alias("query_id"), F.split_part("text", F.lit(". "), F.lit(1)).alias("text")).join(q.select("query_id"), "query_id", "left_semi")
    first = R.topk(R.as_cells(e), q, 10, by="act", include_silent=True)
    return multihop.iterative(first, texts, questions, document_index(spark, d))


@query(f"WITH {_HOPS} SELECT item_id AS query_id, array_to_string(names, '|') AS names, md5(text) AS text_md5 FROM asked")
def second_pass_questions(spark, d):
    """Questions with the names that their first three cells' texts add."""
    return _hops(spark, d)[0].select("query_id", F.array_join("names", "|").alias("names"), F.md5("text").alias("text_md5"))


@query(f"""WITH {_HOPS}, {_HOP_SCORES}, b AS (SELECT query_id, doc_id AS cell_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10),
w AS (SELECT query_id, cell_id, 1 AS pass, rank FROM r UNION ALL SELECT query_id, cell_id, 2, rank FROM b), z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id, cell_id ORDER BY pass, rank) = 1)
SELECT query_id, cell_id, pass, rank::INT AS rank, (row_number() OVER (PARTITION BY query_id ORDER BY pass, rank, cell_id))::INT AS place FROM z""")
def iterative_retrieval(spark, d):
    """Dense cells first, then those that the question and the names found there bring up."""
    return _hops(spark, d)[1]


_LIVE = "(SELECT * FROM documents WHERE doc_id % 10 <> 4 OR doc_id % 3 = 2 OR doc_id % 30 = 4)"


@query(f"""WITH {_BM25.replace("FROM documents)", f"FROM {_LIVE})")} SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM sc QUALIFY rank <= 10""")
def segmented_bm25(spark, d):
    """A bank, an overlay and a second addition as segments, with a deletion between them that takes out a tenth of the ids, some of which come back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = Segments(spark, scratch_path(spark, "segments"))
    s.add(docs.where("doc_id % 3 = 0"))
    s.add(docs.where("doc_id % 3 = 1"))
    s.delete(docs.where("doc_id % 10 = 4"))
    s.add(docs.where("doc_id % 3 = 2 OR doc_id % 30 = 4"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25_topk(s.open(), asked).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def _bank(spark, d):
    """A bank of the vectors with their documents' texts; each tenth cell rests on two others, which may be bound themselves."""
    bank = C.LoggedBank(spark, scratch_path(spark, "bank"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("weight"), F.col("label").cast("string").alias("label"), F.lit(0.22).alias("theta"), F.when(F.col("vec_id") % 10 == 9, "bound").otherwise("single").alias("kind"), F.lit(0.0).alias("created_at"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), "text").join(e.select("cell_id"), "cell_id", "left_semi")
    bound = F.col("cell_id")
    edges = e.where("kind = 'bound'").select(bound.alias("bound_cell_id"), F.explode(F.array(F.floor(bound / 2).cast("long"), bound - 10)).alias("source_cell_id")).where("source_cell_id >= 0").distinct()
    meta = spark.range(1).select(F.lit("dim").alias("key"), F.lit("64").alias("value"), F.lit(0.0).alias("ts"))
    bank.commit(bank.write({"cells": e, "texts": texts, "edges": edges, "meta": meta}))
    return bank


_CLOSED = """c AS (SELECT vec_id AS cell_id, vec_id % 10 = 9 AS bound FROM embeddings), g AS (SELECT DISTINCT cell_id AS b, unnest([cell_id // 2, cell_id - 10]) AS s FROM c WHERE bound), f AS (SELECT cell_id FROM c WHERE NOT bound ORDER BY cell_id LIMIT 200),
x AS (SELECT cell_id FROM c WHERE NOT bound AND cell_id NOT IN (SELECT cell_id FROM f) UNION SELECT g.b FROM x JOIN g ON g.s = x.cell_id), k AS (SELECT cell_id, bound FROM c WHERE cell_id IN (SELECT cell_id FROM f) OR bound AND cell_id NOT IN (SELECT cell_id FROM x))"""


@query(f"""WITH RECURSIVE {_CLOSED} SELECT k.cell_id, CASE WHEN k.bound THEN 'bound' ELSE 'single' END AS kind, md5(text) AS text_md5, (SELECT count(*) FROM g WHERE g.b = k.cell_id AND g.s >= 0) AS n_sources FROM k LEFT JOIN documents ON doc_id = k.cell_id""")
def subset_export(spark, d):
    """The first 200 single cells and the bound cells that rest on them, read back from the exported bank."""
    out = C.export_subset(_bank(spark, d), scratch_path(spark, "subset"), 200)
    sources = out.table("edges").groupBy(F.col("bound_cell_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("n_sources"))
    cells = out.table("cells").join(out.table("texts"), "cell_id", "left").join(sources, "cell_id", "left")
    return cells.select("cell_id", "kind", F.md5("text").alias("text_md5"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


@query("""SELECT vec_id AS cell_id, label::VARCHAR AS label, md5(text) AS text_md5 FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 10 <> 9 AND trim(text) <> ''""")
def single_cell_texts(spark, d):
    return C.single_texts(_bank(spark, d)).select("cell_id", "label", F.md5("text").alias("text_md5"))


_ITEMS = r"""p AS (SELECT url, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10) || chr(10), 'g'), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 80)) AS text FROM pages),
i AS (SELECT DISTINCT translate(regexp_replace(regexp_extract(url, '([^/]*?)/*$', 1), '^(.+)\.[^.]*$', '\1'), '_-', '  ') AS label, text FROM p)"""


@query(f"""WITH {_ITEMS} SELECT label, count(*) AS n_cells, sum(length(text))::BIGINT AS n_chars, sum(('0x' || substring(md5(text), 1, 8))::BIGINT)::BIGINT AS digest FROM i GROUP BY label""")
def ledgered_load(spark, d):
    """The paragraphs of all pages loaded as cells: half of them first, then all, then all again."""
    bank = C.LoggedBank(spark, scratch_path(spark, "loaded"))
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.regexp_replace("html", "<[^>]*>", "\n\n").alias("text"))
    for part in (pages.where("page_id % 2 = 0"), pages, pages):
        C.load_once(bank, C.load_items(part.select("path", "text")))
    cells = bank.table("cells").join(bank.table("texts"), "cell_id")
    h = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")
    return cells.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.sum(h).alias("digest"))


_DRAFTS = r"""t AS (SELECT vec_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM embeddings JOIN documents ON doc_id = vec_id), b AS (SELECT DISTINCT k FROM t WHERE vec_id % 2 = 0),
o AS (SELECT *, length(text) >= 40 AS accepted FROM t WHERE vec_id % 2 = 1), n AS (SELECT min(vec_id) AS vec_id FROM o WHERE accepted AND k <> '' AND k NOT IN (SELECT k FROM b) GROUP BY k), m AS (SELECT max(vec_id) AS top FROM embeddings WHERE vec_id % 2 = 0),
a AS (SELECT count(*) AS proposed, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (accepted) AS passed, sum(length(text))::BIGINT AS text_chars FROM o), f AS (SELECT count(*) AS added FROM n), z AS (SELECT min(vec_id) AS low FROM embeddings WHERE vec_id % 2 = 0)"""


@query(f"""WITH {_DRAFTS} SELECT 'refused' AS source, proposed, 0::BIGINT AS added, rejected, passed - added AS duplicates, text_chars, true AS smoke_ran, false AS smoke_hit, low AS top_cell_id, NULL::BIGINT AS first_id, NULL::BIGINT AS last_id, false AS reload_required FROM a, f, z
UNION ALL SELECT 'taken', proposed, added, rejected, passed - added, text_chars, true, true, top + 1, top + 1, top + added, true FROM a, f, m
UNION ALL SELECT 'again', proposed, 0, rejected, passed, text_chars, false, false, NULL, NULL, NULL, false FROM a""")
def committed_candidates(spark, d):
    """Texts of odd ids as candidates for a bank of the even ones, three times: with a smoke query that finds another cell, with one that finds a new cell, and once more."""
    bank = C.LoggedBank(spark, scratch_path(spark, "bank"))
    e = table(spark, d, "embeddings")
    t = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    even = e.where("vec_id % 2 = 0")
    cells = even.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("weight"), F.col("label").cast("string").alias("label"), F.lit(0.3).alias("theta"), F.lit("single").alias("kind"), F.lit(0.0).alias("created_at"))
    bank.commit(bank.write({"cells": cells, "texts": t.where("vec_id % 2 = 0").select(F.col("vec_id").alias("cell_id"), "text")}))
    drafts = t.where("vec_id % 2 = 1").select(F.col("vec_id").alias("draft_id"), "text", F.lit("draft").alias("label"), F.col("embedding").alias("weight"), (F.length("text") >= 40).alias("accepted"))
    other = even.orderBy("vec_id").first()["embedding"]
    kept = governance.new_texts_only(drafts.where("accepted").select("draft_id", "text"), bank.table("texts"))
    own = drafts.join(kept.select("draft_id"), "draft_id", "left_semi").orderBy("draft_id").first()["weight"]
    out = C.commit_candidates(bank, drafts, "refused", other, 1)
    out = out.unionByName(C.commit_candidates(bank, drafts, "taken", own, 5))
    return out.unionByName(C.commit_candidates(bank, drafts, "again"))


def _plain_bank(spark, d):
    bank, logged = files.Bank(spark, scratch_path(spark, "plain")), _bank(spark, d)
    for name in ("cells", "texts", "edges"):
        bank.append(name, logged.table(name))
    return bank


@query("""SELECT count(*) AS n_cells, count(*) FILTER (vec_id % 10 = 9) AS n_bound, max(len(embedding))::INT AS dim, max(vec_id) AS last_id FROM embeddings""")
def bank_info(spark, d):
    return _plain_bank(spark, d).info()


@query("""SELECT vec_id AS cell_id, label::VARCHAR AS label, 'bound' AS kind FROM embeddings WHERE vec_id % 10 = 9 ORDER BY vec_id LIMIT 15 OFFSET 5""")
def bank_page(spark, d):
    """The second page of the bound cells."""
    return _plain_bank(spark, d).page(15, 5, "bound").select("cell_id", "label", "kind")


@query("""SELECT vec_id AS cell_id, 'bound' AS kind, md5(text) AS text_md5, array_to_string(list_sort(list_distinct([vec_id // 2, vec_id - 10])), ',') AS sources FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id = 59""")
def bank_cell(spark, d):
    """One cell with its text and what it rests on."""
    return _plain_bank(spark, d).cell(59).select("cell_id", "kind", F.md5("text").alias("text_md5"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("""SELECT doc_id, md5(text) AS text_md5 FROM documents""")
def base64_texts(spark, d):
    """Texts from their base64 payloads."""
    return table(spark, d, "documents").select("doc_id", F.md5(files.from_base64(F.base64(F.encode("text", "utf-8")))).alias("text_md5"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e)
SELECT vec_id, round(n, 5) AS norm, list_transform(v, lambda x: round(x / n, 5) + 0.0) AS unit, list_transform(v, lambda x: round(0.9 * x / n, 5) + 0.0) AS at_radius FROM n""")
def normal_vectors(spark, d):
    """Vectors of several lengths at unit length, and at the radius of the bank."""
    v = table(spark, d, "embeddings").select("vec_id", V.scale(F.col("embedding"), 1 + F.col("vec_id") % 5).alias("v"))
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 5) + 0.0)
    return v.select("vec_id", F.round(V.norm(F.col("v")), 5).alias("norm"), rounded(V.unit(F.col("v"))).alias("unit"), rounded(V.to_radius(F.col("v"), 0.9)).alias("at_radius"))
