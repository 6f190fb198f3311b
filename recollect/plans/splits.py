"""Queries over splits, token arrays and text rules of corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import corpus
from recollect.operators import splits as S
from recollect.plans.dense import RANKED, _ranked
from recollect.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


_TITLE = r"lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')))"


@query(f"""WITH t AS (SELECT page_id, {_TITLE} AS title FROM pages), b AS (SELECT DISTINCT title FROM t WHERE page_id % 2 = 0 AND title <> ''), c AS (SELECT DISTINCT title FROM t WHERE page_id % 2 = 1 AND title <> ''), x AS (SELECT title FROM b INTERSECT SELECT title FROM c)
SELECT (SELECT count(*) FROM b) AS n_bank, (SELECT count(*) FROM c) AS n_corpus, (SELECT count(*) FROM x) AS n_shared, (SELECT min(title) FROM x) AS first_shared""")
def title_overlap(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    return S.title_overlap(S.titles(pages.where("page_id % 2 = 0"), "t"), S.titles(pages.where("page_id % 2 = 1"), "t"))


@query(r"""WITH RECURSIVE j AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '-\n(\S)', '\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda c: trim(replace(c, chr(10), ' '), ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) AS block, unnest(range(len(regexp_split_to_array(t, '\n\s*\n')))) AS k FROM j),
f AS (
  SELECT doc_id, k, string_split(regexp_replace(block, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sents, 0 AS i, '' AS open, NULL::VARCHAR AS closed FROM b WHERE length(block) > 800
  UNION ALL
  SELECT doc_id, k, sents, i + 1, CASE WHEN length(open) + length(s) + 1 > 800 AND length(open) >= 80 THEN s ELSE trim(open || ' ' || s) END, CASE WHEN length(open) + length(s) + 1 > 800 AND length(open) >= 80 THEN trim(open) END
  FROM (SELECT *, sents[i + 1] AS s FROM f WHERE i < len(sents))),
a AS (
  SELECT doc_id, k, i, closed AS para FROM f WHERE closed IS NOT NULL UNION ALL SELECT doc_id, k, 1000000, trim(open) FROM f WHERE i = len(sents) AND length(open) >= 80
  UNION ALL
  SELECT doc_id, k, 0, block FROM b WHERE length(block) BETWEEN 80 AND 800 AND NOT regexp_matches(block, '^\s*\d+\s*$') AND NOT regexp_matches(block, '(?i)^(figure|table|fig\.|tab\.)\s+\d') AND NOT regexp_matches(block, '(?i)^\s*(references|abstract|acknowledgements?)\s*$')
    AND NOT regexp_matches(block, '^\s*https?://') AND NOT regexp_matches(block, '^[•●■▪►▸–—-]\s') AND NOT (regexp_matches(block, '^\[?\d{1,3}\]?\s*[A-Z][a-z]+') AND contains(lower(block), 'doi')))
SELECT d.doc_id, count(para)::INT AS n_paragraphs, md5(coalesce(string_agg(para, '|' ORDER BY k, i), '')) AS paragraphs_md5 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY d.doc_id""")
def page_paragraphs(spark, d):
    p = table(spark, d, "documents").select("doc_id", S.page_paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_paragraphs"), F.md5(F.array_join("p", "|")).alias("paragraphs_md5"))


@query("""SELECT doc_id, substring(trim(text), 1, 300) AS text FROM documents WHERE length(trim(text)) > 40 AND NOT starts_with(trim(text), '=') ORDER BY sha1(concat('3:', doc_id)), doc_id LIMIT 50""")
def loaded_paragraphs(spark, d):
    return S.loaded_paragraphs(table(spark, d, "documents"), "text", "doc_id", 50, 40, 300, seed=3)


@query("""WITH u AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text), s AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(concat('1:', doc_id)), doc_id) AS r FROM u)
SELECT doc_id, CASE WHEN r <= 60 THEN 'train' ELSE 'test' END AS part FROM s WHERE r <= 90""")
def distinct_split(spark, d):
    return S.distinct_split(table(spark, d, "documents"), "text", "doc_id", 60, 30, seed=1)


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(concat('0:', doc_id)), doc_id) AS r, row_number() OVER (ORDER BY doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 0.05) THEN 'val' ELSE 'train' END AS row_part, CASE WHEN p > n - floor(n * 0.1) THEN 'val' ELSE 'train' END AS position_part, p > 30 AND p <= 80 AS held_out FROM s""")
def corpus_parts(spark, d):
    """Each document's part in a split by shuffled rows, in one by position, and whether it lies in the held-out range."""
    docs = table(spark, d, "documents").select("doc_id")
    held = S.held_out_range(docs, "doc_id", 30, 50).withColumn("held_out", F.lit(True))
    parts = S.row_split(docs, "doc_id").withColumnRenamed("part", "row_part").join(S.positional_split(docs, "doc_id").withColumnRenamed("part", "position_part"), "doc_id")
    return parts.join(held, "doc_id", "left").select("doc_id", "row_part", "position_part", F.coalesce("held_out", F.lit(False)).alias("held_out"))


# Token arrays: the lengths of a text's words, the end of a turn as the end of text.
@query(r"""WITH w AS (SELECT conv_id, turn, list_concat(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: length(x)::INT), [50256]) AS t FROM conversations), p AS (SELECT conv_id AS doc_id, turn AS piece, len(t) AS n FROM w)
SELECT doc_id, piece, n::BIGINT AS n FROM p WHERE n > 10""")
def pieces_at_ends(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array_append(F.transform(words, F.length), F.lit(50256))).alias("i", "token"))
    return S.pieces_at(t.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 1_000_000 + F.col("i")).alias("pos"), "token"), 50256)


@query(r"""WITH w AS (SELECT conv_id, turn, text, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) < 3 THEN 0 ELSE length(x) END::INT) AS t FROM conversations)
SELECT conv_id, turn, len(t) = 0 OR len(list_filter(t, lambda x: x IN (0, 50256))) >= 0.3 * len(t) AS low_information, md5(CASE WHEN len(list_filter(t, lambda x: x <> 50256)) < 8 THEN 'prompt' ELSE text END) AS asks_with,
  CASE WHEN length(trim(string_split(text, '. ')[1])) BETWEEN 20 AND 400 THEN trim(string_split(text, '. ')[1]) END AS probe, (len(t) // 16 * 16)::INT AS whole,
  list_concat(list_slice([1, 2, 3, 4, 5], 1, turn % 6), [99], list_slice([1, 2, 3, 4, 5], turn % 6 + 1, 5))::INT[] AS rotated FROM w""")
def token_rules(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    c = table(spark, d, "conversations").withColumn("t", F.transform(words, lambda x: F.when(F.length(x) < 3, 0).otherwise(F.length(x))))
    five = F.array(*map(F.lit, range(1, 6)))
    return c.select(
        "conv_id",
        "turn",
        S.low_information(F.col("t"), 0.3).alias("low_information"),
        F.md5(S.retrieval_text(F.col("t"), F.col("text"), F.lit("prompt"))).alias("asks_with"),
        S.known_probe(F.col("text")).alias("probe"),
        F.size(S.whole_chunks(F.col("t"), 16)).alias("whole"),
        S.placed_at(five, F.lit(99), (F.col("turn") % 6).cast("int"), 6).alias("rotated"),
    )


@query("""WITH a AS (SELECT conv_id, array_to_string(list_transform(list_filter(list({'id': turn, 'text': CASE WHEN turn % 3 <> 1 THEN text END} ORDER BY turn), lambda c: c.text IS NOT NULL), lambda c: '[' || c.id || '] ' || c.text), chr(10)) AS facts,
  array_to_string(list_filter(list(CASE WHEN turn % 3 <> 1 THEN '[' || (turn + 1) || '] ' || text END ORDER BY turn), lambda x: x IS NOT NULL), chr(10)) AS passages,
  array_to_string(list_transform(list_filter(list({'id': turn, 'text': CASE WHEN turn % 3 <> 1 THEN text END} ORDER BY turn), lambda c: c.text IS NOT NULL), lambda c: '- (' || c.id || ') ' || c.text), chr(10)) AS body FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('FACTS:' || chr(10) || facts || chr(10) || chr(10) || 'QUESTION: why?' || chr(10) || chr(10) || 'Answer using only the FACTS above, with citations.') AS prompt_md5, md5(passages) AS passages_md5, md5('From memory:' || chr(10) || body) AS answer_md5 FROM a""")
def prompts_and_answers(spark, d):
    cell = F.struct(F.col("turn").alias("cell_id"), F.when(F.col("turn") % 3 != 1, F.col("text")).alias("text"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return c.select("conv_id", F.md5(S.facts_prompt(F.lit("why?"), F.col("cells"))).alias("prompt_md5"), F.md5(S.passages(F.col("cells"))).alias("passages_md5"), F.md5(S.memory_answer(F.col("cells"))["text"]).alias("answer_md5"))


@query("""SELECT label::INT AS list_id, list(CASE WHEN vec_id % 3 <> 2 THEN vec_id * 2 END ORDER BY (vec_id * 7919) % 1009, vec_id) AS "values" FROM embeddings GROUP BY label""")
def ordered_lookup(spark, d):
    """What belongs to each of a list's ids, in the list's own order."""
    e = table(spark, d, "embeddings")
    lists = e.groupBy(F.col("label").alias("list_id")).agg(F.array_sort(F.collect_list(F.struct(((F.col("vec_id") * 7919) % 1009).alias("o"), "vec_id"))).alias("s")).select("list_id", F.transform("s", lambda x: x["vec_id"]).alias("ids"))
    return S.ordered_lookup(lists, e.where("vec_id % 3 <> 2").select("vec_id", (F.col("vec_id") * 2).alias("twice")), "vec_id", "twice")


@query("""SELECT item_id, substring(trim(text) || chr(10) || chr(10) || trim(reverse(text)), 1, 200) AS text, '[code] ' || substring(trim(text), 1, 80) AS label FROM benchmark WHERE length(trim(reverse(text))) >= 160""")
def coding_items(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("instruction"), F.reverse("text").alias("output"))
    return S.coding_items(rows, 160, 200).select("item_id", "text", "label")


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) SELECT char, (row_number() OVER (ORDER BY hex(encode(char))) - 1)::INT AS id FROM c WHERE char <> ''""")
def alphabet(spark, d):
    return S.characters(table(spark, d, "benchmark"), "text")


@query("""WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY sha1(concat('5:', vec_id)), vec_id) AS r FROM embeddings) SELECT vec_id, CASE WHEN r <= 50 THEN 'fit' ELSE 'eval' END AS part FROM s WHERE r <= 100""")
def sample_halves(spark, d):
    return S.halves(table(spark, d, "embeddings"), "vec_id", 100, seed=5)


@query(r"""WITH l AS (SELECT DISTINCT lower(trim(regexp_replace(source || ' ' || lang, '\s+', ' ', 'g'))) AS t FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 5)) SELECT max(doc_id) AS resume_after FROM documents WHERE doc_id % 3 = 0 AND lower(source || ' ' || lang) IN (SELECT t FROM l)""")
def resume_point(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("t"))
    return S.resume_point(docs.select(F.col("doc_id").alias("cell_id"), F.upper("t").alias("label")), docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("idx"), F.col("t").alias("title")), 5)


@query(f"""WITH {RANKED.format(n=4)}, t AS (SELECT vec_id AS cell_id, [vec_id * 2, label]::BIGINT[] AS tokens FROM embeddings WHERE vec_id % 5 <> 2) SELECT query_id AS chunk_id, list(tokens ORDER BY rank) AS neighbors FROM r LEFT JOIN t ON r.cell_id = t.cell_id GROUP BY query_id""")
def gathered_neighbors(spark, d):
    """The tokens of each query's four best cells; some cells have none."""
    found = _ranked(spark, d, 4).select(F.col("query_id").alias("chunk_id"), F.col("rank").alias("slot"), "cell_id")
    tokens = table(spark, d, "embeddings").where("vec_id % 5 <> 2").select(F.col("vec_id").alias("cell_id"), F.array((F.col("vec_id") * 2).cast("long"), F.col("label").cast("long")).alias("tokens"))
    return S.gathered(found, tokens)


@query(f"""WITH {RANKED.format(n=3)}, n AS (SELECT query_id AS chunk_id, list(cell_id ORDER BY rank) AS real FROM r GROUP BY query_id)
SELECT chunk_id, 'none' AS mode, list_transform(real, lambda c: NULL::BIGINT) AS neighbors FROM n UNION ALL SELECT chunk_id, 'real', real FROM n UNION ALL SELECT chunk_id, 'real1', list_transform(real, lambda c: real[1]) FROM n
UNION ALL SELECT chunk_id, 'random', list_transform(real, lambda c, i: ('0x' || substring(md5('0:' || chunk_id || ':' || (i - 1)), 1, 8))::BIGINT % 500) FROM n""")
def neighbor_modes(spark, d):
    found = _ranked(spark, d, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cell_id"))).alias("s"))
    return S.neighbor_modes(found.select(F.col("query_id").alias("chunk_id"), F.transform("s", lambda x: x["cell_id"]).alias("neighbors")), 500)


@query("""SELECT doc_id AS cell_id, lang, 'first' AS source FROM documents WHERE lang = 'en' UNION ALL SELECT page_id + (SELECT max(doc_id) + 1 FROM documents WHERE lang = 'en'), 'xx', 'second' FROM pages""")
def joined_sources(spark, d):
    return S.joined_sources(table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("cell_id"), "lang"), table(spark, d, "pages").select(F.col("page_id").alias("cell_id"), F.lit("xx").alias("lang")))


@query(f"""WITH {RANKED.format(n=10)}, x AS (SELECT DISTINCT query_id, query_id + (query_id // 100) % 2 AS target FROM r) SELECT x.query_id, x.target, min(rank)::INT AS rank FROM x LEFT JOIN r ON r.query_id = x.query_id AND r.cell_id = x.target GROUP BY ALL""")
def truth_ranks(spark, d):
    """The rank of the cell that each query should find: its own, or for each second one the next."""
    found = _ranked(spark, d, 10)
    i = F.col("query_id")
    return S.truth(found, found.select("query_id", (i + F.floor(i / 100) % 2).alias("target")).distinct())


@query("""WITH w AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM documents), z AS (SELECT * FROM (VALUES ('en', 0.5), ('de', 0.3), ('fr', 0.2)) t(lang, share)), b AS (SELECT sum(n) // 4 AS budget FROM w),
p AS (SELECT w.*, floor(share * budget)::BIGINT AS quota, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM w JOIN z USING (lang), b) SELECT lang, doc_id, n, start, quota FROM p WHERE start < quota""")
def corpus_mixture(spark, d):
    """Documents of three languages under a budget of a quarter of all words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = table(spark, d, "documents").select(F.col("lang").alias("source"), "doc_id", F.size(words).cast("long").alias("n"))
    budget = w.agg(F.sum("n")).first()[0] // 4
    return corpus.mixture_fill(w, {"en": 0.5, "de": 0.3, "fr": 0.2}, budget, ["doc_id"]).select(F.col("source").alias("lang"), "doc_id", "n", "start", "quota")


@query("""WITH c AS (SELECT char, (row_number() OVER (ORDER BY hex(encode(char))) - 1) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''), m AS (SELECT map(list(char), list(id)) AS codes FROM c),
t AS (SELECT item_id, text, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(length(text)) OVER () AS total FROM benchmark)
SELECT item_id, start, md5(array_to_string(list_transform(string_split(text, ''), lambda x: codes[x]), ',')) AS codes_md5, greatest(least(n, total - floor(total * 0.1) - start), 0)::BIGINT AS n_train FROM t, m""")
def character_codes(spark, d):
    """Benchmark items as numbers of their alphabet, nine tenths of the characters to train on."""
    return S.character_codes(table(spark, d, "benchmark"), "item_id", "text").select("item_id", "start", F.md5(F.array_join("codes", ",")).alias("codes_md5"), "n_train")
