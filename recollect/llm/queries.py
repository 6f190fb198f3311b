"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.decontaminate import find_contamination
from recollect.llm.delta_lloyd import delta_lloyd
from recollect.llm.hard_negatives import hard_negatives
from recollect.llm.jaccard_join import jaccard_components
from recollect.llm.license_scan import BASE, LEAST_PERCENT, RARE, TEMPLATES, WIDTH, needed, scan_licenses
from recollect.llm.line_dedup import drop_shared_lines
from recollect.llm.packing import pack_documents
from recollect.llm import pii, secrets
from recollect.llm.ppm import score_texts
from recollect.llm.quality_model import score_quality
from recollect.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from recollect.llm.warc import read_warc, write_warc
from recollect.session import scratch_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, payloads=False).select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), added_tokens=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _digest(spans: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans and the text of all."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return spans.select(
        "doc_id",
        *[F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the lines removed and the digest and length of the text that stays."""
    out = drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_shared_lines"), F.char_length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {"op1_warc": op1_warc, "op2_packing": op2_packing, "op3_decontamination": op3_decontamination, "op4_secrets": op4_secrets, "op5_pii": op5_pii, "op6_quality_rules": op6_quality_rules, "op7_quality_model": op7_quality_model, "op8_line_dedup": op8_line_dedup, "op9_jaccard_join": op9_jaccard_join, "op10_ppm": op10_ppm, "op11_license_scan": op11_license_scan, "op12_delta_lloyd": op12_delta_lloyd, "op13_hard_negatives": op13_hard_negatives}
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _rules_sql() -> str:
    """op6 in SQL, with its conditions from the same table of thresholds."""
    failed = ", ".join(
        f"CASE WHEN n_words >= {start} AND (" + " OR ".join([f"{m} < {low}"] * (low is not None) + [f"{m} > {high}"] * (high is not None)) + f") THEN '{m}' END" for m, low, high, start in RULES
    )
    count = lambda c, cond: f"len(list_filter({c}, lambda x: {cond}))"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} * 100.0 / {b} ELSE 0 END"
    stops = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    bare = f"trim(x, {_TRIM})"
    return rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {bare} <> '') AS l FROM documents),
v AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM a WHERE len(w) >= 8)), d AS (SELECT doc_id, p FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM d, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS lines, w, l FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
r AS (SELECT *, {ratio("n_repeat_words", "n_words")} AS repeat_word_percent, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbol_percent_of_words, {ratio("n_dup_lines", "lines")} AS dup_line_percent,
{ratio(count("l", f"regexp_matches({bare}, '^[•*-]')"), "lines")} AS bullet_line_percent, {ratio(count("l", f"regexp_matches({bare}, '([.][.][.]|…)$')"), "lines")} AS ellipsis_line_percent, {ratio(count("w", f"list_contains({stops}, lower(x))"), "n_words")} AS stop_word_percent,
{ratio(count("w", "x = upper(x) AND x <> lower(x) AND length(x) > 1"), "n_words")} AS upper_word_percent, {ratio(count("w", "x = '|'"), "n_words")} AS bar_percent_of_words, {ratio(count("w", "suffix(x, '!')"), "n_words")} AS exclaimed_word_percent FROM m),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules FROM f"""


def _licenses_sql() -> str:
    """op11 in SQL, with the same templates."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = ",\n".join(f"({k}, '{label}', {quoted(text.split())}, {quoted(sorted({w for p in must for w in p.split()}))}, {quoted(f' {p} ' for p in must)}, {quoted(f' {p} ' for p in never)}, {needed(text.split())})" for k, (label, text, must, never) in enumerate(TEMPLATES))
    base = " UNION ALL ".join(f"SELECT doc_id, p, '{label}' AS label FROM i WHERE w[p + 1:p + {len(p.split())}] = {quoted(p.split())}" for p, label in BASE)
    return rf"""WITH a AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(t, label, words, asked, must, never, need) AS MATERIALIZED (VALUES {rows}),
i AS MATERIALIZED (SELECT doc_id, w, unnest(range(len(w))) AS p FROM a), d AS (SELECT DISTINCT doc_id, w[p + 1] AS x FROM i), f AS (SELECT x, count(*) AS df FROM d GROUP BY x), v AS (SELECT DISTINCT x FROM (SELECT unnest(words) AS x FROM t)),
nn AS (SELECT count(*) AS n FROM a), r AS (SELECT v.x, n // (coalesce(df, 0) + 1) AS r FROM v LEFT JOIN f ON f.x = v.x CROSS JOIN nn), g AS MATERIALIZED (SELECT x, CASE WHEN r = 0 THEN 0 ELSE length(bin(r)) END AS weight FROM r), wt AS (SELECT u.t, greatest(1, sum(weight)) AS total FROM (SELECT DISTINCT t, unnest(words) AS x FROM t) u JOIN g ON g.x = u.x GROUP BY u.t),
k AS (SELECT a.doc_id, t.* FROM a JOIN t ON list_has_all(a.w, t.asked)), u AS (SELECT DISTINCT t, unnest(words) AS x FROM t), l AS (SELECT k.doc_id, k.t, u.x FROM k JOIN u ON u.t = k.t JOIN d ON d.doc_id = k.doc_id AND d.x = u.x JOIN g ON g.x = u.x QUALIFY row_number() OVER (PARTITION BY k.doc_id, k.t ORDER BY g.weight DESC, u.x) <= {RARE}),
q AS (SELECT t, unnest(words) AS x, unnest(range(len(words))) AS q FROM t), h AS (SELECT doc_id, w[p + 1] AS x, p FROM i),
b AS (SELECT l.doc_id, l.t, l.x, unnest([floor((p - q) / {WIDTH}) * {WIDTH}, floor((p - q + {WIDTH // 2}) / {WIDTH}) * {WIDTH} - {WIDTH // 2}])::BIGINT AS s, unnest([0, 1]) AS o FROM l JOIN h ON h.doc_id = l.doc_id AND h.x = l.x JOIN q ON q.t = l.t AND q.x = l.x),
c AS (SELECT doc_id, b.t, s, o FROM b JOIN t ON t.t = b.t GROUP BY doc_id, b.t, s, o HAVING count(DISTINCT x) >= any_value(need)),
y AS (SELECT c.doc_id, t.*, a.w[greatest(s, 0) + 1:s + len(words) + {2 * WIDTH}] AS part, ' ' || array_to_string(part, ' ') || ' ' AS said FROM c JOIN t ON t.t = c.t JOIN a ON a.doc_id = c.doc_id),
z AS (SELECT DISTINCT y.doc_id, y.t, label, words, part FROM y WHERE len(list_filter(must, lambda m: contains(said, m))) = len(must) AND len(list_filter(never, lambda m: contains(said, m))) = 0),
zz AS (SELECT doc_id, t, label, part, unnest(list_distinct(words)) AS x FROM z), m AS (SELECT doc_id, label, sum(weight) FILTER (list_contains(part, zz.x)) AS got, any_value(total) AS total FROM zz JOIN g ON g.x = zz.x JOIN wt ON wt.t = zz.t GROUP BY doc_id, zz.t, label, part HAVING got * 100 >= any_value(total) * {LEAST_PERCENT}), o AS ({base}), bb AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM o GROUP BY doc_id),
j AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM o) GROUP BY doc_id), e AS (SELECT doc_id, max(got / total) AS share FROM m GROUP BY doc_id)
SELECT a.doc_id, len(a.w)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, bb.a::BIGINT AS first_word, bb.z::BIGINT AS last_word, coalesce(bb.labels, '') AS base_labels, coalesce(j.labels, '') AS labels, greatest(coalesce(e.share, 0), CASE WHEN bb.n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM a LEFT JOIN bb ON bb.doc_id = a.doc_id LEFT JOIN j ON j.doc_id = a.doc_id LEFT JOIN e ON e.doc_id = a.doc_id"""


_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """op12 in SQL, a few tables per round."""
    out = [f"v AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = {dims})", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v ORDER BY h, v LIMIT {k}))"]
    distance = "list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m)"
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(s) AS s FROM (SELECT vec_id, v, {{'d': ({distance})::BIGINT, 'c': c}} AS s FROM v, c{r}) GROUP BY vec_id)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS t, count(*) AS n FROM (SELECT s.c AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(((t - ((t % n) + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM s{r} GROUP BY c) n ON n.c = c{r}.c)")
    return f"WITH {', '.join(out)} SELECT vec_id, s.c::INTEGER AS cluster, s.d AS distance, (sum(s.d) OVER (PARTITION BY s.c))::BIGINT AS cluster_inertia, (sum(s.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = s.c"


_NEGATIVES_SQL = f"""WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS s FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, (row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.s DESC, s.c))::INTEGER AS rank, s.c AS negative_id, p.s AS positive_score, s.s AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s QUALIFY rank <= 10"""


# Where SQL can say the same. The others are tested against plain versions in tests/llm.
ORACLES: dict[str, str] = {
    "op1_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM r""",
    "op6_quality_rules": _rules_sql(),
    "op11_license_scan": _licenses_sql(),
    "op12_delta_lloyd": _lloyd_sql(),
    "op13_hard_negatives": _NEGATIVES_SQL,
    "op8_line_dedup": r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l), c AS (SELECT * FROM k WHERE len(regexp_extract_all(key, '[^\x20\x09-\x0D]+')) >= 3),
s AS (SELECT key, min(doc_id) AS first FROM c GROUP BY key HAVING count(DISTINCT source) >= 3), g AS (SELECT c.doc_id, c.pos FROM c JOIN s USING (key) QUALIFY c.doc_id <> s.first OR row_number() OVER (PARTITION BY key, c.doc_id ORDER BY c.pos) > 1),
o AS (SELECT k.doc_id, count(g.pos) AS n, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (g.pos IS NULL), '') AS t FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.pos = g.pos GROUP BY k.doc_id)
SELECT doc_id, n AS n_shared_lines, length(t) AS chars_left, md5(t) AS text_md5 FROM o""",
    "op9_jaccard_join": r"""WITH RECURSIVE a AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM a WHERE len(w) > 0)),
n AS (SELECT a.doc_id, count(g) AS n FROM a LEFT JOIN s ON a.doc_id = s.doc_id GROUP BY a.doc_id), p AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
k AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 80 * (a.n + b.n - c)), e AS (SELECT i, j FROM k UNION ALL SELECT j, i FROM k), r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.doc_id)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(root) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
