"""Queries over instructions: their intents, the plans made of them, and what applying these leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import intents as I
from recollect.operators import mutation
from recollect.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


#: Instructions made of conversations: seq and text, in eight forms.
_MADE = """ins AS (
  SELECT conv_id * 1000 + turn AS seq, CASE (conv_id + turn) % 8
    WHEN 0 THEN 'remove ' || (conv_id % 40) || ': stale entry ' || turn
    WHEN 1 THEN 'Remember that ' || text
    WHEN 2 THEN '  show provenance '
    WHEN 3 THEN 'tombstone cell ' || (conv_id % 7) || ' because it is wrong'
    WHEN 4 THEN text
    WHEN 5 THEN 'note: "' || text || '"'
    WHEN 6 THEN 'remove ' || conv_id
    ELSE 'please forget mem_' || conv_id END AS text FROM conversations)"""


def _instructions(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    n = F.col("conv_id").cast("string")
    forms = {
        0: F.concat(F.lit("remove "), (F.col("conv_id") % 40).cast("string"), F.lit(": stale entry "), F.col("turn").cast("string")),
        1: F.concat(F.lit("Remember that "), F.col("text")),
        2: F.lit("  show provenance "),
        3: F.concat(F.lit("tombstone cell "), (F.col("conv_id") % 7).cast("string"), F.lit(" because it is wrong")),
        4: F.col("text"),
        5: F.concat(F.lit('note: "'), F.col("text"), F.lit('"')),
        6: F.concat(F.lit("remove "), n),
        7: F.concat(F.lit("please forget mem_"), n),
    }
    form = (F.col("conv_id") + F.col("turn")) % 8
    text = F.when(form == 0, forms[0])
    for k in range(1, 8):
        text = text.when(form == k, forms[k])
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), text.alias("text"))


_TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
# The grammar as RE2 says it, written out once more.
_PARSED = r"""st AS (SELECT seq, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM ins),
rm AS (
  SELECT seq, t, regexp_matches(t, '(?i)^(tombstone|remove|delete|drop)\s+(cell\s+)?\d+\s*([:,-]|\s(because|reason)\s)\s*\S.*$') AS removes,
    regexp_matches(t, '(?i)^(show|list|inspect|print)\s+provenance$') AS inspects,
    trim(trim(regexp_extract(t, '(?i)^(remember|add|note|record|store)(\s+that)?\s*:?\s*(\S.+)$', 3)), '"“”‘’') AS payload,
    regexp_extract(t, '(?i)^(tombstone|remove|delete|drop)\s+(cell\s+)?(\d+)', 3) AS cell,
    regexp_extract(t, '(?i)^\S+\s+(cell\s+)?\d+\s*([:,-]|\s(because|reason)\s)\s*(\S.*)$', 4) AS reason FROM st),
pa AS (
  SELECT seq, t, CASE WHEN removes THEN 'remove' WHEN inspects THEN 'inspect' WHEN payload <> '' THEN 'add' ELSE 'unknown' END AS kind,
    CASE WHEN removes THEN cell::BIGINT END AS cell_id, CASE WHEN removes THEN reason END AS reason, CASE WHEN NOT removes AND NOT inspects AND payload <> '' THEN payload END AS text,
    CASE WHEN t = '' THEN 'empty instruction' WHEN NOT removes AND NOT inspects AND payload = '' THEN 'no known form' END AS note FROM rm)"""


@query(f"""WITH {_MADE}, {_PARSED} SELECT seq, kind, cell_id, reason, text, note FROM pa""")
def instruction_intents(spark, d):
    return _instructions(spark, d).select("seq", I.instruction(F.col("text")).alias("i")).select("seq", "i.*")


_WRITTEN = r"""coalesce(nullif(trim(rtrim(regexp_replace(t, '(?i)^\s*(please\s+)?(log|memorise|memorize|note|record|remember|save|store)(\s+that)?[:,]?\s*', ''), ' .')), ''), t)"""


def _routed(deletes: str, binds: str, writes: str, asks: str) -> str:
    return f"""WITH {_MADE}, st AS (SELECT seq, {_TRIMMED} AS t, regexp_extract_all(lower({_TRIMMED}), '[a-z0-9'']+') AS w FROM ins),
ru AS (SELECT seq, t, {deletes} AS del, {binds} AS bin, {writes} AS wri, {asks} AS ask, nullif(regexp_extract(t, '\\b(mem[-_][0-9a-zA-Z]+)\\b', 1), '') AS mem FROM st)
SELECT seq, CASE WHEN del THEN 'delete' WHEN bin THEN 'bind' WHEN wri THEN 'write' WHEN t <> '' THEN 'query' ELSE 'unknown' END AS intent,
  (CASE WHEN del AND mem IS NOT NULL THEN 0.9 WHEN del THEN 0.5 WHEN bin THEN 0.7 WHEN wri THEN 0.85 WHEN ask THEN 0.8 WHEN t <> '' THEN 0.4 ELSE 0.0 END)::DOUBLE AS confidence,
  CASE WHEN del THEN mem END AS memory_id, CASE WHEN wri AND NOT del AND NOT bin THEN {_WRITTEN} END AS to_write FROM ru"""


_ANY = "len(list_filter(w, lambda x: x IN ({}))) > 0"


@query(
    _routed(
        _ANY.format("'delete', 'forget', 'remove', 'erase', 'unlearn', 'drop'"),
        _ANY.format("'bind', 'group', 'link', 'associate', 'combine', 'connect', 'merge'"),
        _ANY.format("'remember', 'note', 'store', 'save', 'memorize', 'memorise', 'record', 'log'"),
        "coalesce(w[1] IN ('what', 'who', 'when', 'where', 'why', 'how', 'which', 'whose', 'whom'), false) OR suffix(t, '?')",
    )
)
def keyword_intents(spark, d):
    return _instructions(spark, d).select("seq", I.by_keywords(F.col("text")).alias("i")).select("seq", "i.*")


@query(
    _routed(
        r"regexp_matches(t, '(?i)\b(delete|forget|remove|unlearn|erase)\b')",
        r"regexp_matches(t, '(?i)\b(bind|group|link|associate|combine)\b')",
        r"regexp_matches(t, '(?i)\b(remember|note that|store|save|memorise|memorize|keep in mind)\b')",
        r"regexp_matches(t, '(?i)\b(what|who|when|where|why|how|which|recall)\b|\bdo you (remember|know)\b|[?]\s*$')",
    )
)
def pattern_intents(spark, d):
    return _instructions(spark, d).select("seq", I.by_patterns(F.col("text")).alias("i")).select("seq", "i.*")


#: Cells of some part that are removed before the batch.
_GONE = "gone AS (SELECT vec_id AS cell_id, 'earlier' AS reason FROM embeddings WHERE vec_id % 3 = 0 AND vec_id < 40)"
_PLANNED = f"""{_MADE}, {_PARSED}, {_GONE}, pl AS (
  SELECT seq, kind AS op, pa.cell_id, pa.reason, text, CASE WHEN kind = 'unknown' THEN note END AS block_reason, CASE WHEN kind = 'remove' THEN gone.reason END AS prior_reason
  FROM pa LEFT JOIN gone ON pa.cell_id = gone.cell_id)"""


def _plans(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    gone = e.where("vec_id % 3 = 0 AND vec_id < 40").select(F.col("vec_id").alias("cell_id"), F.lit("earlier").alias("reason"))
    top = e.agg(F.max("vec_id")).first()[0]
    return mutation.planned(_instructions(spark, d), gone, base_max=top, anchor=top)


@query(f"""WITH {_PLANNED} SELECT seq, op, cell_id, reason, text, block_reason IS NOT NULL AS blocked, block_reason, prior_reason FROM pl""")
def memory_plans(spark, d):
    return _plans(spark, d)


_APPLIED = f"""{_PLANNED}, top AS (SELECT max(vec_id) AS x FROM embeddings),
ad AS (SELECT seq, text, x + row_number() OVER (ORDER BY seq) AS new_id FROM pl, top WHERE op = 'add' AND block_reason IS NULL)"""


@query(f"""WITH {_APPLIED}
SELECT pl.seq, op, block_reason IS NULL AS applied, CASE WHEN block_reason IS NULL THEN coalesce(new_id, cell_id) END AS cell_id,
  CASE WHEN op IN ('add', 'remove') THEN true END AS present, CASE WHEN op IN ('add', 'remove') THEN true END AS same, CASE WHEN op IN ('add', 'remove') THEN true END AS logged, block_reason IS NULL AS ok
FROM pl LEFT JOIN ad ON pl.seq = ad.seq""")
def memory_changes(spark, d):
    """All instructions applied as one batch and read back: whatever was not blocked must have left what it says."""
    plans = _plans(spark, d)
    top = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    made = mutation.applied(plans, top)
    return mutation.read_back(plans, made["cells"], made["tombstones"], made["log"])


@query(f"""WITH {_APPLIED}, lg AS (
  SELECT seq, op, coalesce(new_id, cell_id) AS cell_id, CASE WHEN op = 'add' THEN pl.text ELSE reason END AS detail FROM pl LEFT JOIN ad USING (seq) WHERE op IN ('add', 'remove') AND block_reason IS NULL)
SELECT 'log' AS kind, cell_id, op || ':' || detail AS detail, seq FROM lg UNION ALL SELECT 'tombstone', cell_id, arg_max(detail, seq), max(seq) FROM lg WHERE op = 'remove' GROUP BY cell_id""")
def memory_state(spark, d):
    """The log and the tombstones after the batch."""
    made = mutation.applied(_plans(spark, d), table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0])
    log = made["log"].select(F.lit("log").alias("kind"), "cell_id", F.concat("op", F.lit(":"), "detail").alias("detail"), "seq")
    return log.unionByName(made["tombstones"].select(F.lit("tombstone").alias("kind"), "cell_id", F.col("reason").alias("detail"), "seq"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 200 <> 100)
SELECT 1000 + row_number() OVER (ORDER BY vec_id) AS cell_id, label, 'text ' || vec_id AS source_text, list_transform(x, lambda c: round(c / n, 5) + 0.0) AS weight, 0.3::DOUBLE AS theta FROM v""")
def written_cells(spark, d):
    """New cells of a batch of encoded texts; some have a vector without length, which makes no cell."""
    e = table(spark, d, "embeddings").where("vec_id % 20 = 0")
    vector = F.when(F.col("vec_id") % 200 == 100, F.transform("embedding", lambda c: F.lit(0.0))).otherwise(F.transform("embedding", lambda c: c.cast("double")))
    rows = e.select(F.col("vec_id").alias("order"), "label", F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), vector.alias("vector"))
    return mutation.written(rows, 1000).withColumn("weight", F.transform("weight", lambda c: F.round(c, 5) + 0.0))
