"""Queries over real token streams, written by the data source and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.tokens import token_ids, token_texts
from recollect.operators import retrieval as R
from recollect.operators import splits as S
from recollect.operators import token_chunks as T
from recollect.session import release, scratch_path, small_batches, stored, table
from recollect.sources.token_files import read_cells, read_token_cells, write_sorted_cells, write_token_cells

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _stream(spark, d, cells):
    folder = scratch_path(spark, "stream")
    write_token_cells(cells, folder)
    return read_token_cells(spark, folder, 64)


def _document_tokens(spark, d):
    return token_ids(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "cell_id")


def _said(spark, docs, result, name):
    """What `result` makes of cell_id and text, as the token files of `docs` say them; the files go when it is stored.

    Documents are sorted before tokens are made, so that texts are dealt once and tokens only written.
    """
    with small_batches(spark):
        dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        folder = scratch_path(spark, "stream")
        write_sorted_cells(token_ids(dealt, "doc_id", "text").withColumnRenamed("doc_id", "cell_id"), folder)
        back = read_cells(spark, folder)
        out = stored(result(token_texts(back, "cell_id")), name)
        release(back)
    return out


@query("SELECT doc_id, md5(coalesce(text, '') || '<|endoftext|>') AS text_md5 FROM documents")
def token_files_round_trip(spark, d):
    """What the token files of all documents say, document by document."""
    return _said(spark, table(spark, d, "documents"), lambda said: said.select(F.col("cell_id").alias("doc_id"), F.md5("text").alias("text_md5")), "said")


@query("""WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY sha1(concat('0:', doc_id)), doc_id) AS r, count(*) OVER () AS n FROM documents), p AS (SELECT doc_id, coalesce(text, '') || '<|endoftext|>' AS text, CASE WHEN r <= floor(n * 0.05) THEN 'val' ELSE 'train' END AS part FROM s)
SELECT part, count(*) AS n_cells, sum(length(text))::BIGINT AS n_chars, sum(('0x' || substring(md5(doc_id || ':' || text), 1, 8))::BIGINT)::BIGINT AS digest FROM p GROUP BY part""")
def token_split_files(spark, d):
    """Each part of a split by shuffled cells as token files of its own: its cells, the characters that its stream says, and a sum of hashes of its cells' ids and texts."""
    docs, out = table(spark, d, "documents"), None
    is_val = S.in_first_share(docs.select("doc_id"), "doc_id")
    hashed = F.conv(F.substring(F.md5(F.concat("cell_id", F.lit(":"), "text")), 1, 8), 16, 10).cast("long")

    def counts(said):
        each = said.select(F.length("text").cast("long").alias("n"), hashed.alias("h"))
        return each.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_chars"), F.sum("h").alias("digest")).where("n_cells > 0")

    for part, rows in (("train", docs.where(~is_val)), ("val", docs.where(is_val))):
        one = _said(spark, rows, counts, part).select(F.lit(part).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def held_out_chunks(spark, d):
    """Chunks of 64 tokens of the paragraphs of a range of articles, without the rest at the end."""
    chunks = _stream(spark, d, T.held_out_tokens(table(spark, d, "documents").select("doc_id", "text"), 30, 50))
    return chunks.select("chunk_id", "tokens", F.size(F.array_distinct("cells")).alias("n_paragraphs"))


def _neighbors(spark, d, exclude):
    chunks = _stream(spark, d, _document_tokens(spark, d))
    cells = R.as_cells(table(spark, d, "embeddings"))
    asked = T.chunk_queries(chunks, cells.select("cell_id", F.col("weight").alias("vector")))
    return T.chunk_neighbors(chunks.where(F.col("chunk_id") % 100 == 0), cells, asked, 2, exclude)


@query()
def chunk_neighbors_excluded(spark, d):
    """Two neighbours of each chunk whose number is divisible by 100, without the cells that it has tokens of."""
    return _neighbors(spark, d, True)


@query()
def chunk_neighbors_all(spark, d):
    """The same with no cell left out."""
    return _neighbors(spark, d, False)
