"""Chunks of real token streams: where a cell's tokens are, chunks of held-out articles, and neighbours of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import paragraphs
from recollect.functions.tokens import token_ids
from recollect.operators import corpus
from recollect.operators import retrieval as R


def cell_pieces(chunks: DataFrame) -> DataFrame:
    """chunks: chunk_id, tokens, cells (ordered). Each run of a chunk that is of one cell: cell_id, chunk_id, offset, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, tokens, cells = batch.columns
            row, cell = pc.list_parent_indices(cells).to_numpy(zero_copy_only=False), cells.flatten().to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])])) if len(cell) else np.zeros(0, np.int64)
            offset = begins - np.searchsorted(row, row[begins])
            pieces = pa.ListArray.from_arrays(pa.array(np.append(begins, len(cell)), pa.int32()), tokens.flatten())
            yield pa.RecordBatch.from_arrays([cells.flatten().take(pa.array(begins)), chunk.take(pa.array(row[begins])), pa.array(offset, pa.int32()), pieces], names=["cell_id", "chunk_id", "offset", "tokens"])

    kind = lambda c: chunks.schema[c].dataType
    schema = f"cell_id {kind('cells').elementType.simpleString()}, chunk_id {kind('chunk_id').simpleString()}, offset int, tokens {kind('tokens').simpleString()}"
    return chunks.select("chunk_id", "tokens", "cells").mapInArrow(run, schema)


def cell_tokens(chunks: DataFrame) -> DataFrame:
    """The tokens of each cell, from all of its pieces: cell_id, tokens. A row is as long as its cell."""
    g = cell_pieces(chunks).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "offset", "tokens"))).alias("p"))
    return g.select("cell_id", F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"))


def fixed_tokens(cells: DataFrame, length: int = 64, pad: int = 50256) -> DataFrame:
    """cells: cell_id, tokens. cell_id and exactly `length` tokens: the first ones, or all and then `pad`."""
    t = F.col("tokens")
    return cells.select("cell_id", F.concat(F.slice(t, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(t), F.lit(0)))).alias("tokens"))


def article_paragraphs(articles: DataFrame, skip: int, take: int, min_chars: int) -> DataFrame:
    """articles: doc_id, text. The paragraphs of `min_chars` or more (divided by empty lines, white space collapsed) of the articles in the range, in order: paragraph_id, doc_id, text."""
    rank = corpus.running_sums(articles.select("doc_id", "text", F.lit(1).cast("long").alias("_one")), ["doc_id"], "_one")
    held = rank.where((F.col("start") >= skip) & (F.col("start") < skip + take))
    each = held.select("doc_id", F.posexplode(paragraphs(F.col("text"), r"\n\n", min_chars)).alias("k", "text"))
    placed = corpus.running_sums(each.withColumn("_one", F.lit(1).cast("long")), ["doc_id", "k"], "_one")
    return placed.select(F.col("start").alias("paragraph_id"), "doc_id", "text")


def held_out_tokens(articles: DataFrame, skip: int, take: int, min_chars: int = 80) -> DataFrame:
    """cell_id (the paragraph's number) and tokens, each paragraph closed by an end; chunks of the stream that they make leave out the rest that fills none."""
    p = article_paragraphs(articles, skip, take, min_chars)
    return token_ids(p, "paragraph_id", "text").withColumnRenamed("paragraph_id", "cell_id")


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """The cells that a chunk has tokens of: chunk_id, cell_id, n (tokens), first (whether it begins the chunk)."""
    at = chunks.select("chunk_id", F.col("cells")[0].alias("head"), F.explode("cells").alias("cell_id"))
    return at.groupBy("chunk_id", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("head") == F.col("cell_id")).alias("first"))


def chunk_neighbors(chunks: DataFrame, cells: DataFrame, queries: DataFrame, k: int = 2, exclude: bool = True) -> DataFrame:
    """query_id (the chunk), slot, cell_id, filled: the k best cells of each chunk by activation.

    cells: cell_id, weight, theta; queries: query_id, vector. exclude: the chunk's own cells don't count; of max(8, 4 k) candidates the
    first others are taken, and the best candidate of all fills what is left. Without it no candidate is left out, as if each chunk's sources
    were ids that no cell has.
    """
    ranked = R.topk(cells, queries, max(8, 4 * k), by="act", include_silent=True)
    if not exclude:
        slots = ranked.where(F.col("rank") <= k)
        return slots.select("query_id", F.col("rank").alias("slot"), "cell_id", F.lit(False).alias("filled"))
    own = chunk_sources(chunks).select(F.col("chunk_id").alias("query_id"), "cell_id")
    return corpus.neighbors_without_self(ranked, own, k)


def chunk_queries(chunks: DataFrame, vectors: DataFrame, every: int = 100) -> DataFrame:
    """vectors: cell_id, vector. query_id and vector of each chunk whose number is divisible by `every`: the vector of the cell with most of its tokens (of equals the smallest id) among those that have one."""
    asked = chunk_sources(chunks.where(F.col("chunk_id") % every == 0)).join(vectors, "cell_id")
    best = asked.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("n"), "cell_id"))).where("r = 1")
    return best.select(F.col("chunk_id").alias("query_id"), "vector")
