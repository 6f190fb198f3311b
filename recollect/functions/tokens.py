"""Token ids of a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_OF_TEXT = 50256


@functools.lru_cache(2)
def tokenizer(path: str | None = None):
    """The tokenizers file at `path` (None: the public byte-level BPE of 50,257 ids); strings of special tokens are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@functools.lru_cache(1)
def encoding():
    """The public tokenizer by its ranks, which give the same ids in a small part of the time; ids that it doesn't know and runs of white space too long for its pattern it refuses."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END_OF_TEXT})


def encoded(text: str, path: str | None = None) -> np.ndarray:
    """The ids of a text; strings of special tokens are ordinary text."""
    if path is None:
        try:
            return encoding().encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern backtracks over a run of white space, and its stack is bounded
            pass
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def decoded(ids: list[int], path: str | None = None) -> str:
    """What ids say."""
    if path is None:
        try:
            return encoding().decode(ids)
        except KeyError:  # an id that no token has, which tokenizers passes over
            pass
    return tokenizer(path).decode(ids, skip_special_tokens=False)


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def token_ids(rows: DataFrame, id_col: str, text_col: str, end: int | None = END_OF_TEXT, path: str | None = None) -> DataFrame:
    """Per row id_col (long) and tokens, those of its text and then the end; a null text has the end alone. Null ids pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            for b in _slices(batch, 64):
                ids = [part for x in b.column(1).to_pylist() for part in (encoded(x or "", path), closing)]
                ends = np.cumsum([0, *map(len, ids)])[::2]
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), tokens], names=[id_col, "tokens"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, tokens array<int>")


def token_texts(rows: DataFrame, id_col: str, tokens_col: str = "tokens", path: str | None = None) -> DataFrame:
    """Per row id_col and text, what its tokens say; ids that are no whole text give replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, 64):
                ids, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy())
                said = [decoded(x.tolist(), path) for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], names=[id_col, "text"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(tokens_col).alias("tokens")).mapInArrow(run, f"`{id_col}` long, text string")
