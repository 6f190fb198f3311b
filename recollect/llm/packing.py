"""Packing documents into sequences of a fixed length, in their order, by dynamic programming over cut points.

The token stream of a partition (documents in scan order, each closed by an end id) may be cut at document ends, at
sentence ends and, inside stretches without either, at evenly spaced tokens. A window between two cuts is one sequence.
With positions b and penalties p of the cuts,

    f[j] = p[j] + min over i with b[j] - b[i] <= L of f[i] + padding(b[j] - b[i]),   padding(n) = L - n, 0 at powers of two

As L - (b[j] - b[i]) splits into a part of i and a part of j, the minimum over the sliding window comes from a queue kept
monotone in f[i] + b[i]: each cut enters and leaves it once. Windows of a power of two are looked up beside it, at a
price that keeps them from being used for their own sake.

No row is shuffled: a partition's documents are packed where they are read, in blocks of bounded size whose unfinished
last window moves into the next block. At most one sequence of a partition is short.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"
SENTENCE, FORCED = 16.0, 128.0
#: What a window of a power of two costs in place of padding.
POWER = 64.0


@functools.lru_cache(2)
def _encoding(ranks_path: str, pattern: str, added_path: str | None = None):
    """(encoding, whether each id ends a sentence); added_path: a tokenizers file, whose added tokens are the encoding's special ones."""
    import tiktoken

    special = {}
    if added_path:
        with open(added_path, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    enders = np.zeros(1 << 16, bool)
    for token, rank in ranks.items():
        enders[rank] = token.rstrip(b" \n\"')")[-1:] in (b".", b"!", b"?") or token[-1:] == b"\n"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), enders


@functools.lru_cache(2)
def _tokenizer(json_path: str, plain: bool):
    """The tokenizers file whose ids the ranks give; plain: strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


def cut_points(enders: np.ndarray, ends: np.ndarray, total: int, length: int, spacing: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the allowed cuts of `total` tokens, without 0. enders: whether a token ends a sentence; ends: where documents end."""
    kind = np.full(total + 1, FORCED)
    kind[1:][enders[:total]] = SENTENCE
    kind[ends] = 0.0
    at = np.flatnonzero(kind[1:] < FORCED) + 1
    bounds = np.concatenate([[0], at, [total]])
    gaps = np.flatnonzero(np.diff(bounds) > min(2 * spacing, length))
    step = min(spacing, length)
    more = [np.arange(bounds[g] + step, bounds[g + 1], step) for g in gaps]
    at = np.unique(np.concatenate([at, [total], *more])).astype(np.int64)
    at = at[at > 0]
    return at, kind[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int, last: bool) -> list[int]:
    """The positions that end windows in a cheapest division of the tokens before at[-1]; without `last`, the cheapest that leaves less than a window over."""
    b = [0, *at.tolist()]
    pen = [0.0, *penalty.tolist()]
    n = len(b)
    special: dict[int, list[int]] = {}
    grid = np.full(b[-1] + 1, -1, np.int64)
    grid[0] = 0
    grid[at] = np.arange(1, n)
    size = 1
    while size < length:
        there = np.flatnonzero(at >= size)
        i = grid[at[there] - size]
        for j, k in zip((there[i >= 0] + 1).tolist(), i[i >= 0].tolist()):
            special.setdefault(j, []).append(k)
        size *= 2
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        here = b[j]
        while b[queue[0][1]] < here - length:
            queue.popleft()
        g, best = queue[0]
        cost = g + length - here
        for i in special.get(j, ()):
            if f[i] + POWER < cost:
                cost, best = f[i] + POWER, i
        f[j], back[j] = cost + pen[j], best
        g = f[j] + here
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    j = n - 1
    if not last:
        tail = [i for i in range(n - 1, 0, -1) if b[i] > b[-1] - length]
        j = min(tail, key=lambda i: (f[i] + b[i], -i)) if tail else n - 1
    out = []
    while j:
        out.append(b[j])
        j = back[j]
    return out[::-1]


class _Packer:
    """The state of one partition: tokens not yet in a sequence and the documents that they belong to."""

    def __init__(self, length: int, first_sequence: int, block: int):
        self.length, self.block, self.sequence = length, block, first_sequence
        self.ids = np.zeros(0, np.uint16)
        self.enders = np.zeros(0, bool)
        self.docs: list[list] = []  # id, tokens, tokens that lie in earlier blocks, tokens here
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, enders: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids), 0, len(ids)])
        self.waiting.append((ids, enders))
        self.size += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        self.ids = np.concatenate([self.ids, *(x[0] for x in self.waiting)])
        self.enders = np.concatenate([self.enders, *(x[1] for x in self.waiting)])
        self.waiting = []
        rows: list[tuple] = []
        while len(self.ids) and (last or len(self.ids) >= self.block):
            total = min(len(self.ids), self.block)
            final = last and total == len(self.ids)
            ends = np.cumsum([d[3] for d in self.docs])
            ends = ends[ends <= total]
            at, penalty = cut_points(self.enders, ends, total, self.length)
            cuts = best_cuts(at, penalty, self.length, final)
            rows += self._emit(cuts, set(ends.tolist()))
        self.size = len(self.ids)
        return rows

    def _emit(self, cuts: list[int], ends: set[int]) -> list[tuple]:
        rows, doc, done, at = [], 0, 0, 0
        for cut in cuts:
            first = at
            while at < cut:
                doc_id, tokens, before, here = self.docs[doc]
                n = min(cut - at, here - done)
                crc = zlib.crc32(self.ids[at : at + n].astype("<u4").tobytes())
                kind = "document" if cut in ends else "sentence" if self.enders[cut - 1] else "token"
                rows.append((doc_id, before + done, n, crc, tokens, self.sequence, at - first, kind))
                at, done = at + n, done + n
                if done == here:
                    doc, done = doc + 1, 0
            self.sequence += 1
        self.docs = self.docs[doc:]
        if self.docs:
            self.docs[0][2] += done
            self.docs[0][3] -= done
        self.ids, self.enders = self.ids[at:], self.enders[at:]
        return rows


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    length: int = 2048,
    end_id: int = 1,
    block: int = 1 << 17,
    added_tokens: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    json_path: str | None = None,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most `length` tokens.

    tokenizer_path: the byte-level BPE as ranks (None: the public 50k file, whose ids are those of byte_bpe_50k.json).
    json_path: a tokenizers file of the same ids (None: byte_bpe_50k.json); a text with a run of white space too long for the ranks'
    pattern (about half a million characters) is encoded by it, whole.
    Strings of special tokens in a text are ordinary text; with added_tokens they are the ids of that file's added tokens,
    as tokenizers gives them without further options. Columns: doc_id, start (the document's ids before the piece),
    length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id
    (the partition's number in the upper bits, its own count in the lower 33), offset in the sequence, cut (what the
    sequence ends at: document, sentence or token). Order: that of the rows in each partition of `docs`; sort first for
    another. A null or empty text is its end id alone. A null doc_id stays null; repeated rows are documents of their
    own. No rows: none. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        same = json_path or public_tokenizers.path("byte_bpe_50k.json")
        encoding, enders = _encoding(tokenizer_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, same if added_tokens else None)
        packer = _Packer(length, TaskContext.get().partitionId() << 33, block)
        schema = pa.schema([(n, pa.string() if n == "cut" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                try:
                    ids = encoding.encode(text, allowed_special="all", disallowed_special=())
                except ValueError:  # the pattern backtracks over a run of white space, and its stack is bounded
                    ids = _tokenizer(same, not added_tokens).encode(text, add_special_tokens=False).ids
                ids = np.array([*ids, end_id], np.uint16)
                packer.add(doc_id.as_py(), ids, enders[ids])
                if packer.size >= block and (rows := packer.pack(False)):
                    yield out(rows)
        if rows := packer.pack(True):
            yield out(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
