"""Quality classifier: a generalised additive model with pairwise terms over counts of a text's form.

Every document's features are computed once, with numpy over Arrow buffers, and written to the shared folder. A bounded
sample of labelled documents trains the model: shallow trees on one feature at a time, in cycles, add up to a lookup table
per feature; the pairs that explain most of the rest get tables too. Scoring adds up one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.boosting import Additive, fit_additive
from recollect.llm.bytes_np import chunks, span_hashes, word_spans
from recollect.llm.joins import without_ids
from recollect.session import stored

FEATURES = [
    "log_words", "log_bytes", "mean_word", "upper", "digits", "symbols", "exclamations", "bars", "other_marks", "stops", "commas", "beyond_ascii",
    "distinct_words", "same_as_last", "second_last", "pair_repeats", "log_lines", "repeated_lines", "words_per_line", "marked_words", "upper_words", "long_words", "short_words",
]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


_UPPER, _DIGIT, _SYMBOL = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), _mask("#*$%&<>@^~=+_\\{}[]")
_OTHER, _STOP, _COMMA = _mask("\"'()/-?"), _mask("."), _mask(",;:")


def form(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values of FEATURES for each row's text; 0 where a text has no words."""
    rows = len(offsets) - 1
    per = lambda where: np.bincount(where, minlength=rows).astype(float)
    length = np.diff(offsets).astype(float)

    def chars(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(length, 1)

    start, end, row = word_spans(data, offsets)
    h = span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    n = per(row)
    safe = np.maximum(n, 1)
    width = (end - start).astype(float)

    def distinct(value: np.ndarray, where: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, where))
        v, w = value[order], where[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        return per(w[new])

    same = np.zeros(len(h), bool)
    second = same.copy()
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    second[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    both = row[1:] == row[:-1]
    pairs = (h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[both]
    pair_row = row[:-1][both]
    breaks = data == 10
    is_line = np.zeros(len(data), bool)
    is_line[start] = True
    before = np.concatenate([[0], np.cumsum(breaks, dtype=np.int64)])
    line_of = before[start]
    first = np.ones(len(start), bool)
    first[1:] = (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    last = np.concatenate([begin[1:] - 1, [len(start) - 1]]) if len(begin) else begin
    line_row = row[begin]
    line_hash = span_hashes(data, start[begin], end[last]) if len(begin) else np.zeros(0, np.uint64)
    lines = per(line_row)
    upper_total = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    upper_in = upper_total[end] - upper_total[start]
    tail = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    marked = _SYMBOL[tail] | (tail == 33) | (tail == 124)
    columns = [
        np.log1p(n), np.log1p(length), np.bincount(row, width, rows) / safe,
        chars(_UPPER[data]), chars(_DIGIT[data]), chars(_SYMBOL[data]), chars(data == 33), chars(data == 124), chars(_OTHER[data]), chars(_STOP[data]), chars(_COMMA[data]), chars(data > 127),
        distinct(h, row) / np.maximum(np.sqrt(n), 1), per(row[same]) / safe, per(row[second]) / safe, 1 - distinct(pairs, pair_row) / np.maximum(per(pair_row), 1),
        np.log1p(lines), 1 - distinct(line_hash, line_row) / np.maximum(lines, 1), n / np.maximum(lines, 1),
        per(row[marked]) / safe, per(row[(upper_in > 1) & (upper_in * 2 > width)]) / safe, per(row[width > 12]) / safe, per(row[width < 3]) / safe,
    ]
    out = np.stack(columns, 1)
    out[n == 0] = 0
    return out


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            x = form(data, offsets)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 20_000, rounds: int = 120) -> Additive | None:
    """The model from at most `sample` labelled rows outside the held-out fold (those with the smallest hashes of id and label); None if these don't hold both labels."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(sample)
    rows = features.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id", "y"), "doc_id", "y").limit(sample).select("x", "y").toPandas()
    if rows["y"].nunique() < 2:
        return None
    return fit_additive(np.stack(rows["x"].to_numpy()), (rows["y"].to_numpy() > 0).astype(float), rounds=rounds)


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 20_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1, higher: a label of 1 is likelier) and predicted (1 if score >= threshold).

    labels: doc_id and `label_col` (above 0: good). Only labels outside the held-out fold (crc32 of the id as text mod 5 is
    not 0) are learnt, at most `sample` of them. Nothing but the text goes into a score. A null, empty or blank text has
    features of 0 and a score like any other; a null id isn't held out; repeated rows get equal scores. Without labels of
    both kinds each score is 0.5. No rows give none. Other columns are dropped.
    """
    features = stored(with_features(docs, id_col, text_col), "features")
    sent = docs.sparkSession.sparkContext.broadcast(train(features, labels, label_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
                score = np.full(batch.num_rows, 0.5) if sent.value is None else sent.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without the documents that the classifier rejects. Of rows that share an id, all go if the best of them is rejected; rows without an id stay."""
    scored = score_quality(docs, labels, id_col=id_col, **options)
    gone = stored(scored.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0 AND doc_id IS NOT NULL").select("doc_id"), "rejected")
    return without_ids(docs, gone, id_col)
