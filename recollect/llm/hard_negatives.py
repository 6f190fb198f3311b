"""Hard negatives: exact search among candidates in buckets of one length, pruned by Cauchy-Schwarz.

Candidates are sorted by norm, the longest first, and stored so; a bucket is a run of them with its greatest norm. Anchors
go to the tasks in blocks of bounded size, each of which is held against all candidates.
An anchor asks a bucket only if its own norm times the bucket's could reach what it still needs: the lower limit of
one of its windows and, once a window is full, its running kth score. A first pass over a share of the candidates gives every
window a kth score to begin with, which only prunes. Tasks return the best of each window; they are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.int_vectors import kept_vectors, matrix, products
from recollect.session import release, stored

#: Anchors of a block, which driver and tasks hold at once (64 components: 8 MB).
BLOCK = 32_768
#: Candidates of a bucket.
BUCKET = 2_048
_NEVER = np.iinfo(np.int64).max
_ALWAYS = np.iinfo(np.int64).min


class Best:
    """The `k` first (score, smaller id) entries of each of `n` windows, and the scores that an entry must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.ravel().copy()
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.new.append([window, score, ident])
        self.waiting += len(window)
        if self.waiting > max(1 << 16, 2 * len(self.kept[0])):
            self.squeeze()

    def squeeze(self) -> None:
        window, score, ident = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        self.new, self.waiting = [], 0
        order = np.lexsort((ident, -score, window))
        window, score, ident = window[order], score[order], ident[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
        rank = np.arange(len(window)) - np.repeat(first, np.diff(np.r_[first, len(window)]))
        last = rank == self.k - 1
        self.floors[window[last]] = np.maximum(self.floors[window[last]], score[last])
        self.kept = [x[rank < self.k] for x in (window, score, ident)]


def search(batches: Iterator[pa.RecordBatch], anchors: dict, k: int, same: bool, bucket: int = BUCKET, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, id) of the best of these candidates. anchors: ids, labels, norms, vectors (by length: numbers of anchors and matrix), low and high per window (anchors x windows). same: whether candidates have the anchor's label, and aren't it, or another one."""
    low, high = anchors["low"], anchors["high"]
    width = low.shape[1]
    best = Best(low, k)
    for batch in batches:
        lengths = batch.column("n").to_numpy()
        for n in np.unique(lengths):
            if int(n) not in anchors["vectors"]:
                continue
            own, a_all = anchors["vectors"][int(n)]
            part = batch.filter(pa.array(lengths == n)) if (lengths != n).any() else batch
            for at in range(0, part.num_rows, bucket):
                b = part.slice(at, bucket)
                x, label, ident = matrix(b.column("v"), int(n)), b.column("label").to_numpy(), b.column("vec_id").to_numpy()
                reach = np.sqrt(float(b.column("norm2").to_numpy().max())) * (1 + 1e-9)
                for a in range(0, len(own), rows):
                    mine = own[a : a + rows]
                    floors = best.floors.reshape(-1, width)[mine]
                    least = floors.min(1)
                    open_ = np.flatnonzero(anchors["norms"][mine] * reach >= np.where(least == _NEVER, np.inf, least.astype(float)))
                    if not len(open_):
                        continue
                    who, floors, least = mine[open_], floors[open_], least[open_]
                    score = products(a_all[a : a + rows][open_], x)
                    r, c = np.nonzero(score >= least[:, None])
                    s, w = score[r, c], who[r]
                    fits = (anchors["labels"][w] == label[c]) & (anchors["ids"][w] != ident[c]) if same else anchors["labels"][w] != label[c]
                    r, c, s, w = r[fits], c[fits], s[fits], w[fits]
                    for j in range(width):
                        hit = (s >= floors[r, j]) & (s <= high[w, j])
                        if hit.any():
                            best.add(w[hit] * width + j, s[hit], ident[c[hit]])
    best.squeeze()
    window, score, ident = best.kept
    for a in range(0, len(window), 1 << 16):
        yield window[a : a + (1 << 16)], score[a : a + (1 << 16)], ident[a : a + (1 << 16)]


def _best(candidates: DataFrame, sent, k: int, same: bool) -> DataFrame:
    """(window long, score long, vec_id long, rank int): the k best of each window among `candidates`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in search(batches, sent.value, k, same):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["window", "score", "vec_id"])

    ranked = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return candidates.mapInArrow(run, "window long, score long, vec_id long").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _searched(candidates: DataFrame, anchors: dict, k: int, same: bool, seed: int) -> DataFrame:
    """The k best of each window, stored. A pass over one in `seed` candidates raises the windows' lower limits first."""
    spark = candidates.sparkSession
    sent = spark.sparkContext.broadcast(anchors)
    share = candidates.where(F.pmod(F.xxhash64("vec_id"), F.lit(seed)) == 0)
    full = _best(share, sent, k, same).where(F.col("rank") == k).select("window", "score").toArrow()
    sent.destroy()
    low = anchors["low"].copy().ravel()
    low[full["window"].to_numpy()] = np.maximum(low[full["window"].to_numpy()], full["score"].to_numpy())
    sent = spark.sparkContext.broadcast(anchors | {"low": low.reshape(anchors["low"].shape)})
    out = stored(_best(candidates, sent, k, same), "best")
    sent.destroy()
    return out


def _block(rows: pa.Table) -> dict:
    """A block of anchors as arrays, with one window that takes every score."""
    n = rows["n"].to_numpy()
    vectors = {int(d): (at := np.flatnonzero(n == d), matrix(rows["v"].combine_chunks().take(pa.array(at)), int(d))) for d in np.unique(n)}
    return {"ids": rows["vec_id"].to_numpy(), "labels": rows["label"].to_numpy(), "norms": np.sqrt(rows["norm2"].to_numpy().astype(float)), "vectors": vectors, "low": np.full((len(n), 1), _ALWAYS), "high": np.full((len(n), 1), _NEVER)}


def hard_negatives(rows: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK, seed: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of whole numbers, floor(scale * x) of each component; higher ones come first, ties by the smaller id.
    Anchors are the rows for which the SQL condition on vec_id holds; an anchor's positives are its first `positives` other rows (of another id)
    of its label, and each positive gets the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score. Rows without id, label or vector, or with a component that is null, not finite or beyond int_vectors.MOST, take
    no part; vectors of different lengths don't meet. Repeated rows are candidates and anchors of their own, so that their rows are repeated. An anchor
    without positives, or a window without negatives, gives no row; no rows give none. Other columns are dropped, so their names can't clash.
    block bounds what is sent at once, seed the share of candidates that is searched first; neither changes the result. The searches run
    while the query is defined.
    """
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).where("vec_id is not null and label is not null")
    d = kept_vectors(named, "v", None, scale).select("vec_id", "label", "v", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x).alias("norm2"))
    # the id splits a norm that many share
    by_norm = [F.desc("norm2"), F.col("vec_id")]
    candidates = stored(d.repartitionByRange(*by_norm).sortWithinPartitions(*by_norm), "by_norm")
    of_block = stored(candidates.where(anchors).withColumn("r", F.rand(7)), "anchors")
    blocks = max(1, -(-of_block.count() // block))
    out = None
    for b in range(blocks):
        asked = _block(of_block.where(F.floor(F.col("r") * blocks) == b).drop("r").toArrow())
        found = _searched(candidates, asked, positives, True, seed)
        p = found.toArrow()
        release(found)
        who, rank, score, ident = p["window"].to_numpy(), p["rank"].to_numpy() - 1, p["score"].to_numpy(), p["vec_id"].to_numpy()
        least, most = np.full((len(asked["ids"]), positives), _NEVER), np.full((len(asked["ids"]), positives), _ALWAYS)
        least[who, rank], most[who, rank] = -(-low * score // 100), high * score // 100
        least[least > most] = _NEVER
        positive = np.zeros((2, *least.shape), np.int64)
        positive[0][who, rank], positive[1][who, rank] = ident, score
        result = _searched(candidates, asked | {"low": least, "high": most}, negatives, False, seed)
        # ids and scores of a block's windows follow by their number
        about = result.sparkSession.sparkContext.broadcast((np.repeat(asked["ids"], positives), positive[0].ravel(), positive[1].ravel()))

        def said(batches: Iterator[pa.RecordBatch], about=about) -> Iterator[pa.RecordBatch]:
            for t in batches:
                w = t.column("window").to_numpy()
                anchor, ident, score = (pa.array(x[w]) for x in about.value)
                yield pa.RecordBatch.from_arrays([anchor, ident, t.column("rank"), t.column("vec_id"), score, t.column("score")], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        named = stored(result.mapInArrow(said, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "negatives")
        about.destroy()
        release(result)
        out = named if out is None else out.unionByName(named)
    release(candidates, of_block)
    return out
