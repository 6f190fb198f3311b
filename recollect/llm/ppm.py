"""Language-model scores: prediction by partial matching over bytes, pretrained on the corpus, beside smoothed word counts.

A text is its words in lower case, a space between two of them and an end symbol. For each byte the model asks the
longest context of the trie that it knows. Of T bytes seen there, D distinct ones, a byte seen n times has probability
(n - 1/2) / T, and an escape D / 2T; after an escape the next shorter context is asked, without the bytes that the longer
one has seen (symbol exclusion). The last resort is uniform over the bytes never seen.

Counts cover all training documents: each task counts its own blocks, Spark adds them up. The trie that is sent holds whole
contexts, those of at least `share` of all training symbols. Their number has a bound whatever the corpus' size, and the part of
a text outside them stays the same as the corpus grows; `max_nodes` (context, byte) pairs are a ceiling. A byte whose longest
context is not sent is looked up in the table of all pairs by joins, once for each block of texts and different key, so that the
model is that of all pairs whatever is sent. As a longer context's bytes are all known to the shorter one, what exclusion leaves
over is a constant of each context and is computed once.

Words are counted by a 64-bit hash. The `top` most frequent are looked up where the text is read; the others are joined.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.bytes_np import LOWER, HashIndex, chunks, mix, span_hashes, word_spans
from recollect.session import small_batches, stored

ORDER = 5
END = 10  # a byte that no word holds
_END_WORD = np.uint64(2)


def is_training(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text mod 7 is not 2; a null id trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts as the model sees them, where each row's begin and end, word hashes, row of each)."""
    rows = len(offsets) - 1
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    h = span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, start, 1)
    inside[end] -= 1
    letters = low[np.cumsum(inside[:-1]).astype(bool)] if len(low) else low
    width = end - start
    words = np.bincount(row, minlength=rows)
    last = np.zeros(len(start), bool)
    last[np.cumsum(words)[words > 0] - 1] = True
    # one separator after each word (the end after a row's last), one end for a row without words
    size = np.bincount(row, width + 1, rows).astype(np.int64)
    size[words == 0] = 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.full(bounds[-1], END, np.uint8)
    place = np.ones(len(out), bool)
    empty_before = np.cumsum(words == 0)
    after = np.cumsum(width + 1) - 1 + (empty_before[row] if len(row) else 0)
    place[after] = False
    place[bounds[:-1][words == 0]] = False
    out[place] = letters
    out[after] = np.where(last, END, 32)
    return out, bounds, h, row


def contexts(s: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(the last `order` bytes before each byte, packed; the longest order allowed there). Texts begin after an end symbol and see nothing before it."""
    n = len(s)
    packed = np.zeros(n, np.uint64)
    padded = np.concatenate([np.full(order, END, np.uint8), s])
    for j in range(1, order + 1):
        packed |= padded[order - j : order - j + n].astype(np.uint64) << np.uint64(8 * (j - 1))
    since = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    most = np.minimum(since + 1, order)
    first = since == 0
    packed[first] = END
    for r in range(1, order - 1):
        at = since == r
        packed[at] = (packed[at] & np.uint64((1 << 8 * r) - 1)) | np.uint64(END << 8 * r)
    at = since == order - 1
    packed[at] = (packed[at] & np.uint64((1 << 8 * (order - 1)) - 1)) | np.uint64(END << 8 * (order - 1))
    return packed, most


def _key(k, packed: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(order, context, byte) in 56 bits at most: exact for orders up to 5."""
    return (np.asarray(k, np.uint64) << np.uint64(56)) | (packed << np.uint64(8)) | s.astype(np.uint64)


def _counts(docs: DataFrame, order: int, block: int = 1 << 20) -> DataFrame:
    """kind (0: bytes at their longest order, 1: words), key, n over all rows of `docs`.

    A task holds about `block` keys of each kind at most. When different ones fill half of it, the frequent ones stay and the
    others are passed on; Spark adds up what is passed on, before the shuffle and after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def squeeze(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]])
            held[kind] = []
            at = np.argsort(keys)
            keys, n = keys[at], n[at]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 1 << 15):
                k = keys[a : a + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + len(k)])], names=["kind", "key", "n"])

        for _, data, offsets in chunks(batches, "text", 1 << 18):
            s, bounds, h, _ = symbols(data, offsets)
            packed, most = contexts(s, bounds, order)
            for kind, keys in ((0, (most.astype(np.uint64) << np.uint64(56)) | (packed << np.uint64(8)) | s), (1, np.concatenate([h, np.full(len(offsets) - 1, _END_WORD)]))):
                u, n = np.unique(keys, return_counts=True)
                held[kind].append((u, n.astype(np.int64)))
                if len(held[kind]) > 1 and sum(len(k) for k, _ in held[kind]) > block:
                    u, n = squeeze(kind)
                    if len(u) > block // 2:
                        stay = n > np.partition(n, -(block // 4))[-(block // 4)]
                        yield from out(kind, u[~stay], n[~stay])
                        u, n = u[stay], n[stay]
                    held[kind] = [(u, n)]
        for kind in held:
            if held[kind]:
                yield from out(kind, *squeeze(kind))

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """The pretrained contexts as hash tables, with all constants of escapes and exclusion."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int):
        """key: (order, context, byte) as _key packs them, each once; n: its count."""
        self.order = order
        key, n = np.asarray(key, np.uint64), np.asarray(n, np.float64)
        own, place = np.unique(key >> np.uint64(8), return_inverse=True)
        self.place = place.astype(np.int32)  # of each pair's context
        del place
        total, distinct = np.bincount(self.place, n, len(own)), np.bincount(self.place, minlength=len(own)).astype(float)
        self.pairs, self.contexts = HashIndex(), HashIndex()
        self.pairs.add(mix(key + np.uint64(1)))
        self.contexts.add(mix(own + np.uint64(1)))
        self.log_n, self.log_total = np.log10(n - 0.5), np.log10(total)
        self.escape = np.log10(distinct / 2) - self.log_total
        # in the parent, without what this context has seen
        longer = (key >> np.uint64(56)) > 0
        up = _parent(key, (key >> np.uint64(56)).astype(np.int64))
        at = self.pairs.find(mix(up + np.uint64(1)))
        seen_there = np.bincount(self.place, np.where((at >= 0) & longer, n[at], 0), len(own))
        del at
        of = np.full(len(own), -1, np.int32)
        of[self.place] = np.where(longer, self.contexts.find(mix((up >> np.uint64(8)) + np.uint64(1))), -1)
        del up, longer
        left_n = np.where(of >= 0, total[of] - seen_there, 0)
        left_d = np.where(of >= 0, distinct[of] - distinct, 0)
        with np.errstate(divide="ignore"):
            some = left_d > 0
            self.norm_next = np.where(some, np.log10(np.where(some, left_n, 1)), 0.0)
            self.escape_next = np.where(some, np.log10(np.where(some, left_d / 2, 1)) - self.norm_next, 0.0)
        root = self.contexts.find(mix(np.array([0], np.uint64) + np.uint64(1)))[0]
        self.unseen = math.log10(max(1.0, 256 - distinct[root])) if root >= 0 else math.log10(256)

    def log10(self, s: np.ndarray, packed: np.ndarray, most: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, beyond: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each byte in its context.

        state: what the last longer context, looked up elsewhere, leaves over for the next (log10 of its count and the
        escape; NaN and 0 without one). beyond: gets True where the longest context isn't in this trie; such bytes get 0.
        """
        out = np.zeros(len(s))
        norm, escape = state or (np.full(len(s), np.nan), np.zeros(len(s)))
        open_ = np.arange(len(s))
        for k in range(self.order, -1, -1):
            here = most[open_] >= k
            at, later = open_[here], open_[~here]
            if len(at):
                low = packed[at] & np.uint64((1 << 8 * k) - 1)
                j = self.pairs.find(mix(_key(k, low, s[at]) + np.uint64(1)))
                hit = j >= 0
                a, jj = at[hit], j[hit]
                out[a] += self.log_n[jj] - np.where(np.isnan(norm[a]), self.log_total[self.place[jj]], norm[a])
                a, low = at[~hit], low[~hit]
                c = self.contexts.find(mix(((np.uint64(k) << np.uint64(48)) | low) + np.uint64(1)))
                known = c >= 0
                if beyond is not None:
                    away = ~known & (most[a] == k)
                    beyond[a[away]] = True
                    a, c, known = a[~away], c[~away], known[~away]
                x, cc = a[known], c[known]
                out[x] += np.where(np.isnan(norm[x]), self.escape[cc], escape[x])
                norm[x], escape[x] = self.norm_next[cc], self.escape_next[cc]
                open_ = np.concatenate([a, later])
            else:
                open_ = later
        out[open_] -= self.unseen
        return out


class Model:
    """What the tasks get: the counts of the pairs that are sent and those of frequent words. Each worker builds the trie of them, once, so that the driver holds the numbers alone."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int, words: np.ndarray, times: np.ndarray):
        self.key, self.n, self.order, self.words, self.times = key, n, order, words, times

    @functools.cached_property
    def trie(self) -> Trie:
        key, n = self.key, self.n
        self.key = self.n = None  # the trie holds all of them
        return Trie(key, n, self.order)

    @functools.cached_property
    def frequent(self) -> tuple[HashIndex, np.ndarray]:
        """(words to their places, log10 of the count at each place, plus one)."""
        words, times = self.words, self.times
        self.words = self.times = None
        index = HashIndex()
        index.add(words.view(np.uint64))
        return index, np.log10(times + 1.0)


def _parent(key: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The key of the same byte in the context without its oldest byte."""
    shorter = np.maximum(k - 1, 0).astype(np.uint64)
    body = key & np.uint64((1 << 56) - 1)
    keep = (np.uint64(1) << (np.uint64(8) * (shorter + np.uint64(1)))) - np.uint64(1)
    return (shorter << np.uint64(56)) | (body & keep)


def train_trie(counted: DataFrame, max_nodes: int, share: float = 2**-19) -> tuple[np.ndarray, np.ndarray, tuple[DataFrame, DataFrame] | None]:
    """Keys and counts of the trie of the counted bytes: of the contexts of at least `share` of all symbols, and if these have more than `max_nodes` pairs, of the largest counts among them; and, if it isn't all, the tables of all pairs (key, n) and contexts (c, total, distinct, sent: whether it is in the trie)."""
    key, n = F.col("key"), F.col("n")
    # a byte in a context counts in each shorter context too
    every = counted.where("kind = 0").select(F.explode(F.expr(_shorter(0))).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    every = stored(every, "trie")
    context = F.shiftright(key, 8)
    sizes = stored(every.groupBy(context.alias("c")).agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("distinct")), "contexts")
    root = sizes.where("c = 0").first()  # all symbols are counted in the empty context
    if root is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    often = F.col("total") >= share * root["total"]
    # buckets of half a power of two of the context's count: their number is fixed
    bucket = F.floor(2 * F.log2("total")).cast("int")
    buckets = sizes.groupBy(bucket.alias("b")).agg(F.sum(F.when(often, F.col("distinct")).otherwise(0)).alias("m"), F.sum("distinct").alias("pairs")).orderBy(F.desc("b")).collect()
    held, least = 0, None
    for b, m, _ in buckets:
        if held + m > max_nodes and held:
            break
        held, least = held + m, b
    # a shorter context's count is no smaller, so the trie holds all shorter contexts of those it holds
    sizes = sizes.withColumn("sent", often & (bucket >= least))
    kept = every.join(sizes.where("sent").select("c"), context == F.col("c"), "left_semi")
    rows = kept.select("key", "n").toArrow()
    return rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy(), None if held == sum(pairs for _, _, pairs in buckets) else (every, sizes)


def _shorter(least: int) -> str:
    """The keys of a byte in its context and in each shorter one, down to `least` bytes, in SQL."""
    return f"transform(sequence({least}, cast(key >> 56 as int)), j -> shiftleft(cast(j as bigint), 56) | (key & (shiftleft(1L, 8 * (j + 1)) - 1)))"


def beyond_trie(asked: DataFrame, every: DataFrame, sizes: DataFrame, order: int, sent) -> DataFrame:
    """key and log10 of its probability, for distinct keys whose longest context is not in the trie that `sent` holds."""
    found = stored(asked.join(every, "key", "left"), "found")
    context = F.shiftright("key", 8)
    hits = found.where("n is not null").join(sizes.select("c", "total"), context == F.col("c")).select("key", (F.log10(F.col("n") - 0.5) - F.log10("total")).alias("log10"))
    # the others go down: their contexts that were seen but not sent, with what each leaves over for the next
    missed = found.where("n is null").select("key")
    levels = missed.select("key", F.explode(F.expr(_shorter(1))).alias("low")).withColumn("c", F.shiftright("low", 8))
    levels = stored(levels.join(sizes.where("not sent").select("c", "total", "distinct"), "c"), "levels")
    needed = levels.select("c", "distinct").distinct()
    parent = "shiftleft((key >> 56) - 1, 56) | (key & (shiftleft(1L, cast(8 * (key >> 56) as int)) - 1))"
    own = every.withColumn("c", context).join(needed, "c").select("c", "distinct", F.expr(parent).alias("up"))
    left = own.join(every.select(F.col("key").alias("up"), F.col("n").alias("up_n")), "up")
    left = left.groupBy("c", "distinct", F.shiftright("up", 8).alias("up_c")).agg(F.sum("up_n").alias("seen"))
    left = left.join(sizes.select(F.col("c").alias("up_c"), F.col("total").alias("up_total"), F.col("distinct").alias("up_distinct")), "up_c")
    left = left.select("c", (F.col("up_total") - F.col("seen")).alias("left_n"), (F.col("up_distinct") - F.col("distinct")).alias("left_d"))
    levels = levels.join(left, "c").join(every.select(F.col("key").alias("low"), "n"), "low", "left")
    fields = ["n", "total", "distinct", "left_n", "left_d"]
    at = F.shiftright("low", 56)
    down = missed.join(levels.groupBy("key").agg(*[F.max(F.when(at == k, F.col(f).cast("double"))).alias(f"{f}{k}") for k in range(1, order + 1) for f in fields]), "key", "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value.trie
        for batch in batches:
            value = {name: batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, name in enumerate(batch.schema.names) if i}
            key = batch.column(0).to_numpy().view(np.uint64)
            out, done = np.zeros(len(key)), np.zeros(len(key), bool)
            norm, escape = np.full(len(key), np.nan), np.zeros(len(key))
            for k in range(order, 0, -1):
                n, total, distinct, left_n, left_d = (value[f"{f}{k}"] for f in fields)
                first = np.isnan(norm)
                hit = ~done & ~np.isnan(n)
                out[hit] += np.log10(n[hit] - 0.5) - np.where(first, np.log10(total), norm)[hit]
                done |= hit
                x = ~done & ~np.isnan(total)
                out[x] += np.where(first, np.log10(distinct / 2) - np.log10(total), escape)[x]
                some = x & (left_d > 0)
                norm[x] = escape[x] = 0.0
                norm[some] = np.log10(left_n[some])
                escape[some] = np.log10(left_d[some] / 2) - norm[some]
            go = ~done
            packed = (key[go] >> np.uint64(8)) & np.uint64((1 << 48) - 1)
            out[go] += trie.log10((key[go] & np.uint64(255)).astype(np.uint8), packed, (key[go] >> np.uint64(56)).astype(np.int64), (norm[go], escape[go]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["key", "log10"])

    return hits.unionByName(down.mapInArrow(walk, "key long, log10 double"))


def most_frequent(words: DataFrame, top: int) -> pa.Table:
    """key and n of words, the most frequent first, as far as whole buckets of an eighth of a power of two fit into `top`."""
    bucket = F.floor(8 * F.log2("n")).cast("int")
    held, least = 0, None
    for b, m in words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("b")).collect():
        if held + m > top:
            break
        held, least = held + m, b
    return words.where(bucket >= least if least is not None else F.lit(False)).select("key", "n").toArrow()


def score_texts(docs: DataFrame, order: int = ORDER, max_nodes: int = 1_000_000, top: int = 400_000, id_col: str = "doc_id", text_col: str = "text", share: float = 2**-19, block: int = 1 << 21) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are words ([^\\x20\\x09-\\x0D]+, A-Z in lower case) and one end. base_score adds log10((c + 1) / (N + V + 1)) over
    them, c, N and V counted over the training documents (crc32 of the id as text mod 7 is not 2). score is the log10
    probability that the byte model gives the words, the spaces between them and the end. A null, empty or blank text is its end
    alone. share, max_nodes and top bound what is sent, not what is known; about `block` bytes that are looked up elsewhere make a
    block, in which equal ones are asked for once. A null id trains and isn't held out. Repeated rows are documents of their own. Without training documents
    words are unknown (N = V = 0) and bytes uniform. No rows give none. Other columns are dropped. order: 5 at most.
    """
    if not 0 < order <= 5:
        raise ValueError("order must be 1 to 5: keys hold five bytes of context")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(spark):
        counted = stored(_counts(rows.where(is_training()), order), "counts")
    words = counted.where("kind = 1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = most_frequent(words, top)
    key, n, tables = train_trie(counted, max_nodes, share)
    sent = spark.sparkContext.broadcast(Model(key, n, order, frequent["key"].to_numpy(), frequent["n"].to_numpy()))
    del key, n
    whole = distinct == frequent.num_rows
    complete = tables is None
    scale = math.log10(total + distinct + 1)

    def lists(rows: np.ndarray, values: np.ndarray, count: int) -> pa.ListArray:
        values = values[np.argsort(rows, kind="stable")]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]).astype(np.int32)), pa.array(values.view(np.int64)))

    fields = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "rare": pa.list_(pa.int64()), "block": pa.int64(), "at": pa.list_(pa.int32()), "start": pa.int64(), "keys": pa.list_(pa.int64())}

    def table(count: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(count, kind)) for name, kind in fields.items()], names=list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, (index, log_n) = sent.value.trie, sent.value.frequent
        number = TaskContext.get().partitionId() << 32  # of the block
        held, looked_up, asked, size = [], [], 0, 0  # rows of the block, and the keys that they look up; the keys' number and the rows' bytes

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(looked_up)
            looked_up.clear()
            by = np.argsort(keys)
            keys = keys[by]
            new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
            own, at = keys[new], np.zeros(len(keys), np.int32)
            del keys
            at[by] = np.cumsum(new, dtype=np.int32) - 1
            del by, new
            first = 0
            for count, columns, ends in held:
                places = pa.array(at[first : first + ends[-1]])
                first += ends[-1]
                yield table(count, **columns, block=pa.array(np.full(count, number)), at=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places))
            cuts = np.append(np.arange(0, len(own), 1 << 12), len(own))
            if len(own):
                yield table(len(cuts) - 1, block=pa.array(np.full(len(cuts) - 1, number)), start=pa.array(cuts[:-1]), keys=pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(own.view(np.int64))))

        for part, data, offsets in chunks(batches, "text", 1 << 18):
            count = len(offsets) - 1
            s, bounds, h, row = symbols(data, offsets)
            packed, most = contexts(s, bounds, trie.order)
            beyond = None if complete else np.zeros(len(s), bool)
            bits = np.concatenate([[0], np.cumsum(trie.log10(s, packed, most, beyond=beyond))])
            far = np.zeros(0, np.int64) if complete else np.flatnonzero(beyond)
            h, row = np.concatenate([h, np.full(count, _END_WORD)]), np.concatenate([row, np.arange(count)])
            at = index.find(h)
            here = at >= 0
            base = np.bincount(row[here], log_n[at[here]], count)
            known = np.bincount(row[here], minlength=count)
            rest, where = h[~here], row[~here]
            if whole:  # words beyond the list were never seen
                rest, where = rest[:0], where[:0]
            ids = part.column(0).take(pa.array(np.arange(count)))  # a slice would hold all texts of its batch
            columns = {"doc_id": ids, "n_tokens": pa.array(np.bincount(row, minlength=count)), "known": pa.array(known), "base": pa.array(base), "score": pa.array(bits[bounds[1:]] - bits[bounds[:-1]]), "rare": lists(where, rest, count)}
            held.append((count, columns, np.searchsorted(far, bounds)))
            looked_up.append(_key(most[far], packed[far], s[far]))
            asked, size = asked + len(far), size + len(data)
            if asked >= block or size >= 1 << 25:
                yield from out()
                number, held, asked, size = number + 1, [], 0, 0
        if held:
            yield from out()

    scored = rows.mapInArrow(run, "doc_id long, n_tokens long, known long, base double, score double, rare array<long>, block long, at array<int>, start long, keys array<long>")
    with small_batches(spark):
        scored = stored(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    keys, scored = scored.where("keys is not null").select(F.col("block").alias("of"), "start", "keys"), scored.where("keys is null").drop("start", "keys")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times")).join(words, "key")
    more = rare.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"))
    joined = scored.drop("rare", "block", "at").join(more, "row", "left")
    score = F.col("score")
    if tables:
        far = keys.select("of", "start", F.posexplode("keys").alias("pos", "key")).select("of", (F.col("start") + F.col("pos")).cast("int").alias("pos"), "key")
        found = far.join(stored(beyond_trie(far.select("key").distinct(), *tables, order, sent), "beyond"), "key").select("of", "pos", "log10")

        def add(texts: pa.Table, keys: pa.Table) -> pa.Table:
            value = np.full(keys.num_rows, np.nan)
            value[keys["pos"].to_numpy()] = keys["log10"].to_numpy()
            at = texts["at"].combine_chunks()
            ends = at.offsets.to_numpy()
            sums = np.add.reduceat(value[at.values.to_numpy()[: ends[-1]]], ends[:-1])  # no row is without a place
            return pa.table({"row": texts["row"], "deep": sums})

        asking = scored.where(F.size("at") > 0).select("block", "row", "at")
        deep = asking.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(add, "row long, deep double")
        joined = joined.join(deep, "row", "left")
        score = score + F.coalesce("deep", F.lit(0.0))
    sent.destroy()  # all that reads it is stored
    return joined.select(
        "doc_id",
        (~is_training()).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        score.alias("score"),
    )
