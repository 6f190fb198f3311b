"""Corpus preparation: paragraphs, deduplication, disjointness, splits, conversations, chunks and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import collapsed, fingerprint
from recollect.session import stored


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal keys the one that comes first by `order`. min_by aggregates map-side, so a key with very many rows is no single task's work."""
    first = rows.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    keyed = rows.withColumn("_own", key)
    return keyed.join(first, F.col("_own").eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_first")), "left_semi").drop("_own")


def fingerprints(paragraphs: DataFrame, min_chars: int = 20, column: str = "text") -> DataFrame:
    """The distinct fingerprints of texts of `min_chars` or more."""
    # exploded, so that no filter on the fingerprint is pushed to where it would be computed a second time
    return paragraphs.where(F.length(column) >= min_chars).select(F.explode(F.array_compact(F.array(fingerprint(F.col(column))))).alias("fp")).distinct()


def disjointness(bank: DataFrame, corpus: DataFrame, max_ratio: float = 0.001) -> DataFrame:
    """bank, corpus: fp, distinct. One row: how many, how many shared, their share of the corpus and whether that passes. An empty corpus gives a null ratio, which fails."""
    both = bank.join(corpus, "fp", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))
    b, c = bank.agg(F.count(F.lit(1)).alias("n_bank")), corpus.agg(F.count(F.lit(1)).alias("n_corpus"))
    ratio = F.col("n_shared") / F.nullif(F.col("n_corpus"), F.lit(0))
    return b.join(F.broadcast(c)).join(F.broadcast(both)).select("n_bank", "n_corpus", "n_shared", F.round(ratio, 6).alias("ratio"), F.coalesce(ratio <= max_ratio, F.lit(False)).alias("passes"))


def shuffled_key(seed: int, key: Column) -> Column:
    """An order like a shuffle, the same everywhere: SHA-1 of the seed and the key."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def running_sums(rows: DataFrame, order: list[str], size: str, within: list[str] | None = None) -> DataFrame:
    """`rows` with start, the sum of `size` over the rows before each, in the order of any columns; `within` begins anew for each of its values.

    Rows are dealt by ranges of the order and stored; each range adds up by itself, and only one row per range meets in a
    window. Equal keys may stand in any order among each other.
    """
    by = within or []
    dealt = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    sums = dealt.groupBy(*by, "_range").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return placed.join(F.broadcast(bases), [*by, "_range"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in", "_range")


def group_split(items: DataFrame, group: str, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """A split without a group on both sides: groups in shuffled order fill train up to n_train rows, those after it test up to n_test.

    Returns group, n (rows), part, taken (rows that count towards the part).
    """
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("key", shuffled_key(seed, F.col(group)))
    s = running_sums(sizes, ["key", group], "n")
    # train is the first groups, so what stands before a test group is known once train's rows are
    in_train = s.agg(F.coalesce(F.sum(F.when(F.col("start") < n_train, F.col("n"))), F.lit(0)).alias("train_rows"))
    s = s.join(F.broadcast(in_train)).withColumn("test_before", F.col("start") - F.col("train_rows"))
    train = F.col("start") < n_train
    part = F.when(train, "train").when(F.col("test_before") < n_test, "test")
    taken = F.when(train, F.least("n", F.lit(n_train) - F.col("start"))).otherwise(F.least("n", F.lit(n_test) - F.col("test_before")))
    return s.select(group, "n", part.alias("part"), taken.alias("taken")).where("part IS NOT NULL")


def conversations_joined(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and the text: each turn as its role, a line break and its text, turns by number, an empty line between."""
    said = F.struct("turn", F.concat(F.col("role"), F.lit("\n"), F.col("text")).alias("t"))
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("s"))
    return g.select("conv_id", F.size("s").cast("long").alias("n_turns"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"))


def forward_filled(lines: DataFrame, group: str, order: str, title: Column) -> DataFrame:
    """`lines` with the last non-null title at or above each within its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_t", title).withColumn("title", F.last("_t", ignorenulls=True).over(w)).drop("_t")


def global_offsets(sizes: DataFrame, order: str, size: str, block: int = 1024) -> DataFrame:
    """`sizes` with start, the sum of the sizes before each row in the order of an integer column.

    Two levels: sums within blocks of the order run in parallel; only one row per block meets in a single window.
    """
    b = F.floor(F.col(order) / block)
    blocks = sizes.groupBy(b.alias("_b")).agg(F.sum(size).alias("_s"))
    starts = blocks.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("_b", b).withColumn("_in", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return inner.join(starts, "_b").withColumn("start", F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")


def token_chunks(docs: DataFrame, length: int = 64) -> DataFrame:
    """doc_id, text to chunk_id, n_tokens, first_doc, last_doc: white-space tokens of all documents in id order, cut every `length`.

    A document adds one row per chunk that it touches, not one per token.
    """
    t = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n"))
    placed = global_offsets(t, "doc_id", "n").where("n > 0")
    touched = placed.select("doc_id", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length))).alias("chunk_id"))
    inside = F.least(F.col("start") + F.col("n"), (F.col("chunk_id") + 1) * length) - F.greatest(F.col("start"), F.col("chunk_id") * length)
    return touched.select("chunk_id", "doc_id", inside.alias("k")).groupBy("chunk_id").agg(F.sum("k").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def mixture_fill(docs: DataFrame, shares: dict[str, float], budget: int, order: list[str]) -> DataFrame:
    """docs: source, n (tokens) and the columns of `order`. The union of several corpora under one token budget: each source gets its share, filled by documents in order while those before them leave room; others get nothing.

    Adds start (the source's tokens before the document) and quota.
    """
    quotas = docs.sparkSession.createDataFrame([(k, int(v * budget)) for k, v in shares.items()], "source string, quota long")
    chosen = docs.join(F.broadcast(quotas), "source")
    return running_sums(chosen, order, "n", ["source"]).where(F.col("start") < F.col("quota"))


def budget_fill(docs: DataFrame, budget: int, order: str = "doc_id") -> DataFrame:
    """Documents in order while the tokens before them stay below the budget."""
    t = docs.select("doc_id", order, F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n")) if order != "doc_id" else docs.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n"))
    return global_offsets(t, order, "n").where(F.col("start") < budget).select("doc_id", "n", "start")


def next_pairs(tokens: DataFrame, order: str = "pos", token: str = "token", group: str = "doc_id") -> DataFrame:
    """Each token with the one after it, within a group."""
    w = Window.partitionBy(group).orderBy(order)
    return tokens.withColumn("next_token", F.lead(token).over(w)).where("next_token IS NOT NULL")


def padded(tokens: Column, length: int, pad: int) -> Column:
    """A token array cut or filled to `length`."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def interleaved(a: Column, b: Column, length: int, pad: int) -> Column:
    """The first halves of two token arrays, each filled to half the length."""
    half = length // 2
    return F.concat(padded(a, half, pad), padded(b, half, pad))


def neighbors_without_self(ranked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """ranked: query_id, rank, cell_id up to max(8, 4k) ranks; own: query_id, cell_id that must not be neighbours. k neighbours each; what is missing is filled with the first of the unfiltered ranking."""
    pool = ranked.where(F.col("rank") <= max(8, 4 * k))
    left = pool.join(own, ["query_id", "cell_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    chosen = left.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k).select("query_id", "slot", "cell_id")
    first = pool.where("rank = 1").select("query_id", F.col("cell_id").alias("top1"))
    slots = first.select("query_id", "top1", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    return slots.join(chosen, ["query_id", "slot"], "left").select("query_id", "slot", F.coalesce("cell_id", "top1").alias("cell_id"), F.col("cell_id").isNull().alias("filled"))


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows of each stratum in shuffled order."""
    w = Window.partitionBy(by).orderBy(shuffled_key(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def strided(rows: DataFrame, order: str, stride: int) -> DataFrame:
    """Each stride-th row in the order of an integer column, from the first."""
    ranked = global_offsets(rows.withColumn("_one", F.lit(1)), order, "_one")
    return ranked.where(F.col("start") % stride == 0).drop("_one", "start")


def greedy_chunks(docs: DataFrame, chunk_chars: int = 700, overlap: int = 80, min_chars: int = 40, separator: str = r"\n\s*\n") -> DataFrame:
    """doc_id, chunk (from 1), text, accepted: paragraphs packed up to `chunk_chars`; a longer one is cut into windows that overlap. Short chunks are kept but not accepted."""
    paras = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), separator), collapsed), lambda p: p != "")
    step = chunk_chars - overlap

    def windows(p: Column) -> Column:
        last = F.greatest(F.ceil((F.length(p) - chunk_chars) / step), F.lit(0)).cast("int")
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(p, i * step + 1, F.lit(chunk_chars)))), lambda c: c != "")

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def fold(acc: Column, p: Column) -> Column:
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return (
            F.when(F.length(p) > chunk_chars, F.struct(F.concat(closed, windows(p)).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) <= chunk_chars, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(closed.alias("done"), p.alias("open")))
        )

    chunks = F.aggregate(paras, start, fold, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    rows = docs.select("doc_id", F.posexplode(chunks).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("chunk"), "text", (F.length("text") >= min_chars).alias("accepted"))
