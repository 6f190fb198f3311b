"""Splits, token arrays and small text rules of corpus preparation and training blocks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import bound
from recollect.operators.corpus import global_offsets, keep_first, padded, running_sums, shuffled_key

END_OF_TEXT = 50256
# Paragraphs of extracted pages that are no text: page numbers, captions, headings, addresses, bullets; and entries of a bibliography.
JUNK = [r"^\s*\d+\s*$", r"(?i)^(figure|table|fig\.|tab\.)\s+\d", r"(?i)^\s*references\s*$", r"(?i)^\s*abstract\s*$", r"(?i)^\s*acknowledgements?\s*$", r"^\s*https?://", r"^[•●■▪►▸\-–—]\s"]
BIBLIOGRAPHY = r"^\[?\d{1,3}\]?\s*[A-Z][a-z]+"


def title_form(title: Column) -> Column:
    """A title in lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def titles(rows: DataFrame, column: str) -> DataFrame:
    """The distinct titles in their normal form, without empty ones."""
    return rows.select(title_form(F.col(column)).alias("title")).where("title <> ''").distinct()


def title_overlap(bank: DataFrame, corpus: DataFrame) -> DataFrame:
    """bank, corpus: title, distinct. One row: n_bank, n_corpus, n_shared and the first shared title."""
    both = bank.join(corpus, "title", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"), F.min("title").alias("first_shared"))
    count = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    return count(bank, "n_bank").join(F.broadcast(count(corpus, "n_corpus"))).join(F.broadcast(both))


def page_paragraphs(text: Column, least: int = 80, most: int = 800) -> Column:
    """The paragraphs of a page's extracted text: words broken over lines are joined, long paragraphs packed anew from their sentences up to `most` characters, short ones and junk left out."""
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " "), r"-\n(\S)", "$1")
    blocks = F.transform(F.split(joined, r"\n\s*\n", -1), lambda c: F.btrim(F.translate(c, "\n", " "), F.lit(" \t\r\f\x0b")))

    def packed(block: Column) -> Column:
        start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

        def step(acc: Column, s: Column) -> Column:
            full = (F.length(acc["open"]) + F.length(s) + 1 > most) & (F.length(acc["open"]) >= least)
            return F.when(full, F.struct(s.alias("open"), F.array_append(acc["done"], F.trim(acc["open"])).alias("done"))).otherwise(F.struct(F.trim(F.concat(acc["open"], F.lit(" "), s)).alias("open"), acc["done"].alias("done")))

        end = lambda acc: F.when(F.length(acc["open"]) >= least, F.array_append(acc["done"], F.trim(acc["open"]))).otherwise(acc["done"])
        return F.aggregate(F.split(block, r"(?<=[.!?])\s+", -1), start, step, end)

    junk = lambda c: F.exists(F.array(*map(F.lit, JUNK)), lambda p: F.regexp_like(c, p)) | (F.regexp_like(c, F.lit(BIBLIOGRAPHY)) & F.contains(F.lower(c), F.lit("doi")))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(blocks, lambda c: F.when(F.length(c) < least, none).when(F.length(c) > most, packed(c)).when(junk(c), none).otherwise(F.array(c))))


def loaded_paragraphs(rows: DataFrame, column: str, key: str, n: int, least: int, most: int, seed: int = 0) -> DataFrame:
    """n texts longer than `least` that begin with no =, cut to `most` characters, in shuffled order."""
    t = F.trim(F.col(column))
    kept = rows.select(F.col(key), t.alias("text")).where((F.length("text") > least) & ~F.startswith("text", F.lit("=")))
    return kept.select(key, F.substring("text", 1, most).alias("text")).orderBy(shuffled_key(seed, F.col(key)), key).limit(n)


def distinct_split(rows: DataFrame, column: str, key: str, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """Distinct texts (the first of equal ones) in shuffled order: the first n_train are train, the next n_test test. Fewer than both need is an error."""
    unique = keep_first(rows.select(key, column), F.col(column), key)
    placed = running_sums(unique.withColumn("_k", shuffled_key(seed, F.col(key))).withColumn("_one", F.lit(1)), ["_k", key], "_one")
    chosen = placed.where(F.col("start") < n_train + n_test)
    if chosen.count() < n_train + n_test:
        raise ValueError(f"fewer than {n_train + n_test} distinct texts")
    return chosen.select(key, F.when(F.col("start") < n_train, "train").otherwise("test").alias("part"))


def row_split(rows: DataFrame, key: str, share: float = 0.05, seed: int = 0) -> DataFrame:
    """part: val for the first share of the rows (rounded down) in shuffled order of the key, else train."""
    n_val = int(rows.count() * share)
    placed = running_sums(rows.withColumn("_k", shuffled_key(seed, F.col(key))).withColumn("_one", F.lit(1)), ["_k", key], "_one")
    return placed.withColumn("part", F.when(F.col("start") < n_val, "val").otherwise("train")).drop("_k", "_one", "start")


def in_first_share(rows: DataFrame, key: str, share: float = 0.05, seed: int = 0) -> Column:
    """Whether a row is of row_split's val, as a column of the row's own key: only the key at the border is looked for, so that no table has to be joined. Equal keys are on one side; a null one stands where an empty text does."""
    n_val = int(rows.count() * share)
    k = shuffled_key(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = running_sums(rows.select(key, k.alias("_k"), F.lit(1).alias("_one")), ["_k", key], "_one")
    border = placed.where(F.col("start") == n_val).select("_k", key).first()
    if border is None:
        return F.lit(n_val > 0)
    return F.coalesce((k < border[0]) | ((k == border[0]) & (F.col(key) < border[1])), F.lit(False))


def positional_split(rows: DataFrame, order: str, share: float = 0.1) -> DataFrame:
    """part: val for the last share (rounded down) in the order of an integer column, else train."""
    n = rows.count()
    n_train = n - int(n * share)
    placed = global_offsets(rows.withColumn("_one", F.lit(1)), order, "_one")
    return placed.withColumn("part", F.when(F.col("start") >= n_train, "val").otherwise("train")).drop("_one", "start")


def held_out_range(rows: DataFrame, order: str, skip: int, take: int) -> DataFrame:
    """The rows after the first `skip`, `take` of them, in the order of an integer column."""
    placed = global_offsets(rows.withColumn("_one", F.lit(1)), order, "_one")
    return placed.where((F.col("start") >= skip) & (F.col("start") < skip + take)).drop("_one", "start")


def whole_chunks(tokens: Column, length: int) -> Column:
    """A token array cut to a multiple of `length`."""
    return F.slice(tokens, 1, (F.floor(F.size(tokens) / length) * length).cast("int"))


def pieces_at(tokens: DataFrame, end: int, more_than: int = 10) -> DataFrame:
    """tokens: doc_id, pos, token. Pieces that end with the token `end` (or with the document), of more than `more_than` tokens: doc_id, piece, n."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.coalesce(F.count_if(F.col("token") == end).over(w), F.lit(0))
    return tokens.withColumn("piece", piece).groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def low_information(tokens: Column, share: float = 0.5, plain: tuple[int, ...] = (0, END_OF_TEXT)) -> Column:
    """Whether tokens that say nothing make up `share` of an array or more; an empty one says nothing."""
    empty = F.size(F.filter(tokens, lambda t: t.isin(*plain)))
    return (F.size(tokens) == 0) | (empty >= share * F.size(tokens))


def retrieval_text(tokens: Column, chunk_text: Column, prompt: Column, least: int = 8, end: int = END_OF_TEXT) -> Column:
    """What a chunk asks the memory with: its own text, or the prompt where fewer than `least` of its tokens are words."""
    return F.when(F.size(F.filter(tokens, lambda t: t != end)) < least, prompt).otherwise(chunk_text)


def known_probe(text: Column, least: int = 20, most: int = 400) -> Column:
    """The first sentence of a text if it has between `least` and `most` characters, else null."""
    first = F.trim(F.get(F.split(text, r"\. "), F.lit(0)))
    return F.when(F.length(first).between(least, most), first)


def placed_at(others: Column, target: Column, place: Column, total: int) -> Column:
    """An array of `total` items: the others in their order, with the target at a place (from 0)."""
    return F.concat(F.slice(others, 1, place), F.array(target), F.slice(others, place + 1, F.lit(total - 1) - place))


def tiled(cell: Column, chunks: int, slots: int) -> Column:
    """One cell's tokens for each of `slots` neighbours of each of `chunks` chunks."""
    return F.array_repeat(F.array_repeat(cell, slots), chunks)


def packed_bundle(tokens: Column, length: int = 64, pad: int = END_OF_TEXT) -> Column:
    """Tokens filled to `length`; more of them are an error, as a cut bundle would lack a fact."""
    return F.when(F.size(tokens) > length, F.raise_error(F.lit(f"a bundle has more than {length} tokens"))).otherwise(padded(tokens, length, pad))


def probe_block(prefix: Column, answer: Column, filler: Column, block: int) -> Column:
    """A struct of x and y, `block` tokens each: filler, prefix and answer at the end; y is x one further, -1 but for the answer."""

    def made(said: Column) -> Column:
        times = F.greatest(F.ceil((F.lit(block + 1) - F.size(said)) / F.size(filler)), F.lit(1)).cast("int")
        return F.slice(F.concat(F.flatten(F.array_repeat(filler, times)), said), -(block + 1), block + 1)

    def masked(full: Column) -> Column:
        y = F.transform(F.slice(full, 2, block), lambda t, i: F.when(i >= F.lit(block) - F.size(answer), t).otherwise(F.lit(-1)))
        return F.struct(F.slice(full, 1, block).alias("x"), y.alias("y"))

    return bound(bound(F.concat(prefix, answer), made), masked)


def oracle_neighbor(tokens: Column, chunk: Column, length: int, neighbor: int) -> Column:
    """The tokens that a chunk is to predict, as its neighbour: those from one past the chunk's start on; the last ones where the text ends before."""
    start = chunk * length + 1
    return F.slice(tokens, F.when(start + neighbor > F.size(tokens), F.greatest(F.size(tokens) - neighbor - 1, F.lit(0))).otherwise(start) + 1, neighbor)


def shifted_windows(tokens: Column, key: Column, block: int, seed: int = 0) -> Column:
    """A struct of x and y: `block` tokens from a place that follows from the key, and those one further."""
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.size(tokens) - block, F.lit(1))).cast("int")
    return F.struct(F.slice(tokens, at + 1, block).alias("x"), F.slice(tokens, at + 2, block).alias("y"))


def ordered_lookup(wanted: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """wanted: list_id, ids (an array). values: those of `value` in the order of the ids, null where there is no row."""
    asked = wanted.select("list_id", F.posexplode("ids").alias("pos", key))
    found = asked.join(rows.select(key, value), key, "left").groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("s"))
    return found.select("list_id", F.transform("s", lambda x: x["v"]).alias("values"))


def coding_items(rows: DataFrame, least: int = 40, most: int = 3000, label: int = 80) -> DataFrame:
    """rows: instruction, output and others. text (both, an empty line between, cut) and label, without items whose output is short."""
    text = F.concat_ws("\n\n", F.trim("instruction"), F.trim("output"))
    return rows.where(F.length(F.trim("output")) >= least).select("*", F.substring(text, 1, most).alias("text"), F.concat(F.lit("[code] "), F.substring(F.trim("instruction"), 1, label)).alias("label"))


def draft_cells(rows: DataFrame) -> DataFrame:
    """rows: batch, drafts (structs of text, draft_id, label, accepted, in order). One row per draft with a text; missing ids and labels follow from its place (from 1)."""
    d = rows.select("batch", F.posexplode("drafts").alias("i", "d"))
    place = F.lpad((F.col("i") + 1).cast("string"), 4, "0")
    named = lambda c, prefix: F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.concat(F.lit(prefix), place)).alias(c)
    return d.select("batch", F.trim("d.text").alias("text"), named("draft_id", "draft-"), named("label", "manual_cell_"), F.coalesce("d.accepted", F.lit(True)).alias("accepted")).where("text <> ''")


def characters(rows: DataFrame, column: str) -> DataFrame:
    """char and id: the characters that occur, numbered from 0 in their order. An alphabet is small: its distinct characters alone are put in order."""
    chars = rows.select(F.explode(F.split(F.col(column), "")).alias("char")).where("char <> ''").distinct()
    return chars.withColumn("id", (F.row_number().over(Window.orderBy(F.hex("char"))) - 1).cast("int"))


def character_codes(rows: DataFrame, key: str, column: str, share: float = 0.1) -> DataFrame:
    """Texts as numbers of their alphabet, and their part in a split by position over all characters: key, start (characters before), codes, n_train (how many of them lie before the last `share`).

    The alphabet is a constant of the plan, bounded by Unicode; it is the only thing that comes to the driver.
    """
    letters = {r["char"]: r["id"] for r in characters(rows, column).collect()}
    text = F.coalesce(F.col(column), F.lit(""))
    placed = running_sums(rows.select(key, text.alias("text"), F.length(text).cast("long").alias("n")), [key], "n")
    cut = placed.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.floor(F.coalesce(F.sum("n"), F.lit(0)) * share)).cast("long").alias("cut"))
    codes = F.from_json(F.lit(json.dumps(letters)), "map<string,int>")
    each = F.filter(F.split("text", ""), lambda c: c != "")
    inside = F.greatest(F.least(F.col("n"), F.col("cut") - F.col("start")), F.lit(0))
    return placed.join(F.broadcast(cut)).select(key, "start", F.transform(each, lambda c: codes[c]).alias("codes"), inside.alias("n_train"))


def halves(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in shuffled order, the first half to fit on and the rest to measure on."""
    chosen = rows.select(key, shuffled_key(seed, F.col(key)).alias("_k")).orderBy("_k", key).limit(n)
    placed = running_sums(chosen.withColumn("_one", F.lit(1)), ["_k", key], "_one")
    return placed.select(key, F.when(F.col("start") < n // 2, "fit").otherwise("eval").alias("part"))


def resume_point(done: DataFrame, items: DataFrame, tail: int = 100) -> DataFrame:
    """done: cell_id, label; items: idx, title. One row: the greatest index among items whose title is one of the last labels written, null without one."""
    last = done.orderBy(F.col("cell_id").desc()).limit(tail).select(title_form(F.col("label")).alias("t")).distinct()
    return items.join(F.broadcast(last), title_form(F.col("title")) == F.col("t"), "left_semi").agg(F.max("idx").alias("resume_after"))


def facts_prompt(question: Column, cells: Column) -> Column:
    """The prompt for a text generator: the cells as facts under their ids, and the question."""
    said = F.filter(cells, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    facts = F.array_join(F.transform(said, lambda c: F.concat(F.lit("["), c["cell_id"].cast("string"), F.lit("] "), c["text"])), "\n")
    # fixed value: the wording
    return F.concat(F.lit("FACTS:\n"), facts, F.lit("\n\nQUESTION: "), question, F.lit("\n\nAnswer using only the FACTS above, with citations."))


def passages(cells: Column) -> Column:
    """The cells' texts with their places (from 1), a line each; a cell without a text keeps its place and has no line."""
    lines = F.filter(F.transform(cells, lambda c, i: F.when(F.coalesce(c["text"], F.lit("")) != "", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["text"]))), lambda x: x.isNotNull())
    return F.array_join(lines, "\n")


def memory_answer(fired: Column) -> Column:
    """A struct of text, cited and refused made of fired cells (structs cell_id, text) alone; nothing fired or found is a refusal."""
    there = F.filter(fired, lambda c: c["text"].isNotNull())
    lines = F.array_join(F.transform(there, lambda c: F.concat(F.lit("- ("), c["cell_id"].cast("string"), F.lit(") "), c["text"])), "\n")
    none = F.coalesce(F.size(there), F.lit(0)) < 1
    # fixed values: the wording
    text = F.when(none, "Memory is silent: no stored memory matched this query.").otherwise(F.concat(F.lit("From memory:\n"), lines))
    return F.struct(text.alias("text"), F.coalesce(F.transform(there, lambda c: c["cell_id"]), F.array().cast("array<long>")).alias("cited"), none.alias("refused"))


# The label before a rewritten question.
SUB_QUESTION = r"(?i)^\s*(SUB-?QUESTION\s*:?\s*)+"


def sub_question(raw: Column, original: Column) -> Column:
    """The first line of a rewritten question that says something, without the label before it; the original where there is none."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r\n|[\n\r]", -1), lambda x: F.trim(F.regexp_replace(F.trim(x), SUB_QUESTION, "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), original)


def gathered(neighbors: DataFrame, tokens: DataFrame) -> DataFrame:
    """neighbors: chunk_id, slot, cell_id; tokens: cell_id, tokens. The neighbours' tokens per chunk in the order of the slots; an unknown cell is null."""
    j = neighbors.join(tokens.select("cell_id", "tokens"), "cell_id", "left").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("slot", "tokens"))).alias("s"))
    return j.select("chunk_id", F.transform("s", lambda x: x["tokens"]).alias("neighbors"))


def looked_up_tokens(hits: DataFrame, tokens: DataFrame, encode, length: int = 64) -> DataFrame:
    """hits: hit_id, cell_id, text; tokens: cell_id, tokens. Stored tokens where there are any, else those that `encode` (of a column) makes of the text, filled with 0."""
    j = hits.join(tokens.select("cell_id", "tokens"), "cell_id", "left")
    return j.select("hit_id", F.coalesce("tokens", padded(encode(F.col("text")), length, 0)).alias("tokens"))


def neighbor_modes(chunks: DataFrame, cells: int, seed: int = 0) -> DataFrame:
    """chunks: chunk_id, neighbors (cell ids, best first). Per chunk and mode (none, random, real, real1) its neighbours: no cell, cells that follow from a hash, all, or the first repeated."""
    size = F.size("neighbors")
    picked = F.transform("neighbors", lambda _, i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("chunk_id").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(cells)))
    modes = {"none": F.array_repeat(F.lit(None).cast("long"), size), "random": picked, "real": F.col("neighbors"), "real1": F.array_repeat(F.get("neighbors", F.lit(0)), size)}
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), v.cast("array<long>").alias("neighbors")) for m, v in modes.items()])
    return chunks.select("chunk_id", F.explode(rows).alias("m")).select("chunk_id", "m.mode", "m.neighbors")


def joined_sources(first: DataFrame, second: DataFrame, key: str = "cell_id") -> DataFrame:
    """Two banks as one: the second one's ids go on above the greatest of the first; source says where a row is from."""
    shift = first.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("_shift"))
    moved = second.join(F.broadcast(shift)).withColumn(key, F.col(key) + F.col("_shift")).drop("_shift")
    return first.withColumn("source", F.lit("first")).unionByName(moved.withColumn("source", F.lit("second")))


def truth(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found: query_id, rank, cell_id; expected: query_id, target. Per expected row the rank of its target, null where it was not found."""
    hit = found.join(expected, "query_id").where("cell_id = target").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.join(hit, "query_id", "left")
