"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Everything of a document is computed in its own row: no user function, no shuffle. Repeated windows are found with sorted
hashes: each 8-word window becomes one long (as many bits of its hash as its position, below, leaves free), the longs are
sorted as primitives, and equal neighbours are confirmed word by word. Where neighbours of one hash differ in words, all
windows of that hash are compared with each other, so that no repeat is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "der", "die", "und", "das", "den", "mit", "zu", "ein", "eine", "von", "le", "la", "les", "de", "des", "et", "un", "une", "que", "pour", "el", "los", "las", "y", "en", "por", "con", "una", "no"]

#: (metric, least, most, words from which the rule holds): a document fails a rule whose metric lies outside. None: no limit.
RULES = [
    ("n_words", 20, None, 0),
    ("repeat_word_percent", None, 30, 0),
    ("mean_word_chars", 2, 14, 20),
    ("symbol_percent_of_words", None, 10, 20),
    ("dup_line_percent", None, 30, 20),
    ("bullet_line_percent", None, 90, 20),
    ("ellipsis_line_percent", None, 30, 20),
    ("stop_word_percent", 2, None, 80),
    ("upper_word_percent", None, 60, 20),
    ("bar_percent_of_words", None, 20, 20),
    ("exclaimed_word_percent", None, 30, 20),
]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def measured(docs: DataFrame, text_col: str = "text", hash_mask: int = -1) -> DataFrame:
    """`docs` with the counts and ratios that rules refer to. Intermediate columns carry the prefix _q_ and are dropped. hash_mask: the bits of a window's hash that are used; any choice gives the same counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    kept = docs.columns
    d = docs.select("*", words.alias("_q_w"), lines.alias("_q_l"), text.alias("_q_t"))
    d = d.select("*", F.size("_q_w").cast("long").alias("n_words"), F.transform("_q_w", lambda w: F.xxhash64(w)).alias("_q_h"))

    # bits that hold every position
    d = d.select("*", F.ceil(F.log2(F.col("n_words") + 1)).cast("int").alias("_q_b"))

    def window(i: Column) -> Column:
        hashed = F.xxhash64(F.slice("_q_h", i + 1, WINDOW))
        hashed = hashed if hash_mask == -1 else hashed.bitwiseAND(F.lit(hash_mask))
        return F.call_function("shiftleft", F.call_function("shiftright", hashed, F.col("_q_b")), F.col("_q_b")).bitwiseOR(i.cast("long"))

    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.select("*", F.sort_array(F.transform(starts, window)).alias("_q_s"))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_q_b")) - 1).cast("int")
    hashed = lambda x: F.call_function("shiftright", x, F.col("_q_b"))
    words_at = lambda x: F.slice("_q_w", place(x) + 1, WINDOW)
    same = lambda x, y: F.coalesce((hashed(x) == hashed(y)) & (words_at(x) == words_at(y)), F.lit(False))
    # neighbours of one hash with other words: a third window may lie between two equal ones
    mixed = F.filter("_q_s", lambda x, i: F.coalesce((hashed(x) == hashed(F.get("_q_s", i + 1))) & (words_at(x) != words_at(F.get("_q_s", i + 1))), F.lit(False)))
    d = d.select("*", F.transform(mixed, hashed).alias("_q_m"))
    again = F.filter("_q_s", lambda x, i: same(x, F.get("_q_s", i + 1)) | same(x, F.get("_q_s", i - 1)))
    among = F.filter("_q_s", lambda x: F.array_contains("_q_m", hashed(x)))
    all_pairs = F.filter(among, lambda x: F.exists(among, lambda y: (x != y) & same(x, y)))
    again = F.when(F.size("_q_m") == 0, again).otherwise(F.array_union(again, all_pairs))
    d = d.select("*", F.sort_array(F.transform(again, place)).alias("_q_p"))
    covered = F.aggregate(F.transform("_q_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_p", i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda array, f: F.size(F.filter(array, f)).cast("long")
    n, lines_n = F.col("n_words"), F.size("_q_l").cast("long")
    d = d.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        F.char_length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        (F.char_length("_q_t") - F.char_length(F.regexp_replace("_q_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (lines_n - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        lines_n.alias("_q_lines"),
        count("_q_l", lambda x: F.btrim(x, F.lit(WHITE)).rlike("^[•*-]")).alias("_q_bullets"),
        count("_q_l", lambda x: F.btrim(x, F.lit(WHITE)).rlike(r"(\.\.\.|…)$")).alias("_q_dots"),
        count("_q_w", lambda w: F.lower(w).isin(STOP_WORDS)).alias("_q_stops"),
        count("_q_w", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.char_length(w) > 1)).alias("_q_upper"),
        count("_q_w", lambda w: w == "|").alias("_q_bars"),
        count("_q_w", lambda w: w.endswith("!")).alias("_q_exclaimed"),
    )
    return d.select(
        *[F.col(f"`{c}`") for c in kept],
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        _ratio(F.col("n_repeat_words"), n).alias("repeat_word_percent"),
        F.when(n > 0, F.col("word_chars") / n).otherwise(0.0).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_percent_of_words"),
        _ratio(F.col("n_dup_lines"), F.col("_q_lines")).alias("dup_line_percent"),
        _ratio(F.col("_q_bullets"), F.col("_q_lines")).alias("bullet_line_percent"),
        _ratio(F.col("_q_dots"), F.col("_q_lines")).alias("ellipsis_line_percent"),
        _ratio(F.col("_q_stops"), n).alias("stop_word_percent"),
        _ratio(F.col("_q_upper"), n).alias("upper_word_percent"),
        _ratio(F.col("_q_bars"), n).alias("bar_percent_of_words"),
        _ratio(F.col("_q_exclaimed"), n).alias("exclaimed_word_percent"),
    )


def compiled(rules: list[tuple] = RULES) -> Column:
    """The names of the rules that a row of measured() fails, in the table's order."""

    def failed(metric: str, least: float | None, most: float | None, from_words: int) -> Column:
        value = F.col(metric)
        out = reduce(Column.__or__, [value < least] * (least is not None) + [value > most] * (most is not None), F.lit(False))
        return F.when(out & (F.col("n_words") >= from_words), F.lit(metric))

    return F.array_compact(F.array(*[failed(*r) for r in rules]))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """Per row of `docs`: doc_id, the counts, base_failed, kept and failed_rules.

    Words are runs without white space ([^\\x20\\x09-\\x0D]); lines are divided by \\n, and those without a word don't
    count as repeated. base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows found twice or more.
    kept: no rule of the table fails. A null or empty text has no words (base_failed). A null doc_id stays null;
    repeated rows are judged one by one; no rows give none. Other columns are dropped, so their names can't clash.
    """
    d = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_q_in")), "_q_in").select("*", compiled(rules).alias("failed_rules"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base.alias("base_failed"),
        (~base & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules",
    )
