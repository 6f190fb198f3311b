"""Retrieval in two passes: the second one's queries come from the texts that the first has found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators import lexical
from recollect.session import stored

# Capitalised words that begin sentences and are no names.
SENTENCE_OPENERS = [
    "The", "A", "An", "This", "That", "These", "Those", "It", "They", "He", "She", "His", "Her", "Their", "Its", "There", "Here", "What",
    "When", "Where", "Who", "Why", "How", "Is", "Are", "Was", "Were", "Be", "Been", "Being", "Has", "Have", "Had", "Do", "Does", "Did",
    "Plot", "Awards", "Government", "Education", "Anything", "Released", "Although", "Because", "However", "Beginning",
]
# What counts as a name. A word with a letter beyond ASCII is no part of one, and is taken out first.
NAME = r"\b([A-Z][A-Za-z]+(?:[\s.\-][A-Z][A-Za-z]+)*)\b"
FOREIGN_WORD = r"[A-Za-z0-9_]*[À-ɏͰ-῿][A-Za-z0-9_À-ɏͰ-῿]*"


def feedback_names(texts: Column, question: Column, most: int = 6) -> Column:
    """The first `most` names in an array of texts, in their order; those that the question holds (in any case) and repeated ones don't count. A null text has none."""
    found = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.regexp_extract_all(F.regexp_replace(t, FOREIGN_WORD, "_"), F.lit(NAME), F.lit(1))))
    asked = F.lower(F.coalesce(question, F.lit("")))
    new = F.filter(found, lambda n: ~n.isin(SENTENCE_OPENERS) & ~F.contains(asked, F.lower(n)))
    keys = F.slice(F.array_distinct(F.transform(new, F.lower)), 1, most)
    return F.transform(keys, lambda k: F.get(F.filter(new, lambda n: F.lower(n) == k), F.lit(0)))


def expanded_queries(first: DataFrame, texts: DataFrame, questions: DataFrame, feedback: int = 3, most: int = 6) -> DataFrame:
    """first: query_id, rank, cell_id; texts: cell_id, text; questions: query_id, text. Per question query_id, names (from the texts of its first `feedback` cells) and text, the question followed by the names."""
    top = first.where(F.col("rank") <= feedback).select("query_id", "rank", "cell_id").join(texts.select("cell_id", F.col("text").alias("cell_text")), "cell_id", "left")
    found = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cell_id", "cell_text"))).alias("s"))
    names = feedback_names(F.transform("s", lambda x: x["cell_text"]), F.col("text"), most)
    joined = questions.join(found, "query_id", "left").select("query_id", "text", F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    return joined.select("query_id", "names", F.trim(F.concat_ws(" ", F.col("text"), F.array_join("names", " "))).alias("text"))


def two_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both: query_id, rank, cell_id. The union of their cells: query_id, cell_id, pass (the first that found it), rank (there) and place, those of the first pass before the others."""
    both = first.select("query_id", "cell_id", F.lit(1).alias("pass"), "rank").unionByName(second.select("query_id", "cell_id", F.lit(2).alias("pass"), "rank"))
    kept = both.groupBy("query_id", "cell_id").agg(F.min(F.struct("pass", "rank")).alias("s")).select("query_id", "cell_id", "s.*")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pass", "rank", "cell_id")))


def iterative(first: DataFrame, texts: DataFrame, questions: DataFrame, index: dict[str, DataFrame], k: int = 10, feedback: int = 3, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(the expanded questions, the cells of both passes). The first pass and the second one's questions are stored; no question is handled by the driver."""
    first = stored(first.select("query_id", "rank", "cell_id"), "first_pass")
    asked = stored(expanded_queries(first, texts, questions, feedback, most), "second_queries")
    second = lexical.bm25_topk(index, asked.select("query_id", "text"), k).select("query_id", "rank", F.col("doc_id").alias("cell_id"))
    return asked, two_passes(first, second)
