"""The pairwise fact check: detectors that find a turned fact, and the verdict they lead to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import ANTONYMS, FACT_STOP_WORDS, MODALS, MONTHS, NEGATIONS, WEEKDAYS, fact_tokens, number_values, proper_nouns, tokens


def _both_have_more(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def entity_mismatch(q: Column, c: Column) -> Column:
    return _both_have_more(proper_nouns(q), proper_nouns(c))


def number_mismatch(q: Column, c: Column) -> Column:
    return _both_have_more(number_values(q), number_values(c))


def _differ(q: Column, c: Column, words: list[str]) -> Column:
    said = lambda x: F.array_sort(F.array_distinct(F.filter(tokens(x), lambda t: t.isin(words))))
    a, b = said(q), said(c)
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def date_mismatch(q: Column, c: Column) -> Column:
    return _differ(q, c, WEEKDAYS) | _differ(q, c, MONTHS)


def negation_flip(q: Column, c: Column) -> Column:
    denies = lambda x: F.exists(tokens(x), lambda t: t.isin(NEGATIONS))
    return denies(q) != denies(c)


def _opposed(q: Column, c: Column, pairs: list[tuple[str, str]]) -> Column:
    table = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])
    a, b = tokens(q), tokens(c)
    has = F.array_contains
    return F.exists(table, lambda p: (has(a, p[0]) & has(b, p[1])) | (has(a, p[1]) & has(b, p[0])))


def antonym_flip(q: Column, c: Column) -> Column:
    return _opposed(q, c, ANTONYMS)


def modal_flip(q: Column, c: Column) -> Column:
    return _opposed(q, c, MODALS)


#: In the order in which a rejection names them.
DETECTORS: dict[str, Callable[[Column, Column], Column]] = {
    "entity": entity_mismatch,
    "number": number_mismatch,
    "date": date_mismatch,
    "negation": negation_flip,
    "antonym": antonym_flip,
    "modal": modal_flip,
}

# Pairs of sentences that say the same.
PARAPHRASES = [
    ("the client meeting is on tuesday morning", "there is a morning client meeting on tuesday"),
    ("nightly backups are stored in the frankfurt region", "we keep nightly backups in the frankfurt region"),
]


def fact_key(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(fact_tokens(text))), " ")


def strong_containment(q: Column, c: Column) -> Column:
    """Whether the smaller set of content tokens, three at least, lies within the other."""
    a, b = F.array_distinct(fact_tokens(q)), F.array_distinct(fact_tokens(c))
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return (F.size(small) >= 3) & (F.size(F.array_except(small, large)) == 0)


def paraphrase(q: Column, c: Column, pairs: list[tuple[str, str]] = PARAPHRASES) -> Column:
    keys = [tuple(" ".join(sorted({w for w in x.split() if w not in FACT_STOP_WORDS})) for x in p) for p in pairs]
    a, b = fact_key(q), fact_key(c)
    found = F.lit(False)
    for x, y in keys:
        found = found | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return found


def with_detections(pairs: DataFrame, q: str = "query", c: str = "candidate") -> DataFrame:
    """`pairs` with a boolean per detector."""
    return pairs.select("*", *[f(F.col(q), F.col(c)).alias(f"{name}_flip") for name, f in DETECTORS.items()])


def with_verdict(pairs: DataFrame, q: str = "query", c: str = "candidate", without: str | None = None) -> DataFrame:
    """`pairs` with the detections and verdict: reject if a detector (but for `without`) speaks, else accept equal, contained or known pairs, else ambiguous."""
    d = with_detections(pairs, q, c)
    hit = F.lit(False)
    for name in DETECTORS:
        if name != without:
            hit = hit | F.col(f"{name}_flip")
    a, b = F.col(q), F.col(c)
    accept = (fact_key(a) == fact_key(b)) | strong_containment(a, b) | paraphrase(a, b)
    return d.withColumn("verdict", F.when(hit, "reject").when(accept, "accept").otherwise("ambiguous"))


def ablation(pairs: DataFrame, q: str = "query", c: str = "candidate") -> DataFrame:
    """Per detector left out (and none): how many pairs are rejected, accepted and ambiguous. Detections are computed once."""
    d = with_verdict(pairs, q, c)
    a, b = F.col(q), F.col(c)
    accept = (fact_key(a) == fact_key(b)) | strong_containment(a, b) | paraphrase(a, b)
    d = d.select(*[f"{n}_flip" for n in DETECTORS], accept.alias("acceptable"))
    masked = F.array(*[F.struct(F.lit(x).alias("without"), F.array(*[F.lit(False) if n == x else F.col(f"{n}_flip") for n in DETECTORS]).alias("f")) for x in ["none", *DETECTORS]])
    rows = d.select("acceptable", F.explode(masked).alias("m")).select("acceptable", "m.without", F.exists("m.f", lambda v: v).alias("hit"))
    return rows.groupBy("without").agg(
        F.count_if("hit").alias("rejected"), F.count_if(~F.col("hit") & F.col("acceptable")).alias("accepted"), F.count_if(~F.col("hit") & ~F.col("acceptable")).alias("ambiguous")
    )
