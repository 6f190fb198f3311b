"""Text columns: tokens, normal forms, fingerprints, numbers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that retrieval and answer verification drop.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had",
    "having", "of", "for", "to", "in", "on", "at", "by", "with", "from", "as", "and", "or", "but", "if", "then", "else",
    "than", "that", "this", "these", "those", "it", "its", "they", "them", "their", "he", "she", "his", "her", "him",
    "we", "our", "us", "you", "your", "i", "me", "my", "what", "which", "who", "whom", "whose", "when", "where", "why",
    "how", "not", "no", "yes", "can", "could", "would", "should", "may", "might", "must", "shall", "will", "won",
    "wont", "there", "here", "also", "such", "some", "any", "all", "each", "more", "most", "less", "least", "very",
    "only", "just", "even", "into", "onto", "about", "between", "during", "after", "before", "above", "below", "over",
    "under", "again", "still", "yet", "so", "because", "while", "until", "though", "although",
]
# Function words that the pairwise fact check drops.
FACT_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "for", "of", "on", "in", "to", "at", "and",
    "or", "our", "we", "this", "that", "by", "with", "as", "it", "its", "their", "there", "will", "have", "has", "had",
    "from",
]
# Markers of negation or cancellation.
NEGATIONS = [
    "not", "never", "no", "none", "cannot", "cant", "wont", "without", "failed", "fail", "cancelled", "canceled",
    "denied", "deny", "neither", "nor", "nothing",
]
# Fixed values.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT_MONTHS = ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
# Words that stand for numbers.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
# Pairs of words that turn a fact around.
ANTONYMS = [
    ("increase", "decrease"), ("increased", "decreased"), ("rise", "fall"), ("rose", "fell"), ("up", "down"),
    ("approved", "rejected"), ("approve", "reject"), ("accept", "reject"), ("accepted", "rejected"), ("safe", "unsafe"),
    ("secure", "insecure"), ("allow", "deny"), ("allowed", "denied"), ("grant", "revoke"), ("granted", "revoked"),
    ("enable", "disable"), ("enabled", "disabled"), ("open", "closed"), ("start", "stop"), ("launch", "recall"),
    ("budget", "deficit"), ("surplus", "deficit"), ("profit", "loss"), ("visit", "leave"), ("arrive", "depart"),
    ("located", "relocated"), ("ships", "slips"), ("success", "failure"), ("pass", "fail"), ("before", "after"), ("buy", "sell"),
]
# An obligation against a permission or an option.
MODALS = [("must", "may"), ("must", "might"), ("shall", "may"), ("shall", "might"), ("required", "optional"), ("required", "may"), ("mandatory", "optional"), ("mandatory", "may")]
# Titles that may stand before a name, and words that are no names.
HONORIFICS = [
    "king", "queen", "prince", "princess", "lord", "lady", "sir", "dame", "dr", "mr", "mrs", "ms", "ms.", "saint", "st",
    "st.", "mount", "mt", "mt.", "lake", "river", "cape", "the", "a", "an",
]
NO_NAMES = ["fact", "facts", "answer", "question", "context", "yes", "no"]

# What counts as a token, and as a run of capitalised words.
TOKEN = "[A-Za-z0-9']+"
NAME_RUN = r"\b[A-Z][A-Za-z]*(?:[-'][A-Za-z]+)*(?:\s+[A-Z][A-Za-z]*(?:[-'][A-Za-z]+)*)*\b"


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often and in whatever lambda the body refers to it."""
    return F.transform(F.array(value), body)[0]


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    return raw_tokens(F.lower(text))


def content_tokens(text: Column, exclude: Column | None = None) -> Column:
    """Tokens of two characters or more that are no function words, with repetitions; those of `exclude` left out."""
    keep = lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS)
    found = F.filter(tokens(text), keep)
    return found if exclude is None else bound(exclude, lambda e: F.filter(found, lambda t: ~F.array_contains(e, t)))


def fact_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(FACT_STOP_WORDS))


def numeric_strings(text: Column) -> Column:
    """Numbers as they are written, then months, each once, in order."""
    text = F.coalesce(text, F.lit(""))
    months = F.filter(tokens(text), lambda t: t.isin(MONTHS + SHORT_MONTHS))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), months))


def number_values(text: Column) -> Column:
    """The distinct numbers of a text: runs of digits, and number words one by one."""
    t = tokens(text)
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    digits = F.flatten(F.transform(t, lambda x: F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda d: d.try_cast("decimal(38,0)"))))
    said = F.transform(F.filter(t, lambda x: x.isin(list(NUMBER_WORDS))), lambda x: words[x].cast("decimal(38,0)"))
    return F.array_distinct(F.concat(digits, said))


def proper_nouns(text: Column) -> Column:
    """Distinct lower-case tokens that begin with a capital, without the first token, weekdays and months."""
    t = raw_tokens(text)
    capital = F.filter(t, lambda x, i: (i > 0) & x.rlike("^[A-Z]"))
    return F.array_distinct(F.filter(F.transform(capital, F.lower), lambda x: ~x.isin(WEEKDAYS + MONTHS)))


def collapsed(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_paragraph(text: Column) -> Column:
    """Without zero-width characters, in lower case, white space collapsed."""
    return F.lower(collapsed(F.regexp_replace(text, "[​‌‍⁠﻿]", "")))


def fingerprint(text: Column) -> Column:
    """SHA-1 of the normal form; null where that is empty."""
    return bound(normal_paragraph(text), lambda normal: F.when(normal != "", F.sha1(F.encode(normal, "utf-8"))))


def anchor_form(text: Column) -> Column:
    """Without the possessive 's, in lower case, punctuation as spaces, white space collapsed."""
    bare = F.regexp_replace(text, r"(?i)['’]s\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def entity_form(span: Column) -> Column:
    """The anchor form without titles at its beginning."""
    titles = "|".join(h for h in HONORIFICS if "." not in h)
    return F.trim(F.regexp_replace(anchor_form(span), rf"^(?:(?:{titles})(?: |$))+", ""))


def name_runs(text: Column) -> Column:
    """Runs of capitalised words as structs (span, norm), the first of each normal form; too short ones and plain words are left out."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME_RUN), F.lit(0)), lambda s: F.struct(s.alias("span"), entity_form(s).alias("norm")))
    plain = sorted({*NO_NAMES, *STOP_WORDS, *MONTHS, *SHORT_MONTHS})
    named = F.filter(runs, lambda r: (F.length(r["norm"]) >= 3) & F.exists(F.split(r["norm"], " "), lambda p: ~p.isin(plain)))
    empty = F.array().cast("array<struct<span:string,norm:string>>")
    return F.aggregate(named, empty, lambda a, r: F.when(F.exists(a, lambda x: x["norm"] == r["norm"]), a).otherwise(F.array_append(a, r)))


def paragraphs(text: Column, separator: str = "\n\n", min_chars: int = 1) -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), collapsed), lambda p: F.length(p) >= min_chars)


def domain_of(label: Column) -> Column:
    """The tag in brackets at a label's beginning, else NONE."""
    tag = F.regexp_extract(F.coalesce(label, F.lit("")), r"^\[([^\]]+)\]", 1)
    return F.when(tag == "", "NONE").otherwise(tag)


def half_query(text: Column) -> Column:
    """The first max(8, n / 2) words of a text."""
    words = F.split(F.trim(text), r"\s+")
    return F.array_join(F.slice(words, 1, F.greatest(F.lit(8), F.floor(F.size(words) / 2).cast("int"))), " ")


def first_json(text: Column) -> Column:
    """From the first { to the last }; null without both."""
    out = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(out != "", out)
