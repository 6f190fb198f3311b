"""Licence scans: a positional index of licence templates, entered by each file's rarest licence words.

The words of all templates are counted over all documents once (documents that hold a word; as many numbers as the
templates have words). A document asks a template only if it holds all words of the template's mandatory phrases. It then looks
up its rarest words of that template, takes each posting's place from the word's own, and keeps the relative places
at which enough of these words agree, within a few words. There the mandatory phrases must stand word by word, the
excluded ones must not, and enough of the template's weight must be found.

All of it is in built-in functions: two projections over the texts, one small aggregation, no shuffle of texts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words: all of ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_GNU = "you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"

#: Fixed values, from the public texts of the licences: (label, words of the template, phrases that must stand in it, phrases that must not).
TEMPLATES: list[tuple[str, str, list[str], list[str]]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS, ["free of charge to any person obtaining a copy of this software", "to deal in the software without restriction"], []),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", ["for any purpose with or without fee is hereby granted"], []),
    ("bsd-2-clause", _BSD, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"], ["neither the name of"]),
    ("bsd-3-clause", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["redistribution and use in source and binary forms", "neither the name of", "endorse or promote products derived from this software"], []),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["apache license version 2 0", "except in compliance with the license"], []),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"], []),
    ("gpl-2.0", _GNU.format("general", "2"), ["gnu general public license", "either version 2 of the license"], []),
    ("gpl-3.0", _GNU.format("general", "3"), ["gnu general public license", "either version 3 of the license"], []),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"], []),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"], []),
    ("lgpl-2.1", _GNU.format("lesser general", "2 1"), ["gnu lesser general public license", "either version 2 1 of the license"], []),
    ("lgpl-3.0", _GNU.format("lesser general", "3"), ["gnu lesser general public license", "either version 3 of the license"], []),
    ("lgpl", "licensed under the gnu lesser general public license version", ["gnu lesser general public license"], []),
    ("agpl-3.0", _GNU.format("affero general", "3"), ["gnu affero general public license", "either version 3 of the license"], []),
    ("agpl", "licensed under the gnu affero general public license version", ["gnu affero general public license"], []),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license v 2 0"], []),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ["eclipse public license"], []),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented", ["the origin of this software must not be misrepresented"], []),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license"], []),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software released into the public domain"], []),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license", ["do what the fuck you want to"], []),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"], []),
    ("mit", "released under the mit license", ["under the mit license"], []),
]
# Notices of the public licences of one family, and identifiers in source files, follow from a rule.
_CC = [("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives")]
for _id, _name in _CC:
    _say, _longer = f"cc {_id.replace('-', ' ')}", [x.replace("-", " ") for x, _ in _CC if x.startswith(_id + "-")]
    TEMPLATES.append((f"cc-{_id}", f"licensed under {_say}", [_say], [f"cc {x}" for x in _longer]))
    TEMPLATES.append((f"cc-{_id}", f"this work is licensed under a creative commons {_name} 4 0 international license", [f"creative commons {_name}"], [f"creative commons {n}" for _, n in _CC if n.startswith(_name + " ")]))
for _id in ["mit", "apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "isc"]:
    _said = f"spdx license identifier {_id.replace('-', ' ').replace('.', ' ')}"
    TEMPLATES.append((_id, _said, [_said], []))

#: A document looks up so many of its rarest words of a template.
RARE = 8
#: Relative places are one if they fall into one of two rows of bins of this width, half a width apart.
WIDTH = 16
#: Percent of a template's weight that must be found at its place.
LEAST_PERCENT = 60


def words_of(text: Column) -> Column:
    """The words of a text in their order; none of a null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def needed(words: list[str], rare: int = RARE) -> int:
    """How many of the rare words must agree on a place: half of those that can be looked up, two at least."""
    return max(2, (min(rare, len(set(words))) + 1) // 2)


def vocabulary(templates: list[tuple]) -> list[str]:
    return sorted({w for _, text, must, never in templates for w in text.split() + [x for p in must for x in p.split()]} | {w for p, _ in BASE for w in p.split()})


def word_weights(words: DataFrame, vocab: list[str]) -> dict[str, int]:
    """For each word of the templates the binary digits of N / (documents with it + 1), rounded down: its weight, greater for rarer words. One row a word comes to the driver."""
    found = words.select(F.explode(F.array_append(F.array_intersect(F.lit(vocab), "w"), F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    df = {r["w"]: r["df"] for r in found.collect()}
    return {w: (df.get("", 0) // (df.get(w, 0) + 1)).bit_length() for w in vocab}


_TABLE = "array<struct<label:string,words:array<string>,weights:array<int>,asked:array<string>,must:array<string>,never:array<string>,postings:array<struct<w:string,q:int>>,len:int,need:int,total:int>>"


def _table(templates: list[tuple], weights: dict[str, int], rare: int) -> Column:
    """The templates with their words by weight and the places of their words, as a constant."""
    out = []
    for label, text, must, never in templates:
        words = text.split()
        by_weight = sorted(set(words), key=lambda w: (-weights[w], w))
        out.append({
            "label": label, "words": by_weight, "weights": [weights[w] for w in by_weight], "asked": sorted({w for p in must for w in p.split()}), "must": [f" {p} " for p in must], "never": [f" {p} " for p in never],
            "postings": [{"w": w, "q": q} for q, w in enumerate(words)], "len": len(words), "need": needed(words, rare), "total": max(1, sum(weights[w] for w in by_weight)),
        })
    return F.from_json(F.lit(json.dumps(out)), _TABLE)


def _agreed(t: Column, looked: Column, hits: Column, width: int) -> Column:
    """The bins of relative places at which enough of the words looked up agree."""
    pairs = F.flatten(
        F.transform(
            hits,
            lambda h: F.flatten(
                F.transform(
                    F.filter(t["postings"], lambda x: x["w"] == h["w"]),
                    lambda x: F.transform(F.array(F.lit(0), F.lit(width // 2)), lambda s: (F.floor((h["p"] - x["q"] + s) / width) * 2 + F.when(s > 0, 1).otherwise(0)) * 64 + F.array_position(looked, h["w"])),
                )
            ),
        )
    )
    pairs = F.sort_array(F.array_distinct(F.transform(pairs, lambda x: x.cast("long"))))
    bin_ = lambda x: F.floor(x / 64)
    # word and bin are a number each time: a bin has enough words if the number `need` - 1 places on is of the same bin
    first = F.filter(F.transform(pairs, lambda x, i: F.struct(bin_(x).alias("b"), (~bin_(x).eqNullSafe(bin_(F.get(pairs, i - 1))) & bin_(x).eqNullSafe(bin_(F.get(pairs, i + t["need"] - 1)))).alias("ok"))), lambda x: x["ok"])
    return F.transform(first, lambda x: x["b"])


def scan_licenses(docs: DataFrame, templates: list[tuple] = TEMPLATES, rare: int = RARE, width: int = WIDTH, least_percent: int = LEAST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case. n_base counts the places of the base phrases, first_word
    and last_word are the smallest and largest of them (null without one). matches: (label, share, start) of each verified
    place of a template, start being the least word at which it can begin. labels: those of matches and base phrases. score: the
    largest share of a template's weight found at a verified place, at least 0.5 with a base phrase, else 0. Copies of one
    template in a text are a match each, places in two bins (half a width apart) may be given twice. A null or empty text has no words and no labels
    (empty strings). A null doc_id stays null; repeated rows are judged one by one; no rows give none. Other columns are
    dropped, so their names can't clash.
    """
    if rare > 62:
        raise ValueError("rare must be 62 or less: bins and words share a number")
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    vocab = vocabulary(templates)
    weights = word_weights(rows.select("w"), vocab)
    table = _table(templates, weights, rare)

    d = rows.select("*", F.array_intersect(F.lit(vocab), "w").alias("known"))
    d = d.select("*", F.filter(table, lambda t: F.size(F.array_except(t["asked"], F.col("known"))) == 0).alias("asked"))
    d = d.select("*", F.transform("asked", lambda t: F.slice(F.array_intersect(t["words"], F.col("known")), 1, rare)).alias("looked"))
    none = F.array().cast("array<struct<w:string,p:int>>")
    placed = lambda cond: F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("p"))), cond)
    d = d.select("*", F.when(F.size("asked") > 0, F.array_distinct(F.flatten("looked"))).alias("of"))
    d = d.select("*", F.when(F.size("asked") > 0, placed(lambda x: F.array_contains("of", x["w"]))).otherwise(none).alias("hits"))

    def base(phrase: str) -> Column:
        head, *rest = phrase.split()
        at = placed(lambda x: reduce(Column.__and__, [F.get("w", x["p"] + k + 1) == w for k, w in enumerate(rest)], x["w"] == head))
        at = F.transform(at, lambda x: F.struct(x["p"].alias("p"), F.lit(phrase).alias("phrase")))
        return F.when(F.size(F.array_except(F.lit(phrase.split()), "known")) == 0, at).otherwise(F.array().cast("array<struct<p:int,phrase:string>>"))

    places = F.flatten(F.array(*[base(p) for p, _ in BASE]))
    bins = F.transform(F.arrays_zip("asked", "looked"), lambda x: F.struct(x["asked"].alias("t"), _agreed(x["asked"], x["looked"], F.filter("hits", lambda h: F.array_contains(x["looked"], h["w"])), width).alias("bins")))
    d = d.select("doc_id", "w", places.alias("places"), bins.alias("bins"))

    def window(t: Column, b: Column) -> Column:
        start = F.floor(b / 2).cast("int") * width - F.when(F.pmod(b, F.lit(2)) == 1, width // 2).otherwise(0)
        begin = F.greatest(start, F.lit(0))
        part = F.slice("w", begin + 1, F.greatest(start + t["len"] + 2 * width - begin, F.lit(0)))
        return F.struct(t["label"].alias("label"), t.alias("t"), begin.alias("start"), part.alias("part"), F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")).alias("said"))

    def found(x: Column) -> Column:
        there = F.array_intersect(x["t"]["words"], x["part"])
        weight = F.aggregate(F.zip_with(x["t"]["words"], x["t"]["weights"], lambda w, v: F.when(F.array_contains(there, w), v).otherwise(0)), F.lit(0), lambda a, v: a + v)
        return F.struct(x["label"].alias("label"), (weight * 1.0 / x["t"]["total"]).cast("double").alias("share"), (weight * 100 >= x["t"]["total"] * least_percent).alias("enough"), x["start"].cast("long").alias("start"))

    windows = F.flatten(F.transform("bins", lambda x: F.transform(x["bins"], lambda b: window(x["t"], b))))
    verified = F.filter(windows, lambda x: F.forall(x["t"]["must"], lambda p: F.contains(x["said"], p)) & ~F.exists(x["t"]["never"], lambda p: F.contains(x["said"], p)))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"), "places", F.filter(F.transform(verified, found), lambda x: x["enough"]).alias("found"))
    of_phrase = lambda x: F.coalesce(*[F.when(x["phrase"] == p, name) for p, name in BASE])
    own = F.array_sort(F.array_distinct(F.transform("places", of_phrase)))
    d = d.select("*", own.alias("own"))
    return d.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["p"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["p"])).cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share"), x["start"].alias("start"))).alias("matches"),
    )
