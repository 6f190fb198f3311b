"""Licence scans, centroid clustering and hard negatives: plain versions and edges."""

import hashlib
import math

import numpy as np
import pytest

from recollect.llm.delta_lloyd import delta_lloyd, nearest, reassigned
from recollect.llm.hard_negatives import hard_negatives
from recollect.llm.int_vectors import products
from recollect.llm.license_scan import TEMPLATES, scan_licenses

DOCS = "doc_id long, text string, w string, labels string, places string"
TEXT = {label: text for label, text, _, _ in reversed(TEMPLATES)}


def scanned(spark, texts):
    rows = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in enumerate(texts)], DOCS)
    return [r.asDict() for r in scan_licenses(rows).orderBy("doc_id").collect()]


def test_licenses_by_place(spark):
    filler = "lorem ipsum dolor " * 50
    mit, bsd2, bsd3 = TEXT["mit"], TEXT["bsd-2-clause"], TEXT["bsd-3-clause"]
    words = mit.split()
    out = scanned(
        spark,
        [
            filler + mit.upper() + " " + filler,
            " ".join(words[:30] + ["copyright", "by", "nobody"] + words[30:]),
            " ".join(sorted(words)),
            "permission is hereby granted free of charge",
            bsd2 + " " + filler,
            bsd3 + " " + filler,
            filler + mit + " " + filler + bsd3,
            (mit + " ") * 40,
            "Licensed under CC BY-NC-SA 4.0. Also: Licensed under CC BY 4.0.",
            "SPDX-License-Identifier: GPL-3.0",
            "the mit licensed the license of mit",
            "",
            None,
        ],
    )
    labels = [r["labels"] for r in out]
    assert labels == ["mit", "mit", "", "", "bsd-2-clause", "bsd-3-clause", "bsd-3-clause,mit", "mit", "cc-by,cc-by-nc-sa", "gpl-3.0", "", "", ""]
    assert [r["n_base"] for r in out] == [0] * 8 + [2] + [0] * 4
    assert (out[8]["first_word"], out[8]["last_word"]) == (2, 11)
    assert out[0]["score"] == 1.0 and out[3]["score"] == 0.0 and out[11]["n_words"] == out[12]["n_words"] == 0
    assert all(0 <= r["score"] <= 1 for r in out)
    assert out[0]["matches"][0]["start"] <= 150 < out[0]["matches"][0]["start"] + 16


def test_licenses_base_and_edges(spark):
    out = scanned(spark, ["MIT License, mit\x01license; KMIT License CC BY", "K MIT-LICENSE", "x" * 10 + " apache license" * 30_000, "GNU General\nPublic  License"])
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out] == [(8, 3, 0, 6, "cc-by,mit"), (3, 1, 1, 1, "mit"), (60_001, 30_000, 1, 59_999, "apache"), (4, 1, 0, 0, "gpl")]
    none = spark.createDataFrame([], DOCS)
    assert scan_licenses(none).collect() == []
    twice = spark.createDataFrame([(1, "mit license", "", "", "")] * 2 + [(None, "cc by", "", "", "")], DOCS)
    assert sorted((r["doc_id"] or 0, r["base_labels"]) for r in scan_licenses(twice).collect()) == [(0, "cc-by"), (1, "mit"), (1, "mit")]


def plain_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in named]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((far(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    end = [best(v) for _, v in kept]
    sums = [sum(d for d, j in end if j == c) for c in range(len(centers))]
    return sorted((i is None, i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, end, strict=True))


def lloyd(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, owner int, was int")
    return sorted((r["vec_id"] is None, r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in delta_lloyd(df, **options).collect())


def test_delta_lloyd_is_lloyd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=3) + 3 * rng.integers(0, 3))]) for i in range(150)]
    # copies, ties on a grid, and rows that take no part
    rows += [(i, [0.5, 0.25, float(i % 2)]) for i in range(150, 180)] + [(7, rows[7][1]), (7, [1.0, 1.0, 1.0]), (None, [2.0, 2.0, 2.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, math.nan, 2.0]), (905, [math.inf, 0.0, 0.0]), (906, [1.0] * 4)]
    for k, rounds in ((4, 5), (9, 3), (1, 1), (400, 2)):
        assert lloyd(spark, rows, k=k, rounds=rounds, dims=3) == plain_lloyd(rows, k, rounds, 3)
    assert lloyd(spark, [], k=3, dims=3) == [] and lloyd(spark, [(None, [1.0] * 3)], k=3, dims=3) == []
    # components beyond the limit take no part, those near it are exact
    wide = [(i, [float(x) for x in np.float32(rng.uniform(-60_000, 60_000, 3))]) for i in range(40)]
    assert lloyd(spark, wide + [(99, [1e9, 0.0, 0.0])], k=3, rounds=3, dims=3) == plain_lloyd(wide, 3, 3, 3)


def test_only_moved_centers_are_compared():
    rng = np.random.default_rng(0)
    v, c = rng.integers(-3, 4, (500, 4)), rng.integers(-3, 4, (12, 4))
    owner, distance = nearest(v, c)
    for _ in range(20):
        moved = rng.random(12) < 0.3
        c = c.copy()
        c[moved] += rng.integers(-1, 2, (moved.sum(), 4))
        owner, distance = reassigned(v, owner, distance, c, moved)
        expected = nearest(v, c)
        assert (owner == expected[0]).all() and (distance == expected[1]).all()


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 24):
        a, b = rng.integers(-most, most, (9, 64)), rng.integers(-most, most, (7, 64))
        assert products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def plain_negatives(rows, every, positives=5, negatives=10, low=30, high=90):
    good = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, c, v in good:
        if a % every == 0:
            scores = [(-dot(v, w), i, d) for i, d, w in good if len(w) == len(v)]
            for p, pid, _ in sorted(s for s in scores if s[2] == c and s[1] != a)[:positives]:
                for rank, (s, i, _) in enumerate(sorted(s for s in scores if s[2] != c and -low * p <= -100 * s[0] <= -high * p)[:negatives]):
                    out.append((a, pid, rank + 1, i, -p, -s))
    return sorted(out)


@pytest.mark.parametrize("block", [1000, 3])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        size = float(rng.choice([0.1, 1, 1, 3])) * (1 if i % 9 else 0)
        rows.append((i, int(rng.integers(0, 3)), [float(x) for x in np.float32(size * rng.normal(size=4))]))
    rows += [(i, 1, [1.0, 1.0, 0.0, 0.0]) for i in range(400, 460)] + [(i, 2, [0.5, 0.5, 0.0, 0.0]) for i in range(460, 520)]
    rows += [(20, 1, rows[20][2]), (440, 1, [1.0, 1.0, 0.0, 0.0]), (500, 0, [1.0, 2.0]), (600, 1, [3.0, 2.0]), (601, 1, [3.0, 1.0]), (602, 2, [1.0, 1.0])]
    rows += [(700, None, [1.0] * 4), (None, 1, [1.0] * 4), (720, 1, None), (740, 1, [1.0, None, 1.0, 1.0]), (760, 1, [math.nan] * 4), (780, 9, [1.0] * 4)]
    df = spark.createDataFrame([(i, c, v, 5, 6) for i, c, v in rows], "vec_id long, label int, embedding array<float>, rank int, norm2 int")
    got = hard_negatives(df, "vec_id % 20 = 0", block=block, seed=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 20)


def test_hard_negatives_edges(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives(none).collect() == []
    rng = np.random.default_rng(6)
    wide = [(i, i % 2, [float(x) for x in np.float32(rng.uniform(-60_000, 60_000, 64))]) for i in range(60)]
    df = spark.createDataFrame(wide, "vec_id long, label int, embedding array<float>")
    assert sorted(tuple(r) for r in hard_negatives(df, "vec_id % 10 = 0", low=-100).collect()) == plain_negatives(wide, 10, low=-100)
