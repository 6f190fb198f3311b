"""Joins, rules, packing, archives, models and the pipeline against plain versions."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from recollect.llm import bytes_np, components, jaccard_join, line_dedup, packing, ppm, quality_model, quality_rules, warc

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or ""), 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, h long")


def made_texts(rng, n=60):
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(n)]
    out = list(base)
    for t in base[:25]:
        w = t.split()
        for _ in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    return out + [None, "", " \n ", "One Two", "one  two", "W1 W2 W3 W4 W5", "w1 w2 w3 w4 w5\t"]


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(WORD, lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("options", [{}, {"cap": 4, "common": 16}, {"cap": 3, "levels": 2, "common": 1, "broadcast_rows": 0}])
def test_jaccard_components(spark, options):
    texts = made_texts(random.Random(3))
    got = jaccard_join.jaccard_components(documents(spark, texts).repartition(3), **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    w = ["v%d" % i for i in range(60)]
    texts = []
    for _ in range(70):
        v = list(w)
        for _ in range(rng.randrange(0, 3)):
            v[rng.randrange(60)] = "e%d" % rng.randrange(99)
        texts.append(" ".join(v))
    texts += [texts[0]] * 30
    got = jaccard_join.jaccard_components(documents(spark, texts), cap=8, levels=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(texts)
    kept = sorted(r["doc_id"] for r in jaccard_join.drop_near_duplicates(documents(spark, texts)).collect())
    assert kept == sorted({c for _, c in plain_components(texts).values()})


def test_near_duplicates_edges(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", None, None]).unionByName(documents(spark, ["a b c d e f"]))
    assert sorted(r["doc_id"] for r in jaccard_join.drop_near_duplicates(docs).collect()) == [0, 2, 3]
    ids = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard_join.drop_near_duplicates(ids).count() == 5
    clash = docs.withColumns({c: F.lit(1) for c in ("_gone", "_i", "_t", "class", "node")})
    assert jaccard_join.drop_near_duplicates(clash).columns == clash.columns and jaccard_join.drop_near_duplicates(clash).count() == 3
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert components.components(links.where("false")).count() == 0


def plain_rules(text):
    text = text or ""
    w = re.findall(WORD, text)
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(spark):
    rng = random.Random(5)
    texts = made_texts(rng) + ["\n".join(rng.choices(["a line", "b  line", "", " \t", "c | #"], k=40)) for _ in range(10)] + [" ".join(rng.choices("x y".split(), k=60)) for _ in range(5)] + ["é ü " * 30, "word " * 5000]
    got = quality_rules.quality_rules(documents(spark, texts)).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["kept"] and r["base_failed"])
    assert len(got) == len(texts) and quality_rules.quality_rules(documents(spark, texts).where("false")).count() == 0
    plan = quality_rules.quality_rules(documents(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") or "EvalPython" not in plan


def test_repeats_are_found_whatever_the_hash(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choices("a b c d e".split(), k=rng.randrange(8, 40)) * rng.randrange(1, 3)) for _ in range(60)]
    for mask in (0, -1 << 62):
        got = quality_rules.measured(documents(spark, texts), hash_mask=mask).collect()
        assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: plain_rules(t)[4] for i, t in enumerate(texts)}


def plain_lines(rows, min_sites, min_words):
    strip = lambda s: s.strip(" \t\n\x0b\f\r")
    sites, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if len(re.findall(WORD, line)) >= min_words:
                sites[strip(line)].add(s)
                first[strip(line)] = min(first.get(strip(line), i), i)
    out = {}
    for i, t, _ in rows:
        if t is None:
            out[i] = None
            continue
        kept, seen = [], set()
        for line in t.split("\n"):
            k = strip(line)
            if len(sites.get(k, ())) >= min_sites and (first[k] != i or k in seen):
                continue
            seen.add(k)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["short", "", "  padded line here  ", "padded line here"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 8))) for _ in range(80)] + [None, ""]
    sources = [rng.choice([None, "a", "b", "c", "d"]) for _ in texts]
    for sites in (2, 3, 5):
        got = line_dedup.drop_shared_lines(documents(spark, texts, sources).repartition(5), min_sites=sites).collect()
        assert {r["doc_id"]: r["text"] for r in got} == plain_lines(list(zip(range(len(texts)), texts, sources)), sites, 3)
    assert line_dedup.drop_shared_lines(documents(spark, texts).where("false")).count() == 0
    assert set(documents(spark, texts).columns) <= set(line_dedup.drop_shared_lines(documents(spark, texts)).columns)


def test_many_shared_lines_in_one_document(spark):
    shared = "\n".join(f"shared line number {i}" for i in range(200))
    texts = [shared, "own words stand here\n" + shared + "\nand here too", shared + "\nlast words of it"]
    got = {r["doc_id"]: (r["text"], r["n_shared_lines"]) for r in line_dedup.drop_shared_lines(documents(spark, texts, ["a", "b", "c"])).collect()}
    assert got == {0: (shared, 0), 1: ("own words stand here\nand here too", 200), 2: ("last words of it", 200)}


def test_sites_that_meet_in_one_register(spark):
    register = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit("s"), "source")), 57)
    sites = spark.range(600).select(F.concat(F.lit("site"), "id").alias("source")).groupBy(register).agg(F.sort_array(F.collect_list("source")).alias("s")).where(F.size("s") >= 3).first()["s"][:3]
    texts = ["one line that is shared", "one line that is shared\nand another", "one line that is shared", "a line on one site", "a line on one site", "a line on one site"]
    docs = documents(spark, texts, [*sites, *sites[:1] * 3])
    assert docs.limit(3).agg(F.approx_count_distinct(F.concat(F.lit("s"), "source"), 0.1)).first()[0] == 1
    got = {r["doc_id"]: (r["text"], r["n_shared_lines"]) for r in line_dedup.drop_shared_lines(docs).collect()}
    assert got == {0: (texts[0], 0), 1: ("and another", 1), 2: ("", 1), **{i: (texts[i], 0) for i in (3, 4, 5)}}


def test_packing_is_a_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = ["A sentence here. Another one! " * rng.randrange(0, 90) for _ in range(60)] + [None, "", "x" * 9000, "日本 <|endoftext|> émoji 🎉 " * 50]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    rows = packing.pack_documents(documents(spark, texts).repartition(2), block=5000).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_doc) == len(texts)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(map(len, ids)) + 2 * 2048
    assert packing.pack_documents(documents(spark, texts).where("false")).count() == 0


def test_long_runs_are_packed(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000 + "a", "\n" * 1_000_000 + "b", "c" * 1_000_000, "!" * 1_000_000, "<|endoftext|>" + " \n" * 600_000]
    for added in (True, False):
        tokenizer.encode_special_tokens = not added
        n = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
        rows = packing.pack_documents(documents(spark, texts), added_tokens=added).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("length")).orderBy("doc_id").collect()
        assert [(r["doc_tokens"], r["length"]) for r in rows] == [(x, x) for x in n]


def test_added_tokens_have_their_ids(spark, tmp_path):
    import public_tokenizers as P
    from recollect.llm.queries import op2_packing
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|>  <|endoftext|>\n two <|endof", "plain text here"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert 50256 in ids[0]
    whole = collections.defaultdict(int)
    for r in op2_packing(spark, str(tmp_path)).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        whole[r["doc_id"]] += r["length"]
    assert whole == {i: len(x) for i, x in enumerate(ids)}


def test_cuts_are_the_cheapest():
    rng = random.Random(8)
    for _ in range(60):
        length = rng.choice([8, 16])
        at = np.array(sorted(rng.sample(range(1, 60), 25)) + [60])
        at = np.unique(np.concatenate([at, np.arange(length, 60, length)]))
        penalty = np.array([rng.choice([0.0, 16.0, 128.0]) for _ in at])

        def cost(n):
            return min(length - n, packing.POWER) if n & (n - 1) == 0 else length - n

        best = {0: 0.0}
        for p, c in zip(at.tolist(), penalty.tolist()):
            best[p] = c + min(v + cost(p - q) for q, v in best.items() if p - q <= length)
        cuts = packing.best_cuts(at, penalty, length, True)
        at_cost = dict(zip(at.tolist(), penalty.tolist()))
        assert sum(at_cost[c] + cost(c - b) for b, c in zip([0, *cuts], cuts)) == best[60]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "same " * 300
    rows = [(1, "http://a/x y", big), (2, None, big), (5, "http://b/é", "small"), (6, "u", "small"), (7, "u", None), (9, "u", big), (9, "u2", big), (None, "u", "x" * 1200), (None, "v", big), (3, "u", "ü" * 600)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    for k, options in enumerate(({}, {"shard_bytes": 2000, "roll_bytes": 300})):
        folder = f"file://{tmp_path}/w{k}"
        manifest = warc.write_warc(pages.repartition(3), folder, **options)
        assert manifest.agg(F.sum("records")).first()[0] == len(rows) and not [p for p in (tmp_path / f"w{k}").rglob("*") if ".tmp-" in p.name]
        got = warc.read_warc(spark, folder).collect()
        digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
        expected = collections.Counter((i, len((t or "").encode()), digest(t), *(("revisit", 9) if t == big and i != 9 else ("response", None))) for i, _, t in rows)
        assert collections.Counter((r["record_key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected
        assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
        again = f"file://{tmp_path}/again{k}"
        warc.write_warc(pages.repartition(2), again, **options)
        made = {p.name: p.read_bytes() for p in (tmp_path / f"w{k}").glob("run-*/*.gz")}
        assert made and made == {p.name: p.read_bytes() for p in (tmp_path / f"again{k}").glob("run-*/*.gz")}
    empty = f"file://{tmp_path}/none"
    assert warc.write_warc(pages.where("false"), empty).count() == 0 and warc.read_warc(spark, empty).count() == 0


def test_warc_is_replaced_as_a_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = lambda n: spark.createDataFrame([(i, "u", f"page {n} {i}") for i in range(n)], "page_id long, url string, html string")
    warc.write_warc(pages(2), folder)
    former = warc.generation(folder)
    assert warc.write_warc(pages(3), folder).agg(F.sum("records")).first()[0] == 3
    assert sorted(r["payload"].decode() for r in warc.read_warc(spark, folder).collect()) == [f"page 3 {i}" for i in range(3)]
    assert spark.read.schema(warc.MANIFEST).json(f"{former}/manifest").agg(F.sum("records")).first()[0] == 2
    warc.drop_former(folder)
    assert warc.read_warc(spark, folder).count() == 3 and len(list((tmp_path / "w").glob("run-*"))) == 1
    archive = next((tmp_path / "w").glob("run-*/*.gz"))
    archive.write_bytes(archive.read_bytes()[:-30])
    with pytest.raises(Exception, match="ends within a record|digest"):
        warc.read_warc(spark, folder).collect()


def test_large_ids_beside_nulls_find_their_shard(spark, tmp_path):
    big, many = 2**53, "x" * 1200
    rows = [(big + i, "u", many if i % 2 else f"{i} " * 300) for i in range(700)] + [(None, "u", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    assert warc.write_warc(pages, folder, shard_bytes=1000).select("shard").distinct().count() > 513
    got = {r["record_key"]: (r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder, payloads=False).collect()}
    last = big + 699
    assert got == {None: ("response", None)} | {big + i: ("revisit", last) if i % 2 and i < 699 else ("response", None) for i in range(700)}


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(rng.integers(0, 12))) for _ in range(60)]
    s, bounds, _, _ = ppm.symbols(*bytes_np.texts(pa.array(texts)))
    assert bytes(s).decode() == "".join(" ".join(t.split()) + "\n" for t in texts)
    packed, most = ppm.contexts(s, bounds)
    count = collections.Counter(int(ppm._key(k, packed[i : i + 1] & np.uint64((1 << 8 * k) - 1), s[i : i + 1])[0]) for i in range(len(s)) for k in range(most[i] + 1))
    trie = ppm.Trie(np.array(list(count), np.uint64), np.array(list(count.values())), 5)
    every = np.arange(256, dtype=np.uint8)
    for i in rng.integers(0, len(s), 100):
        p = trie.log10(every, np.full(256, packed[i], np.uint64), np.full(256, most[i]))
        assert (10**p).sum() == pytest.approx(1)


@pytest.mark.parametrize("top", [5, 100_000])
def test_scores(spark, top):
    texts = made_texts(random.Random(9))
    got = {r["doc_id"]: r for r in ppm.score_texts(documents(spark, texts), top=top).collect()}
    tokens = [re.findall(WORD, lower(t)) + ["\n"] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = collections.Counter(w for i, t in enumerate(tokens) if train[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0
    assert ppm.score_texts(documents(spark, texts).where("false")).count() == 0


def plain_ppm(texts, train, order=5):
    """log10 probability of each text: the longest known context first, escapes with exclusion of the bytes seen there."""
    streams = [" ".join(re.findall(WORD, lower(t))).encode() + b"\n" for t in texts]
    seen = collections.defaultdict(collections.Counter)
    history = lambda s, i, k: (b"\n" + s[:i])[i + 1 - k : i + 1]
    for s, known in zip(streams, train):
        for i, c in enumerate(s) if known else ():
            for k in range(min(order, i + 1) + 1):
                seen[history(s, i, k)][c] += 1
    out = []
    for s in streams:
        total = 0.0
        for i, c in enumerate(s):
            excluded, k = set(), min(order, i + 1)
            while k >= 0:
                left = {b: n for b, n in seen[history(s, i, k)].items() if b not in excluded} if history(s, i, k) in seen else {}
                if left:
                    n, d = sum(left.values()), len(left)
                    if c in left:
                        total += math.log10((left[c] - 0.5) / n)
                        break
                    total += math.log10(d / (2 * n))
                    excluded |= set(left)
                k -= 1
            if k < 0:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


@pytest.mark.parametrize("max_nodes", [100, 2_000_000])
def test_scores_equal_a_plain_model(spark, max_nodes):
    texts = made_texts(random.Random(13), 40) + ["entirely new ñ words", "W1"]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    got = {r["doc_id"]: r["score"] for r in ppm.score_texts(documents(spark, texts).repartition(3), max_nodes=max_nodes).collect()}
    assert got == pytest.approx(dict(enumerate(plain_ppm(texts, train))), rel=1e-9)


def test_small_trie_keeps_whole_contexts(spark):
    texts = made_texts(random.Random(10))
    rows = ppm.score_texts(documents(spark, texts), max_nodes=200).collect()
    assert len(rows) == len(texts) and all(np.isfinite(r["score"]) for r in rows)


def test_scores_do_not_depend_on_what_is_sent(spark):
    rng = random.Random(11)
    texts = made_texts(rng) + [" ".join("".join(rng.choices("w0123qé", k=rng.randrange(1, 7))) for _ in range(20)) for _ in range(40)]
    expected = {r["doc_id"]: r["score"] for r in ppm.score_texts(documents(spark, texts)).collect()}
    for options in ({"max_nodes": 1}, {"max_nodes": 1500}):
        got = {r["doc_id"]: r["score"] for r in ppm.score_texts(documents(spark, texts).repartition(3), **options).collect()}
        assert got == pytest.approx(expected)
    low = {r["doc_id"]: r["score"] for r in ppm.score_texts(documents(spark, texts), order=2).collect()}
    assert {r["doc_id"]: r["score"] for r in ppm.score_texts(documents(spark, texts), order=2, max_nodes=100).collect()} == pytest.approx(low)


def test_scores_do_not_depend_on_share_and_block(spark):
    texts = made_texts(random.Random(14), 60) + ["entirely new ñ words", "", "W1"]
    expected = dict(enumerate(plain_ppm(texts, [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))])))
    for options in ({"share": 1e-2}, {"share": 1e-3, "block": 40}, {"share": 1.0, "block": 1}):
        got = {r["doc_id"]: r["score"] for r in ppm.score_texts(documents(spark, texts).repartition(2), **options).collect()}
        assert got == pytest.approx(expected, rel=1e-9)


def test_what_is_looked_up_grows_with_the_input(spark):
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(6000)]
    often = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, often, k=40)) for _ in range(2500)]

    def away(texts: list[str]) -> int:
        key, n, _ = ppm.train_trie(ppm._counts(documents(spark, texts), 5), 80_000, share=2**-12)
        s, bounds, _, _ = ppm.symbols(*bytes_np.texts(pa.array(texts)))
        packed, most = ppm.contexts(s, bounds)
        beyond = np.zeros(len(s), bool)
        ppm.Trie(key, n, 5).log10(s, packed, most, beyond=beyond)
        return int(beyond.sum())

    small, large = away(texts[:500]), away(texts)
    assert 0 < small and 4.5 * small < large < 5.5 * small


class Plan:
    """Takes the place of a DataFrame and keeps what its tasks would run."""

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def counted(texts, rows=100, **options):
    """What one task passes on of the counts."""
    plan = Plan()
    ppm._counts(plan, 5, **options)
    return plan.run(pa.RecordBatch.from_pydict({"text": texts[a : a + rows]}) for a in range(0, len(texts), rows))


def test_memory_of_counts_does_not_grow_with_a_task(spark):
    rng = np.random.default_rng(8)
    texts = [bytes(x).decode() for x in rng.integers(97, 123, (400, 20_000), np.uint8)]  # 8 MB, nearly all keys different
    most = []
    for part in (texts[:100], texts):
        tracemalloc.start()
        assert sum(b.num_rows for b in counted(part)) > 0.9 * 20_000 * len(part)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.3 * most[0] and most[1] < 150e6


@pytest.mark.parametrize("block", [1, 7, 1000, 20_000])
def test_counts_do_not_depend_on_what_a_task_holds(spark, block):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bc", "the", "x" * rng.randint(1, 40), str(rng.random())]) for _ in range(3000)) for _ in range(30)] + ["", None]
    sums = [pa.Table.from_batches(out).group_by(["kind", "key"]).aggregate([("n", "sum")]).sort_by([("kind", "ascending"), ("key", "ascending")]) for out in (counted(texts, 3, block=block), counted(texts, 3))]
    assert sums[0].equals(sums[1])
    # over Spark too, against the symbols themselves
    if block == 1000:
        s, *_ = ppm.symbols(*bytes_np.texts(pa.array(texts)))
        kinds = {r["kind"]: r["n"] for r in ppm._counts(documents(spark, texts), 5, block).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        assert kinds == {0: len(s), 1: sum(len(lower(t or "").split()) + 1 for t in texts)}


def test_quality_model(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scored = quality_model.score_quality(docs, labels)
    held = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality").toPandas()
    assert not ((held["predicted"] == 0) & (held["quality"] == 1)).any()
    other = quality_model.score_quality(docs, labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert {r["doc_id"]: r["score"] for r in scored.collect()} == pytest.approx({r["doc_id"]: r["score"] for r in other.collect()})
    odd = documents(spark, [None, "", "a"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["score"] for r in quality_model.score_quality(odd, labels.where("false")).collect()] == [0.5] * 3
    assert quality_model.score_quality(docs.where("false"), labels).count() == 0


def test_quality_model_on_held_out_documents(spark):
    """At sf0.01: at the smallest scale the model has eight bad rows to learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality_model.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").toPandas()
    assert (held["predicted"] == held["quality"]).mean() >= 0.95


def test_features_equal_a_plain_count():
    rng = random.Random(12)
    texts = ["", " \n ", "One two. Two!\nONE two. two!\n| a,b; | 12 é", "x x x\nx x x\n\nwordlongerthantwelve 9#"] + ["".join(rng.choices("aB 1.,!|#\n\té?", k=rng.randrange(1, 90))) for _ in range(60)]
    got = quality_model.form(*bytes_np.texts(pa.array(texts)))
    for t, row in zip(texts, got):
        b, w = t.encode(), [x.encode() for x in re.findall(WORD, t)]
        lines = [re.findall(WORD, x) for x in t.split("\n")]
        spans = [x.strip(" \t\n\x0b\f\r") for x, ws in zip(t.split("\n"), lines) if ws]
        n, size = len(w), max(1, len(b))
        share = lambda chars: sum(c in chars.encode("latin-1") for c in b) / size
        upper = [sum(65 <= c <= 90 for c in x) for x in w]
        pairs = list(zip(w, w[1:]))
        expected = [
            math.log1p(n), math.log1p(len(b)), sum(map(len, w)) / max(1, n), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&<>@^~=+_\\{}[]"), share("!"), share("|"), share("\"'()/-?"), share("."), share(",;:"), sum(c > 127 for c in b) / size,
            len(set(w)) / max(1, math.sqrt(n)), sum(x == y for x, y in pairs) / max(1, n), sum(x == y for x, y in zip(w, w[2:])) / max(1, n), 1 - len(set(pairs)) / max(1, len(pairs)),
            math.log1p(len(spans)), 1 - len(set(spans)) / max(1, len(spans)), n / max(1, len(spans)),
            sum(x[-1:] in (*b"#*$%&<>@^~=+_\\{}[]!|",) or x[-1] in b"#*$%&<>@^~=+_\\{}[]!|" for x in w) / max(1, n), sum(u > 1 and u * 2 > len(x) for u, x in zip(upper, w)) / max(1, n), sum(len(x) > 12 for x in w) / max(1, n), sum(len(x) < 3 for x in w) / max(1, n),
        ]
        assert row.tolist() == pytest.approx(expected if n else [0.0] * len(expected)), t


def plain_additive(x, y, rounds, rate, leaves, ridge):
    """Cyclic boosting of one-feature trees over distinct values, each border tried in turn."""
    values = [sorted(set(c)) for c in x.T]
    raw = [math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))] * len(y)
    for _ in range(rounds):
        for f, known in enumerate(values):
            p = [1 / (1 + math.exp(-r)) for r in raw]
            g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
            parts = [known]

            def worth(part):
                rows = [i for i in range(len(y)) if x[i, f] in part]
                return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + ridge)

            for _ in range(leaves - 1):
                options = [(worth(part[:k]) + worth(part[k:]) - worth(part), at, k) for at, part in enumerate(parts) for k in range(1, len(part))]
                gain, at, k = max(options, key=lambda o: (o[0], -o[1], -o[2]), default=(0, 0, 0))
                if gain <= 1e-9:
                    break
                parts[at : at + 1] = [parts[at][:k], parts[at][k:]]
            for part in parts:
                rows = [i for i in range(len(y)) if x[i, f] in part]
                step = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
                for i in rows:
                    raw[i] += step
    return raw


def test_additive_model_equals_plain_boosting():
    from recollect.llm.boosting import fit_additive

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (40, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    y[:4] = 1 - y[:4]
    model = fit_additive(x, y, rounds=6, rate=0.3, leaves=3, n_pairs=0, ridge=1.0)
    assert model.raw(x).tolist() == pytest.approx(plain_additive(x, y, 6, 0.3, 3, 1.0))
    paired = fit_additive(x, y, rounds=40, n_pairs=2)
    assert (0, 1) in paired.pairs and ((paired.score(x) > 0.5) == (y > 0.5)).mean() > 0.85


def test_low_quality_by_id(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality_model.score_quality(docs, labels).collect()}
    bad = next(i for i, p in scored.items() if not p)
    more = docs.unionByName(docs.where(F.col("doc_id") == bad)).unionByName(docs.where(F.col("doc_id") == bad).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("_gone", F.lit(1))
    kept = quality_model.drop_low_quality(more, labels)
    assert kept.columns == more.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(i) for i, p in scored.items() if p] + ["None"])


def test_shared_lines_stage(spark):
    import corpus_pipeline

    text = ["this line is shared\nown words here", "this line is shared", "this line is shared\n \t", None, "", "other words here now"]
    docs = documents(spark, text, ["a", "b", "c", "a", "b", "c"]).drop("h")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {0: (text[0], len(text[0])), 3: (None, 0), 4: ("", 0), 5: (text[5], len(text[5]))}
    again = line_dedup.drop_shared_lines(docs.withColumn("n_shared_lines", F.lit("x")))
    assert again.columns.count("n_shared_lines") == 1 and again.agg(F.sum("n_shared_lines")).first()[0] == 2


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, data).collect(), before.schema) if name != "packing" else stage(spark, before, data)
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    # where pieces are cut depends on the rows of each partition, what they add up to does not
    whole = lambda pieces: {r["doc_id"]: (r["n"], r["doc_tokens"]) for r in pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()}
    made = whole(docs)
    assert set(made) == {r["doc_id"] for r in before.collect()} and all(n == tokens for n, tokens in made.values())
    assert whole(corpus_pipeline.run(spark, data)) == made


def test_line_dedup_without_ids_and_with_any_names(spark):
    line = "this line stands everywhere at last"
    rows = [(i if i < 3 else None, f"own words {i} of text\n{line}\n{line}", f"site{i}", "a", "b") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _l_id string, h string")
    out = line_dedup.drop_shared_lines(df)
    assert out.columns == [*df.columns, "n_shared_lines"]
    got = {r["text"].split("\n")[0]: (r["text"].count(line), r["n_shared_lines"]) for r in out.collect()}
    first = min((r["h"], r["t"]) for r in df.where("doc_id IS NULL").select(F.xxhash64("text").alias("h"), F.col("text").alias("t")).collect())[1].split("\n")[0]
    assert got == {f"own words {i} of text": (1, 1) if f"own words {i} of text" == first else (0, 2) for i in range(6)}
