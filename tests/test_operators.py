"""Small cases with known results, for operators that SQL can't express and for their edges."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import activation, answercheck, answerflow, corpus, evaluation, factcheck, gates, geometry, governance, intents, lexical, mutation, reports, splits
from recollect.operators import retrieval as R
from recollect.sources import files
from recollect.streaming import limits


def test_zca_whitens(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    n, mean, cov = geometry.moments(df)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    w = geometry.fit_whitening(df, eps=1e-9, headroom=1.0)
    y = np.stack([r["whitened"] for r in w.apply(df).collect()])
    assert np.allclose(np.cov(y.T) / np.cov(y.T)[0, 0], np.eye(6), atol=1e-6)
    assert np.linalg.norm(y, axis=1).max() <= 1 + 1e-9
    value = np.linalg.eigvalsh(cov)
    assert geometry.participation_ratio(cov) == pytest.approx(value.sum() ** 2 / (value**2).sum())
    again = geometry.Whitening.from_row(w.as_row(spark), 6)
    assert np.allclose(again.matrix, w.matrix)


def test_abtt_removes_the_first_direction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [10, 1, 1, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    y = np.stack([r["whitened"] for r in geometry.fit_whitening(df, method="abtt").apply(df).collect()])
    assert np.var(y[:, 0]) < 0.05 * np.var(y[:, 1])


def test_bound_cell_fires_for_its_items(spark):
    x = np.eye(8)[:4]
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "group_id long, item_id long, vector array<double>")
    r = geometry.bind(df, theta=0.3).first()
    w = np.array(r["weight"])
    assert r["m"] == 4 and ((x @ w) > r["theta"]).all() and np.linalg.norm(w) == pytest.approx(1, abs=0.05)
    assert all(e @ w < r["theta"] for e in np.eye(8)[4:])


def test_topk_with_empty_and_null_cells(spark):
    cells = spark.createDataFrame([(1, [1.0, 0.0], 0.3), (2, None, 0.3), (3, [0.0, 1.0], 0.3)], "cell_id long, weight array<float>, theta double")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["cell_id"], r["rank"]) for r in R.topk(cells, q).collect()] == [(1, 1)]
    assert R.topk(cells.where("false"), q).count() == 0
    assert [r["cell_id"] for r in R.topk(cells, q, by="act", include_silent=True).orderBy("rank").collect()] == [1, 3]
    blocks = R.scored(cells, spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], q.schema), 2, "act", False, block=2)
    assert blocks.groupBy("query_id").count().count() == 5
    with pytest.raises(ValueError):
        R.with_overlay(cells, cells)


def test_gate_cases(spark):
    acts = spark.createDataFrame([(1, 0.5), (1, 0.49), (2, 0.5), (2, 0.3), (3, 0.4), (4, None)], "query_id int, act double")
    got = {r["query_id"]: (r["fires"], r["reason"]) for r in gates.gate(acts).collect()}
    assert got == {1: (False, "margin below"), 2: (True, "margin above"), 3: (True, "single above"), 4: (False, "no results")}


def test_bm25_golden(spark, tmp_path):
    texts = spark.createDataFrame([(100, "The French Connection is a 1971 film"), (101, "A film about chess"), (102, "Zebras in Kenya"), (103, "Paris is the capital of France"), (104, "")], "doc_id long, text string")
    index = lexical.build_index(texts)
    q = spark.createDataFrame([(1, "French Connection"), (2, "the of and")], "query_id long, text string")
    got = lexical.bm25_topk(index, q).collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 100)]
    lexical.save_index(index, str(tmp_path / "i"))
    assert [r["doc_id"] for r in lexical.bm25_topk(lexical.load_index(spark, str(tmp_path / "i")), q).collect()] == [100]
    with pytest.raises(ValueError):
        lexical.load_index(spark, str(tmp_path / "i"), "words-2")
    gone = spark.createDataFrame([(100,)], "doc_id long")
    assert lexical.bm25_topk(index, q, excluded=gone).count() == 0


@pytest.mark.parametrize(
    "query, candidate, verdict",
    [
        ("the launch is on monday", "the launch is on tuesday", "reject"),
        ("backups rotate every ninety days", "backups never rotate every ninety days", "reject"),
        ("the budget grew by two percent", "the budget grew by 3 percent", "reject"),
        ("the server must restart", "the server may restart", "reject"),
        ("prices increased in spring", "prices decreased in spring", "reject"),
        ("we met Alice", "we met Bob", "reject"),
        ("nightly backups go to frankfurt", "nightly backups go to frankfurt region", "accept"),
        ("we keep nightly backups in the frankfurt region", "nightly backups are stored in the frankfurt region", "accept"),
        ("a cat sat", "dogs run home", "ambiguous"),
        ("two zebras", "2 zebras", "ambiguous"),
    ],
)
def test_fact_verdicts(spark, query, candidate, verdict):
    df = spark.createDataFrame([(query, candidate)], "query string, candidate string")
    assert factcheck.with_verdict(df).first()["verdict"] == verdict


def _answer(spark, question, answer, cells):
    return spark.createDataFrame([(question, answer, cells)], "question string, answer string, cells array<struct<cell_id:long,text:string,act:double>>")


def test_answer_verification(spark):
    cells = [(1, "The French Connection won Best Picture in 1971.", 0.5), (2, "Zebras live in Kenya.", 0.3)]
    check = lambda q, a: answercheck.verified(_answer(spark, q, a, cells)).first()
    assert check("Who won in 1971?", "The French Connection won [1].")["reason"] == "covered"
    assert check("Who won Best Picture?", "The French Connection won Picture in 1984.")["reason"] == "uncited number"
    assert check("1234 !!!", "anything")["reason"] == "incoherent question"
    assert check("asdfa qwerty zxcvo", "zebras live")["reason"] == "no overlap of question and cells"
    assert check("Where do Zebras live?", "Zebras live beside French Connection film picture")["grounded"] is False


def test_rescue(spark):
    cells = [(1, "unrelated", 0.6), (2, "Gene Hackman starred in The French Connection", 0.5)]
    out = lambda c, **k: answercheck.rescue(_answer(spark, "Who starred in The French Connection?", "Gene Hackman did", c), **k).first()["outcome"]
    assert out(cells) == "rescue"
    assert out(cells, window=1) == "reject_outside_window"
    assert out(cells, floor=0.55) == "reject_below_floor"
    assert out(cells[:1]) == "reject_no_supporting_cell"


def test_claims_have_exact_spans(spark):
    text = "Paris is the capital, and Rome is old. No! It was built in 1889 -- many years ago; yes"
    rows = answercheck.claims(spark.createDataFrame([(1, text), (2, None)], "id long, answer string"), "id").collect()
    assert [r["claim"] for r in rows] == ["Paris is the capital", "Rome is old.", "It was built in 1889", "many years ago;"]
    assert all(text[r["start"] : r["end"]] == r["claim"] for r in rows)


def test_greedy_chunks(spark):
    text = "a" * 30 + "\n\n" + "b" * 50 + "\n\n" + "c" * 250 + "\n\nd"
    rows = corpus.greedy_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 100, 20, 10).orderBy("chunk").collect()
    assert [len(r["text"]) for r in rows] == [82, 100, 100, 90, 1] and [r["accepted"] for r in rows] == [True] * 4 + [False]


def test_keep_first_and_offsets(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (5, None)], "pos long, text string")
    assert sorted(r["pos"] for r in corpus.keep_first(rows, F.col("text"), "pos").collect()) == [1, 2]
    n = spark.range(5000).select(F.col("id").alias("pos"), F.lit(3).alias("size"))
    assert corpus.global_offsets(n, "pos", "size").where("start <> pos * 3").count() == 0


def test_governance(spark):
    none = spark.createDataFrame([], "cell_id long, label string, theta double")
    new = spark.createDataFrame([("a", 2), ("b", 1)], "label string, order int")
    assert [(r["cell_id"], r["label"]) for r in governance.add_cells(none, new, 10, 9).orderBy("cell_id").collect()] == [(11, "b"), (12, "a")]
    with pytest.raises(ValueError):
        governance.add_cells(none, new, 10, 11)
    drafts = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c"), (4, " ")], "draft_id int, text string")
    assert [r["draft_id"] for r in governance.new_texts_only(drafts, spark.createDataFrame([("C",)], "text string")).collect()] == [1]
    edges = spark.createDataFrame([(9, 1)], "bound_cell_id long, source_cell_id long")
    assert governance.refused_deletes(spark.createDataFrame([(1,), (2,)], "cell_id long"), edges).first()["cell_id"] == 1


def test_planned_changes(spark):
    said = ["remember that  the sky is blue", "remove 7: wrong", "delete cell 9 because stale", "remove 7", "show provenance", "", "note:", "remove 7 - worse", "rememberable"]
    rows = spark.createDataFrame(list(enumerate(said)), "seq long, text string")
    stones = spark.createDataFrame([(9, "old")], "cell_id long, reason string")
    plans = mutation.planned(rows, stones, base_max=20, anchor=20)
    got = {r["seq"]: (r["op"], r["cell_id"], r["reason"], r["text"], r["blocked"], r["prior_reason"]) for r in plans.collect()}
    assert got[0] == ("add", None, None, "the sky is blue", False, None) and got[8][:4] == ("add", None, None, "able")
    assert got[1] == ("remove", 7, "wrong", None, False, None) and got[2] == ("remove", 9, "stale", None, False, "old")
    assert all(got[k][0] == "unknown" and got[k][4] for k in (3, 5, 6)) and got[4] == ("inspect", None, None, None, False, None)
    made = mutation.applied(plans, 20)
    assert [(r["cell_id"], r["source_text"]) for r in made["cells"].orderBy("cell_id").collect()] == [(21, "the sky is blue"), (22, "able")]
    assert {r["cell_id"]: r["reason"] for r in made["tombstones"].collect()} == {7: "worse", 9: "stale"} and made["log"].count() == 5
    back = {r["seq"]: (r["applied"], r["ok"]) for r in mutation.read_back(plans, made["cells"], made["tombstones"], made["log"]).collect()}
    assert back == {k: (k not in (3, 5, 6), k not in (3, 5, 6)) for k in range(9)}
    broken = mutation.read_back(plans, made["cells"].where("cell_id <> 21"), made["tombstones"].withColumn("reason", F.lit("other")), made["log"].where("op <> 'add'"))
    assert {r["seq"]: r["ok"] for r in broken.collect() if r["applied"]} == {0: False, 1: True, 2: False, 4: True, 7: False, 8: False}
    grown = mutation.planned(rows, stones, base_max=21, anchor=20).where("op = 'add'")
    assert all(r["blocked"] for r in grown.collect()) and mutation.planned(rows, stones, base_max=None).where("op = 'add' AND NOT blocked").count() == 0
    cells = spark.createDataFrame([(2, "b", [1.0, 0.0]), (1, "a", [0.0, 1.0])], "order int, label string, weight array<double>")
    none = spark.createDataFrame([], "cell_id long, label string, weight array<double>")
    assert [(r["cell_id"], r["label"]) for r in mutation.loaded(none, cells, 20, 2).orderBy("cell_id").collect()] == [(21, "a"), (22, "b")]
    with pytest.raises(ValueError):
        mutation.loaded(none, cells, 20, 3)


def test_written_cells(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, f"l{i}", f"t{i}", rng.normal(size=3).tolist() if i != 4 else [0.0] * 3) for i in range(12)], "order int, label string, text string, vector array<double>")
    cells = mutation.written(rows, 9).orderBy("cell_id").collect()
    assert [(r["cell_id"], r["source_text"]) for r in cells] == list(zip(range(10, 21), [f"t{i}" for i in range(12) if i != 4]))
    assert all(np.linalg.norm(r["weight"]) == pytest.approx(1) for r in cells)
    with pytest.raises(ValueError):
        mutation.written(rows, 9, strict=True)
    empty = spark.createDataFrame([], "cell_id long")
    white, first = mutation.started(empty, rows, least=12)
    assert first.count() == 12 and white.rows == 12
    for bank, least in ((spark.range(1), 12), (empty, 13)):
        with pytest.raises(ValueError):
            mutation.started(bank, rows, least=least)
    memories = spark.createDataFrame([("mem-3", None), ("mem-11", "g"), ("other", None)], "memory_id string, group_id string")
    assert mutation.next_number(memories) == 12 and mutation.next_number(memories.where("false")) == 0
    assert {r["memory_id"]: r["group_id"] for r in mutation.bound_ids(memories, ["mem-3", "other"], "h").collect()} == {"mem-3": "h", "mem-11": "g", "other": "h"}
    with pytest.raises(ValueError):
        mutation.bound_ids(memories, ["mem-3", "absent"], "h")


def test_verdicts_of_reports(spark):
    six = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = spark.range(1).select(
        reports.position_bias(six(0.6, 0, 0.1, 0.2, 0, 0.5), F.lit(1.0)).alias("a"),
        reports.position_bias(six(0.6, 0, 0.35, 0.2, 0, 0.5), F.lit(1.0)).alias("b"),
        reports.position_bias(six(0.4, 0, 0.35, 0.3, 0, 0.5), F.lit(1.0)).alias("c"),
        reports.position_bias(six(0.6, 0, 0.1, 0.2, 0, 0.5), F.lit(0.01)).alias("d"),
        reports.confusion_verdict(F.lit(0.9), F.lit(0.6)).alias("e"),
        reports.confusion_verdict(F.lit(0.9), F.lit(0.3)).alias("f"),
        reports.confusion_verdict(F.lit(0.2), F.lit(0.9)).alias("g"),
        reports.decision_label(F.lit(True), F.lit("verify: x"), F.lit("y")).alias("h"),
        reports.decision_label(F.lit(True), F.lit("gate"), F.lit("y")).alias("i"),
        reports.decision_label(F.lit(False), F.lit(""), F.lit("y")).alias("j"),
        reports.mode_verdict(F.lit("in Paris"), F.lit(False), F.array(F.lit("PARIS"))).alias("k"),
        reports.agreement(F.lit(0.5), F.lit(0.51), 0.02).alias("l"),
    ).first()
    assert list(r) == ["POSITION_BIAS_CONFIRMED", "PARTIAL_POSITION_BIAS", "NO_POSITION_BIAS", "INCONCLUSIVE", "SEMANTIC", "MIXED", "NOISE", "silence_drift", "silence_rescue_reject", "grounded_via_rescue", "grounded", "match"]
    plan = reports.training_plan(404_000_000, 400_000, 32, 256, 8_000_000_000, 9_000_000_000)
    assert (plan["optimal"], plan["presented"], plan["notes"]) == (8_080_000_000, 3_276_800_000, ["target below the optimum", "less than one epoch"])
    losses = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "mask string, loss double")
    assert {x["mask"]: (x["n"], x["mean_loss"], x["stderr"]) for x in reports.masked_losses(losses).collect()} == {"a": (2, 2.0, 1.0), "b": (1, 2.0, None)}
    hits, tokens = spark.createDataFrame([(1, 5, "a b"), (2, 6, "c")], "hit_id int, cell_id int, text string"), spark.createDataFrame([(6, [9, 9, 9])], "cell_id int, tokens array<int>")
    got = {x["hit_id"]: x["tokens"] for x in splits.looked_up_tokens(hits, tokens, lambda t: F.transform(F.split(t, " "), lambda w: F.ascii(w)), 3).collect()}
    assert got == {1: [97, 98, 0], 2: [9, 9, 9]}


def test_token_blocks(spark):
    one = spark.range(1)
    ints = lambda *x: F.array(*map(F.lit, x))
    r = one.select(
        splits.tiled(ints(1, 2), 2, 3).alias("tiled"),
        splits.probe_block(ints(7, 8), ints(9, 10), ints(1, 2, 3), 6).alias("probe"),
        splits.oracle_neighbor(ints(*range(20)), F.lit(1), 4, 5).alias("near"),
        splits.oracle_neighbor(ints(*range(20)), F.lit(4), 4, 5).alias("late"),
        splits.packed_bundle(ints(1, 2), 4, 0).alias("packed"),
        splits.shifted_windows(ints(*range(20)), F.lit(5), 6).alias("w"),
        splits.sub_question(F.lit("\n SUB-QUESTION: subquestion:  who?\nmore"), F.lit("x")).alias("sub"),
        splits.sub_question(F.lit(" \nSUBQUESTION:"), F.lit("x")).alias("none"),
        splits.memory_answer(F.array(F.struct(F.lit(4).cast("long").alias("cell_id"), F.lit(None).cast("string").alias("text")))).alias("answer"),
    ).first()
    assert r["tiled"] == [[[1, 2]] * 3] * 2 and r["near"] == [5, 6, 7, 8, 9] and r["late"] == [14, 15, 16, 17, 18] and r["packed"] == [1, 2, 0, 0]
    assert r["probe"]["x"] == [1, 2, 3, 7, 8, 9] and r["probe"]["y"] == [-1, -1, -1, -1, 9, 10]
    assert len(r["w"]["x"]) == 6 and r["w"]["y"][:-1] == r["w"]["x"][1:] and (r["sub"], r["none"]) == ("who?", "x") and r["answer"]["refused"] and r["answer"]["cited"] == []
    with pytest.raises(Exception, match="more than 1 tokens"):
        one.select(splits.packed_bundle(ints(1, 2), 1, 0)).collect()
    drafts = spark.createDataFrame([(1, [("a ", None, "", None), (" ", None, None, True), ("b", "d", "l", False)])], "batch int, drafts array<struct<text:string,draft_id:string,label:string,accepted:boolean>>")
    assert [tuple(x) for x in splits.draft_cells(drafts).collect()] == [(1, "a", "draft-0001", "manual_cell_0001", True), (1, "b", "d", "l", False)]
    page = "A short head\n\n" + "Words of a para-\ngraph that goes on. " * 3 + "\n\n" + "Figure 3 " + "x" * 90 + "\n\n" + "[12] Smith " + "y" * 80 + " doi:1"
    assert one.select(splits.page_paragraphs(F.lit(page)).alias("p")).first()["p"] == [("Words of a paragraph that goes on. " * 3).strip()]


def test_answer_flow(spark):
    found = spark.createDataFrame([(q, r, 10 * q + r, act) for q, acts in {1: (0.9, 0.5), 2: (0.5, 0.495), 3: (0.3, 0.29), 4: (0.9, 0.1), 5: (0.45, 0.44)}.items() for r, act in enumerate(acts, 1)], "query_id long, rank int, cell_id long, act double")
    text = "Gene Hackman starred in The French Connection of 1971"
    sources = spark.createDataFrame([(c, t, lab) for c, t, lab in [(11, text, "film"), (12, "other", None), (21, text, None), (22, "x", None), (31, text, None), (32, text, None), (41, None, "gone"), (42, None, None), (51, "Nothing about it", None), (52, text, None)]], "cell_id long, text string, label string")
    asked = "Who starred in The French Connection?"
    draft = {1: "Gene Hackman starred in 1971", 2: "Gene Hackman starred", 3: "Gene Hackman starred", 4: "anything", 5: "Roy Scheider won prizes in 1999"}
    questions = spark.createDataFrame([(q, asked, a) for q, a in draft.items()] + [(6, asked, "no cells at all")], "query_id long, question string, draft string")
    got = {r["query_id"]: r for r in answerflow.answered(questions, found, sources).collect()}
    assert {q: r["outcome"] for q, r in got.items()} == {1: "grounded", 2: "grounded", 3: "silence_gate", 4: "silence_gate", 5: "silence_gate", 6: "silence_gate"}
    assert got[1]["rescue"] is None and got[2]["rescue"] == "rescue" and got[3]["reason"] == "gate: margin below" and got[4]["reason"] == "gate passed, no source text"
    assert got[5]["reason"].startswith("gate: margin below; verify: ") and got[1]["citations"] == [11, 12] and [t["topic"] for t in got[1]["topics"]] == ["film", "other"]
    drift = answerflow.answered(questions.where("query_id = 1").withColumn("draft", F.lit("Roy Scheider won prizes in 1999")), found, sources).first()
    assert drift["outcome"] == "silence_drift" and drift["silent"]
    wide = answerflow.two_passes(answerflow.answered(questions, found, sources), answerflow.answered(questions, found, sources, threshold=0.001)).where("query_id = 3").first()
    assert wide["outcome"] == "grounded" and wide["from_second"]


def test_statistics_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(40, 8)), rng.integers(0, 3, 40)
    cells = spark.createDataFrame([(i, v.tolist(), 0.1, int(k)) for i, (v, k) in enumerate(zip(x, label))] + [(99, None, 0.1, 1)], "cell_id long, weight array<double>, theta double, label int").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(0, 40, 5)] + [(77, x[3].tolist(), None)], "query_id long, vector array<double>, query_label int")
    ids = [*range(0, 40, 5), 77]
    act = np.array([x @ x[i if i < 40 else 3] for i in ids])
    other = np.array([[j != i and (i == 77 or label[j] != label[i]) for j in range(40)] for i in ids])
    for q in (0.0, 0.25, 0.99, 1.0):
        assert activation.quantile(cells, queries, activation.OTHER, q, bins=8, ranked=4) == pytest.approx(np.quantile(act[other], q))
    ranks = {r["query_id"]: r["own_rank"] for r in activation.own_ranks(cells, queries).collect()}
    assert ranks == {i: (None if i == 77 else int((act[k] > act[k][i]).sum()) + 1) for k, i in enumerate(ids)}
    fires = {r["query_id"]: r["fires"] for r in activation.fire_counts(cells, queries, 0.5).collect()}
    assert fires == {i: int((act[k] > 0.5).sum()) for k, i in enumerate(ids)}


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    rows = [(e, 1 + e % 2, f"2024-01-01 00:00:{e:02d}") for e in range(40)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch = {r["event_id"]: r["allowed"] for r in limits.limited(events, 3, 10.0).collect()}
    assert [batch[e] for e in range(0, 20, 2)] == [True, True, True, False, False, False, True, True, True, False]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limits.limited_stream(stream, 3, 10.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == batch


def test_sources(spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text('# note\n\n{"case_id": "a"}\n{"case_id": "b"}\n')
    assert files.read_commented(spark, str(p), "case_id string").count() == 2
    assert files.read_records(spark, str(tmp_path / "absent"), "a int").count() == 0
    d = tmp_path / "docs"
    os.makedirs(d / "sub")
    (d / "a.md").write_text("one two three\n\n```code```\n\nshort")
    (d / "sub" / "b.txt").write_text("one  two three\n\nfour five six seven")
    assert sorted(r["text"] for r in files.text_folder(spark, str(d), 10, 100).collect()) == ["four five six seven", "one two three"]
    df = spark.createDataFrame([("intro\n# A\nbody\n## B\nmore",)], "t string").select(files.markdown_sections(F.col("t")).alias("s"), files.from_base64(F.lit("aGk=")).alias("b")).first()
    assert [(s["heading"], s["body"]) for s in df["s"]] == [("", "intro"), ("A", "body"), ("B", "more")] and df["b"] == "hi"
    assert files.pdf_text(b"1 0 obj stream\nBT (Hello) Tj (\\(x\\)) Tj ET\nendstream") == "Hello(x)"
    assert files.pdf_text(b"stream\nBT [(One) -250 (two)-20(three)] TJ 0 -14 Td <466F7572> Tj ET\nendstream") == "One twothree Four"
    streams = b"".join(b"stream\r\n" + zlib.compress(b"BT (" + c * 5000 + b") Tj ET") + b"\r\nendstream\n" for c in (b"a", b"b"))
    assert files.pdf_content(streams) == ("a" * 5000 + "\n" + "b" * 5000, None)
    assert files.pdf_content(streams, 1000)[1] == "2 streams were cut at 1000 bytes"
    history = tmp_path / "history.jsonl"
    history.write_text("".join('{"q": %d}\n' % i if i % 3 else "broken\n" for i in range(30)))
    assert [r["q"] for r in files.last_lines(spark, str(history), "q int", 4).collect()] == [25, 26, 28, 29]
    bank = files.Bank(spark, str(tmp_path / "bank"))
    assert bank.count() == 0 and bank.get("dim", "int", 5) == 5
    bank.put("dim", F.lit(64), 1.0)
    bank.put("dim", F.lit(65), 2.0)
    assert bank.get("dim", "int") == 65


def test_small_columns(spark):
    one = spark.range(1)
    low, high = evaluation.wilson(F.lit(0), F.lit(13))
    r = one.select(low.alias("a"), high.alias("b"), evaluation.rule_of_three(F.lit(0), F.lit(13)).alias("c"), intents.instruction(F.lit("remove cell 4 because it is old")).alias("d"), intents.decision(F.lit('x {"action": "add", "confidence": 7} y')).alias("e"), intents.judged(F.lit("ok"), F.lit("nonsense")).alias("f")).first()
    assert r["a"] == 0 and r["b"] == pytest.approx(0.2281, abs=1e-3) and r["c"] == pytest.approx(3 / 13)
    assert (r["d"]["kind"], r["d"]["cell_id"], r["d"]["reason"]) == ("remove", 4, "it is old") and r["e"]["confidence"] == 1.0 and r["f"] == "ambiguous"
    assert geometry.theta_star(1, 0.0, 0.0) == 1.0


def test_support_per_rank_and_verified_answers(spark):
    cells = [(7, "Ann Lee runs the old mill in Zürich."), (8, None), (9, "Ann Lee met Bob Roy at the mill.")]
    rows = spark.createDataFrame([("What does the mill of Ann Lee make?", "It was Bob Roy who came.", cells), ("why?", "because", cells[:1])], "question string, answer string, cells array<struct<cell_id:long,text:string>>")
    rows = rows.withColumn("forms", answercheck.cell_forms(F.col("cells"))).withColumn("k", F.monotonically_increasing_id())
    got = answercheck.rank_support(rows, ["question"]).where("question LIKE 'What%'").orderBy("rank").collect()
    assert [(r["cell_id"], r["has_text"], r["names"], r["anchors"], r["supports_all"], r["validates"]) for r in got] == [(7, True, [], ["ann lee"], False, False), (8, False, [], [], False, False), (9, True, ["Bob Roy"], ["ann lee"], True, True)]
    c = spark.createDataFrame([([(1, "loud", False), (2, "true", True), (3, None, True)],), ([(1, "loud", False)],), ([],)], "c array<struct<cell_id:long,text:string,accepted:boolean>>")
    said = [r["a"] for r in c.select(answercheck.verified_answer(F.col("c")).alias("a")).collect()]
    assert [(a["cited"], a["refused"]) for a in said] == [([2, 3], False), ([], True), ([], True)] and said[0]["text"] == "From verified memory:\n- (2) true\n- (3) "


def test_many_claims_take_time_in_proportion(spark):
    import time

    text = " ".join(f"This is claim number {i} of the answer." for i in range(16_000))
    began = time.time()
    rows = answercheck.claims(spark.createDataFrame([(1, text), (1, "One\x01two and three of them. " * 2)], "id long, answer string"), "id").collect()
    assert time.time() - began < 20 and len(rows) == 16_002
    assert all(r["claim"] == (text if r["claim_index"] > 1 or "claim number" in r["claim"] else "One\x01two and three of them. " * 2)[r["start"] : r["end"]] for r in rows)


def test_pairs_are_scored_by_tiles(spark):
    """Cells of one batch that fill several tiles, with equal activations and a vector that isn't a number: the best of each query, and no more pairs at once than a tile's."""
    rng = np.random.default_rng(5)
    w, q = rng.integers(-3, 4, (1300, 4)) / 2, rng.integers(-3, 4, (40, 4)) / 2
    vectors = [[float("nan")] * 4 if i == 700 else w[i].tolist() for i in range(1300)]
    cells = spark.createDataFrame([(i, v, 0.0, i % 3) for i, v in enumerate(vectors)], "cell_id long, weight array<double>, theta double, label int").coalesce(1)
    asked = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(q)], "query_id long, vector array<double>, query_label int")
    acts = np.delete(np.arange(1300), 700), q @ np.delete(w, 700, 0).T
    found = {(r["query_id"], r["rank"]): r["cell_id"] for r in R.topk(cells, asked, 7, by="act", include_silent=True).collect()}
    assert found == {(i, k + 1): acts[0][j] for i in range(40) for k, j in enumerate(np.lexsort((acts[0], -acts[1][i]))[:7])}
    sizes = activation.per_task(cells.where("cell_id <> 700"), asked, lambda ids, cell, act, kind: (np.array([0]), np.array([act.size])), "k long, n long", {"n": "max"})
    assert sizes.agg({"n": "max"}).first()[0] <= 40 * R.TILE < 40 * 1299
    counts = activation.fire_counts(cells.where("cell_id <> 700"), asked, 1.5).collect()
    assert {r["query_id"]: r["fires"] for r in counts} == dict(enumerate((acts[1] > 1.5).sum(1).tolist()))


def test_bm25_shuffles_no_pairs(spark, monkeypatch):
    """Blocks of queries against tiles of documents that hold few hits at once: scores equal the formula's, and queries meet documents within tasks."""
    for name, value in (("BLOCK", 3), ("BLOCK_WORDS", 8), ("TILE", 4), ("HITS", 5)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(8)
    words = np.array("fox lake river stone cloud amber".split())
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 9))) for i in range(60)}
    index = lexical.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    asked = {i: " ".join(rng.choice(words, 3)) for i in range(8)}
    found = lexical.bm25_topk(index, spark.createDataFrame(list(asked.items()), "query_id long, text string"), 5)
    assert "query_id" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in line)
    split = {i: t.split() for i, t in texts.items()}
    df = {w: sum(w in t for t in split.values()) for w in words}
    raw = {w: np.log((60 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    mean = np.mean([len(t) for t in split.values()])
    score = lambda q, t: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in q.split() if w in t)
    expected = {i: sorted(((-round(score(q, t), 6), d) for d, t in split.items() if score(q, t) > 0))[:5] for i, q in asked.items()}
    got = {i: [] for i in asked}
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 6), r["doc_id"]))
    assert got == expected and any(got.values())
