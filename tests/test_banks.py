"""Banks that change in whole steps: insertion, loads that repeat, commits that are refused, and subsets."""

import pytest
from pyspark.sql import functions as F

from recollect.sources import commits as C

ROWS = "n long, label string, weight array<double>, text string, sources array<long>"


def bank_of(spark, tmp_path, name="bank"):
    return C.LoggedBank(spark, f"file://{tmp_path}/{name}")


def rows(spark, *xs):
    return spark.createDataFrame([(n, "l", [float(n), 1.0], t, s) for n, t, s in xs], ROWS)


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_inserted_cells_go_on_above_the_last(spark, tmp_path):
    bank = bank_of(spark, tmp_path)
    assert bank.top() == 0 and bank.table("cells").collect() == []
    assert ids(C.insert(bank, rows(spark, (5, "a", None), (3, "b", [])), "n"), "n", "cell_id") == [(3, 1), (5, 2)]
    assert ids(C.insert(bank, rows(spark, (1, None, [1, 2, 2])), "n"), "cell_id") == [(3,)]
    assert ids(bank.table("edges"), "bound_cell_id", "source_cell_id") == [(3, 1), (3, 2)]
    assert ids(bank.table("cells"), "cell_id", "kind") == [(1, "single"), (2, "single"), (3, "bound")] and ids(bank.table("texts"), "cell_id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        C.insert(bank, rows(spark, (1, "c", [77])), "n")
    assert bank.top() == 3 and C.dangling(bank).collect() == []
    assert ids(C.single_texts(bank), "cell_id") == [(1,), (2,)]


def test_what_no_entry_names_does_not_count(spark, tmp_path):
    bank = bank_of(spark, tmp_path)
    C.insert(bank, rows(spark, (1, "a", None)), "n")
    cells = bank.table("cells").withColumn("cell_id", F.lit(9).cast("long"))
    path = bank.write({"cells": cells})
    assert bank.top() == 1 and bank.table("cells", path).count() == 2
    bank.commit(path)
    assert bank.top() == 9


def test_loads_repeat_and_break_off(spark, tmp_path, monkeypatch):
    bank = bank_of(spark, tmp_path)
    files = spark.createDataFrame([("a/my_first-file.txt", "long enough text\n\nshort\n\nlong enough text\n \nanother long text"), ("b/x.md", "before it all\n# Head\nlong body text here\n## No\nx"), ("c/none.txt", None)], "path string, text string")
    plain = C.load_items(files, 10)
    assert ids(plain, "label", "k") == [("my first file", 0), ("my first file", 1), ("my first file", 2), ("x", 0)]
    sections = C.load_items(files, 10, by_section=True).where("path = 'b/x.md'")
    assert ids(sections, "label", "text") == [("x", "before it all"), ("x — Head", "long body text here")]
    assert [r["label"] for r in C.load_items(files, 10, "heading", True).where("path = 'b/x.md'").orderBy("k").collect()] == [None, "Head"]
    with pytest.raises(ValueError):
        C.load_items(files, 10, "title")
    # a load that breaks off before its entry is written has loaded nothing
    with monkeypatch.context() as m:
        m.setattr(bank, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            C.load_once(bank, plain)
    assert bank.table("cells").count() == 0
    assert C.load_once(bank, plain.where("path = 'b/x.md'")) == 1 and C.load_once(bank, plain) == 2 and C.load_once(bank, plain) == 0
    assert ids(bank.table("cells").join(bank.table("texts"), "cell_id"), "cell_id", "label", "text")[1:] == [(2, "my first file", "long enough text"), (3, "my first file", "another long text")]
    assert bank.table("ledger").count() == 3 and len(bank.commits.entries()) == 2
    norms = bank.table("cells").select(F.sqrt(F.aggregate("weight", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in norms)


def test_a_smoke_query_that_fails_refuses_the_commit(spark, tmp_path):
    bank = bank_of(spark, tmp_path)
    C.insert(bank, rows(spark, (1, "Old  text", None), (2, "other", None)), "n")
    drafts = spark.createDataFrame([(1, "old TEXT", "l", [9.0, 0.0], True), (2, "new text", "l", [0.0, 7.0], True), (3, "New text ", "l", [0.0, 8.0], True), (4, "no", "l", [1.0, 1.0], False)], "draft_id long, text string, label string, weight array<double>, accepted boolean")
    report = lambda *a: C.commit_candidates(bank, drafts, "s", *a).first().asDict()
    r = report([1.0, -1.0], 1)
    assert (r["added"], r["smoke_ran"], r["smoke_hit"], r["top_cell_id"], r["reload_required"]) == (0, True, False, 2, False) and bank.top() == 2
    r = report([0.0, 1.0], 1)
    assert (r["proposed"], r["added"], r["rejected"], r["duplicates"], r["smoke_hit"], r["first_id"], r["last_id"]) == (4, 1, 1, 2, True, 3, 3)
    assert ids(bank.table("texts"), "cell_id", "text")[-1] == (3, "new text") and ids(bank.table("log"), "op", "cell_id", "detail", "source") == [("add", 3, "new text", "s")]
    r = report([0.0, 1.0], 1)
    assert (r["added"], r["duplicates"], r["smoke_ran"]) == (0, 3, False) and bank.top() == 3


def test_subsets_are_closed(spark, tmp_path):
    bank = bank_of(spark, tmp_path)
    C.insert(bank, rows(spark, *[(i, f"t{i}", None) for i in range(1, 7)]), "n")
    C.insert(bank, rows(spark, (1, None, [1, 2]), (2, None, [2, 6])), "n")  # 7, 8
    C.insert(bank, rows(spark, (1, None, [7, 3]), (2, None, [8, 1])), "n")  # 9, 10
    out = C.export_subset(bank, f"file://{tmp_path}/out", 3)
    assert ids(out.table("cells"), "cell_id") == [(1,), (2,), (3,), (7,), (9,)] and C.dangling(out).collect() == []
    assert ids(out.table("edges"), "bound_cell_id", "source_cell_id") == [(7, 1), (7, 2), (9, 3), (9, 7)] and out.table("texts").count() == 3
    chosen = spark.createDataFrame([(10,)], "cell_id long")
    assert ids(C.with_sources(chosen, bank.table("edges")), "cell_id") == [(1,), (2,), (6,), (8,), (10,)]
