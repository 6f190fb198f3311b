"""Retrieval in two passes, index segments and token files against plain versions."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect.functions.tokens import token_ids, tokenizer
from recollect.operators import lexical, multihop
from recollect.operators import token_chunks as T
from recollect.operators.segments import Segments
from recollect.sources import token_files
from recollect.sources.token_files import read_token_cells, write_token_cells


def test_names_of_the_first_pass(spark):
    rows = [
        (["The Old Mill of Ann Lee. Beginning Now", None, "Ann Lee met Bob. BOB"], "who is bob?", ["The Old Mill", "Ann Lee", "Beginning Now"]),
        (["The", "Café Zola and xAbc, Éva Toth"], "", ["Zola", "Toth"]),
        (["A1 Aa Bb-Cc. Dd Ee"], None, ["Aa Bb-Cc", "Dd Ee"]),
        ([" ".join(f"x {c}{c.lower()}," for c in "BCDEFGHIJ")], "dd", ["Bb", "Cc", "Ee", "Ff", "Gg", "Hh"]),
        ([], "nothing", []),
    ]
    df = spark.createDataFrame(rows, "texts array<string>, question string, names array<string>")
    got = [(r["names"], r["got"]) for r in df.select("names", multihop.feedback_names(F.col("texts"), F.col("question")).alias("got")).collect()]
    assert all(names == found for names, found in got)


def test_the_first_pass_keeps_its_rank(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank int, cell_id long")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (2, 1, 9)], "query_id long, rank int, cell_id long")
    assert sorted(tuple(r) for r in multihop.two_passes(a, b).collect()) == [(1, 10, 1, 1, 1), (1, 11, 1, 2, 2), (1, 12, 2, 2, 3), (2, 9, 2, 1, 1)]


TEXTS = "doc_id long, text string"


def ranked(index, asked):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in lexical.bm25_topk(index, asked, 3).collect())


def test_segments_score_like_one_index(spark, tmp_path):
    first = [(1, "red fox runs"), (2, "blue fox sleeps in rain"), (3, ""), (4, "green tree")]
    later = [(5, "fox fox tree"), (6, None)]
    again = [(2, "purple fox dreams"), (7, "tree rain rain")]
    asked = spark.createDataFrame([(1, "fox rain"), (2, "tree"), (3, "blue"), (4, "zzz")], "query_id long, text string")
    frame = lambda rows: spark.createDataFrame(rows, TEXTS)
    s = Segments(spark, f"file://{tmp_path}/index")
    with pytest.raises(ValueError):
        s.open()
    s.add(frame(first))
    s.add(frame(later))
    s.delete(frame([(2, ""), (4, ""), (99, "")]))
    s.add(frame(again))
    live = frame([x for x in first if x[0] not in (2, 4)] + later + again)
    new = lexical.build_index(live)
    assert ranked(s.open(), asked) == ranked(new, asked)
    stats = lambda i: tuple(i["stats"].select("n", F.round("avgdl", 9)).first())
    assert stats(s.open()) == stats(new)
    assert sorted(map(tuple, s.open()["terms"].select("token", "df").collect())) == sorted(map(tuple, new["terms"].select("token", "df").collect()))
    # what a failed write leaves behind isn't read, and compaction changes no result
    os.makedirs(tmp_path / "index" / "segment-left")
    s.compact()
    assert len(s.log()) == 1 and ranked(s.open(), asked) == ranked(new, asked) and stats(s.open()) == stats(new)
    s.delete(frame([(7, "")]))
    s.add(frame([(7, "fox")]))
    assert ranked(s.open(), asked) == ranked(lexical.build_index(frame([(1, "red fox runs"), (3, ""), (5, "fox fox tree"), (6, None), (2, "purple fox dreams"), (7, "fox")])), asked)


def cells(spark):
    texts = ["one two three", "", None, "<|endoftext|> is text", "w " * 300, "grün 東京"] + [f"row {i} " * (i % 7) for i in range(40)]
    return texts, token_ids(spark.createDataFrame(list(enumerate(texts)), "cell_id long, text string").repartition(3), "cell_id", "text")


def test_token_files_are_the_stream(spark, tmp_path):
    texts, tokens = cells(spark)
    t = tokenizer()
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 50256] for x in texts]
    stream, of = [x for i in ids for x in i], [k for k, i in enumerate(ids) for _ in i]
    folder = str(tmp_path / "s")
    for _ in range(2):  # writing again gives the same stream
        token_files.write_token_cells(tokens, folder)
        for tail in (True, False):
            got = token_files.read_token_cells(spark, folder, 16, tail).orderBy("chunk_id").collect()
            n = len(stream) if tail else len(stream) // 16 * 16
            assert [r["tokens"] for r in got] == [stream[a : min(a + 16, n)] for a in range(0, n, 16)]
            assert [r["cells"] for r in got] == [of[a : min(a + 16, n)] for a in range(0, n, 16)]
    # what one task reads makes no difference, nor do files of the former stream
    spark.dataSource.register(token_files.TokenFiles)
    small = spark.read.format("token_files").option("length", 7).option("tail", "true").option("per_task", 3).load(f"{folder}/tokens")
    assert [x for r in small.orderBy("chunk_id").collect() for x in r["tokens"]] == stream
    assert token_files.drop_unnamed(f"{folder}/tokens") > 0 and token_files.drop_unnamed(f"{folder}/tokens") == 0
    back = {r["cell_id"]: r["tokens"] for r in T.cell_tokens(token_files.read_token_cells(spark, folder, 16, True)).collect()}
    assert back == dict(enumerate(ids))
    fixed = {r["cell_id"]: r["tokens"] for r in T.fixed_tokens(tokens, 8).collect()}
    assert fixed == {k: (i + [50256] * 8)[:8] for k, i in enumerate(ids)}


def test_token_files_refuse_gaps(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = lambda x: spark.createDataFrame(x, "start long, tokens array<int>")
    token_files.write_stream(rows([(0, [1, 2]), (2, [3])]), folder)
    for bad in ([(0, [1, 2]), (3, [3])], [(0, [1, 2]), (1, [3])], [(0, [70_000])], [(0, [-1])]):
        with pytest.raises(Exception):  # noqa: B017
            token_files.write_stream(rows(bad), folder)
        assert [r["tokens"] for r in token_files.read_stream(spark, folder, 2, True).orderBy("chunk_id").collect()] == [[1, 2], [3]]
    token_files.write_stream(rows([]), folder)
    assert token_files.read_stream(spark, folder, 2, True).collect() == [] and json.load(open(f"{folder}/manifest.json"))["n"] == 0


def test_chunks_and_neighbors_over_a_stored_table(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tokens = token_ids(docs, "doc_id", "text").withColumnRenamed("doc_id", "cell_id")
    tokens.write.parquet(str(tmp_path / "t"))
    folder = str(tmp_path / "s")
    token_files.write_token_cells(spark.read.parquet(str(tmp_path / "t")), folder)
    chunks = token_files.read_token_cells(spark, folder)
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    bank = e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("weight"), F.lit(0.22).alias("theta"))
    asked = T.chunk_queries(chunks, bank.select("cell_id", F.col("weight").alias("vector")), 20)
    con = duckdb.connect()
    con.sql(f"""CREATE TABLE u AS SELECT *, row_number() OVER (ORDER BY cell_id, i) - 1 AS pos FROM (SELECT cell_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM read_parquet('{tmp_path}/t/*.parquet'))""")
    con.sql("CREATE TABLE c AS SELECT pos // 64 AS chunk_id, list(token ORDER BY pos) AS tokens, list(cell_id ORDER BY pos) AS cells FROM u GROUP BY chunk_id HAVING count(*) = 64")
    assert sorted(map(tuple, chunks.collect())) == sorted(con.sql("SELECT chunk_id, tokens, cells FROM c").fetchall())
    con.sql(f"CREATE TABLE e AS SELECT vec_id, embedding::DOUBLE[] AS w FROM read_parquet('{data}/embeddings.parquet')")
    con.sql("CREATE TABLE q AS SELECT chunk_id, w AS qv FROM (SELECT chunk_id, cell, count(*) AS n FROM (SELECT chunk_id, unnest(cells) AS cell FROM c WHERE chunk_id % 20 = 0) JOIN e ON vec_id = cell GROUP BY chunk_id, cell QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, cell) = 1) JOIN e ON vec_id = cell")
    con.sql("CREATE TABLE r AS SELECT chunk_id, vec_id, row_number() OVER (PARTITION BY chunk_id ORDER BY round(list_inner_product(qv, w), 9) DESC, vec_id) AS rank FROM q, e QUALIFY rank <= 8")
    plain = con.sql("SELECT chunk_id, rank, vec_id FROM r WHERE rank <= 2").fetchall()
    assert sorted((r["query_id"], r["slot"], r["cell_id"]) for r in T.chunk_neighbors(chunks, bank, asked, exclude=False).collect()) == sorted(plain)
    kept = con.sql("SELECT r.chunk_id, row_number() OVER (PARTITION BY r.chunk_id ORDER BY rank) AS slot, vec_id FROM r JOIN c ON c.chunk_id = r.chunk_id WHERE NOT list_contains(cells, vec_id) QUALIFY slot <= 2").fetchall()
    got = T.chunk_neighbors(chunks.where("chunk_id % 20 = 0"), bank, asked).collect()
    assert sorted((r["query_id"], r["slot"], r["cell_id"]) for r in got) == sorted(kept) and not any(r["filled"] for r in got)


def test_held_out_paragraphs(spark):
    articles = [(i, f"short\n\n{'long enough ' * 8} {i}\n\nalso  long\nenough {'x ' * 40}{i}") for i in range(12)] + [(20, None)]
    df = spark.createDataFrame(articles, "doc_id long, text string")
    p = T.article_paragraphs(df, 3, 4, 60).orderBy("paragraph_id").collect()
    assert [r["paragraph_id"] for r in p] == list(range(8)) and [r["doc_id"] for r in p] == [3, 3, 4, 4, 5, 5, 6, 6]
    assert p[1]["text"] == f"also long enough {'x ' * 40}3" and T.held_out_tokens(df, 3, 4, 60).count() == 8


def test_tokens_are_made_once(spark, tmp_path):
    """Neither the sort nor the second stream makes the tokens of a cell again."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cells = spark.range(40).selectExpr("id AS cell_id", "array_repeat(cast(id AS int), cast(id % 9 AS int)) AS tokens").mapInArrow(run, "cell_id long, tokens array<int>")
    write_token_cells(cells, str(tmp_path))
    assert made.value == 40
    back = T.cell_tokens(read_token_cells(spark, str(tmp_path), 7, True)).collect()
    assert {r["cell_id"]: r["tokens"] for r in back} == {i: [i] * (i % 9) for i in range(40) if i % 9}


def test_ranks_give_the_ids_of_tokenizers():
    import numpy as np

    from recollect.functions.tokens import decoded, encoded

    t, draw = tokenizer(), np.random.default_rng(0)
    texts = ["", "<|endoftext|> x<|endoftext|>", " " * 600_000, "a" * 5000, "é東\u0085　​ ́'s 'LL x_1,2"] + ["".join(draw.choice(list(" \t\n\r\x0b\xa0'stmaA1,.é東ß"), 20)) for _ in range(300)]
    for x in texts:
        ids = encoded(x).tolist()
        assert ids == t.encode(x, add_special_tokens=False).ids and decoded(ids) == x
    for ids in [[60_000, 31373, 50256], [], *draw.integers(0, 256, (50, 6)).tolist()]:  # unknown ones, and bytes that are no text
        assert decoded(ids) == t.decode(ids, skip_special_tokens=False)


def split_rows(spark, docs, folder):
    """What token_split_files and its SQL say of documents."""
    from recollect.plans import tokens as P

    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = P.token_split_files(spark, str(folder)).select("part", "n_cells", "n_chars", "digest").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted(map(tuple, got)), sorted(con.sql(P.ORACLES["token_split_files"]).fetchall())


def test_split_files_make_tokens_once(spark, tmp_path, monkeypatch):
    """Each text is given to the tokenizer once, not once for each part, and a part without cells is no row."""
    from recollect.plans import tokens as P

    given = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            given.add(b.num_rows)
            yield b

    monkeypatch.setattr(P, "token_ids", lambda rows, *a: token_ids(rows.mapInArrow(count, rows.schema), *a))
    texts = [None, "", "<|endoftext|> is text", "grün 東京 "] + [f"row {i} " * (i % 7) for i in range(56)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, expected = split_rows(spark, docs, tmp_path)
    assert got == expected and [r[:2] for r in got] == [("train", 57), ("val", 3)]
    assert given.value == 60
    few, expected = split_rows(spark, docs.where("doc_id < 9"), tmp_path)
    assert few == expected and [r[:2] for r in few] == [("train", 9)]
    assert split_rows(spark, docs.where("false"), tmp_path) == ([], [])
    got, expected = split_rows(spark, docs.selectExpr("nullif(doc_id, 20) AS doc_id", "text"), tmp_path)
    assert got == expected and sum(r[1] for r in got) == 60


def test_first_share_is_that_of_the_split(spark):
    from recollect.operators import splits

    ids = spark.range(7, 400, 3).withColumnRenamed("id", "doc_id").repartition(5)
    for share in (0.0, 0.05, 0.5, 1.0):
        want = {r["doc_id"] for r in splits.row_split(ids, "doc_id", share).where("part = 'val'").collect()}
        got = ids.where(splits.in_first_share(ids, "doc_id", share)).collect()
        assert len(got) == int(131 * share) and {r["doc_id"] for r in got} == want
        assert ids.where(~splits.in_first_share(ids, "doc_id", share)).count() == 131 - len(got)


def test_cells_are_read_as_written(spark, tmp_path):
    """Cells come back whole whatever a task's part of the file, also equal ids and one that is longer than a batch; the order is checked."""
    rows = [(2, [7, 8]), (3, []), (3, [1]), (3, [2, 3]), (5_000_000_000, [9] * (token_files.BATCH + 5)), (5_000_000_001, [4])]
    cells = spark.createDataFrame(rows, "cell_id long, tokens array<int>")
    folder = str(tmp_path / "s")
    token_files.write_token_cells(cells.repartition(4), folder)
    want = sorted(x for x in rows if x[1])
    spark.dataSource.register(token_files.TokenCells)
    for per_task in (100_000, 1 << 21):
        back = spark.read.format("token_cells").option("per_task", per_task).load(f"{folder}/tokens")
        assert sorted(map(tuple, back.collect())) == want
    assert sorted(map(tuple, token_files.read_cells(spark, folder).collect())) == want
    short = [r for r in rows if len(r[1]) < 9]
    token_files.write_token_cells(cells.where("size(tokens) < 9"), str(tmp_path / "t"))
    for per_task in (1, 2, 3):
        back = spark.read.format("token_cells").option("per_task", per_task).load(f"{tmp_path}/t/tokens")
        assert sorted(map(tuple, back.collect())) == sorted(x for x in short if x[1])
    for bad in ([(2, [1]), (1, [1])], [(1, [1]), (None, [1])], [(1, [70_000])], [(1, [-1])], [(1, [None])]):
        with pytest.raises(Exception):  # noqa: B017
            token_files.write_sorted_cells(spark.createDataFrame(bad, "cell_id long, tokens array<int>").coalesce(1), folder)
    with pytest.raises(Exception, match="stands after"):
        token_files.write_sorted_cells(spark.range(0, 2, 1, 2).selectExpr("1 - id AS cell_id", "array(1) AS tokens"), folder)
    assert sorted(map(tuple, token_files.read_cells(spark, folder).collect())) == want


def test_round_trip_stores_the_files_alone(spark, tmp_path, monkeypatch):
    """Beside the token files (2 bytes for each token, 16 for each cell) nothing but the result is stored, and they go; equal ids are documents of their own."""
    from recollect.plans import tokens as P
    from recollect.session import release, scratch_root

    root, sizes = scratch_root(spark).removeprefix("file://"), []
    in_folder = lambda top: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs if f.startswith("part-"))

    def released(*tables):
        sizes.extend(in_folder(t.stored_at.removeprefix("file://")) for t in tables)
        return release(*tables)

    monkeypatch.setattr(P, "release", released, raising=False)
    texts = [None, "", "grün 東京 "] + [f"row {i} " * i for i in range(60)]
    spark.createDataFrame([(i // 2 if i > 3 else None, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = P.token_files_round_trip(spark, str(tmp_path)).select("doc_id", "text_md5").collect()
    assert [x.split("-")[0] for x in set(os.listdir(root)) - before] == ["said"]
    n = sum(len(tokenizer().encode(x or "", add_special_tokens=False).ids) + 1 for x in texts)
    assert sizes == [2 * n + 16 * len(texts)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(P.ORACLES["token_files_round_trip"]).fetchall(), key=repr)


def test_cells_without_an_id(spark, tmp_path):
    """They come back without one, whole and in chunks."""
    rows = [(None, [5, 6, 7]), (1, [8]), (None, [9]), (2, [3, 4])]
    folder = str(tmp_path / "s")
    token_files.write_token_cells(spark.createDataFrame(rows, "cell_id long, tokens array<int>").repartition(2), folder)
    assert sorted(map(tuple, token_files.read_cells(spark, folder).collect()), key=repr) == sorted(rows, key=repr)
    got = [x for r in token_files.read_token_cells(spark, folder, 2, True).orderBy("chunk_id").collect() for x in zip(r["cells"], r["tokens"])]
    assert got[4:] == [(1, 8), (2, 3), (2, 4)] and sorted(x for _, x in got[:4]) == [5, 6, 7, 9] and {x for x, _ in got[:4]} == {None}
