"""Tables that change in whole steps: parts are written beside the others and count from the moment the log names them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import vector as V
from recollect.functions.text import collapsed, paragraphs
from recollect.operators import governance
from recollect.operators import retrieval as R
from recollect.operators.corpus import running_sums
from recollect.session import release, stored
from recollect.sources.files import Bank, exists, markdown_sections


class CommitLog:
    """Numbered entries (seq, kind, path), each a file of one line that is never replaced. One writer at a time."""

    SCHEMA = "seq long, kind string, path string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> list[tuple[int, str, str]]:
        path = f"{self.folder}/log"
        return sorted(tuple(r) for r in self.spark.read.schema(self.SCHEMA).json(path).collect()) if exists(self.spark, path) else []

    def append(self, kind: str, path: str) -> int:
        seq = max([e[0] for e in self.entries()], default=0) + 1
        self.spark.range(1).select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(path).alias("path")).coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return seq

    def fresh(self) -> str:
        """A path for a part that nothing names so far."""
        return f"{self.folder}/part-{uuid.uuid4().hex}"


class LoggedBank:
    """A bank whose changes are parts (folders of parquet tables) named by a commit log: all tables of a part count at once, or none does."""

    SCHEMAS = Bank.SCHEMAS | {"whitening": "mean array<double>, matrix array<array<double>>, max_norm double, rows long", "log": "op string, cell_id long, detail string, source string", "ledger": "item_hash string, cell_id long, source string"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, CommitLog(spark, folder)

    def table(self, name: str, also: str | None = None) -> DataFrame:
        """The rows of all parts that count; also: one more part, as if it did."""
        out = self.spark.createDataFrame([], self.SCHEMAS[name])
        for path in [p for _, _, p in self.commits.entries()] + [also] * (also is not None):
            if exists(self.spark, f"{path}/{name}"):
                out = out.unionByName(self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{path}/{name}"))
        return out

    def write(self, tables: dict[str, DataFrame]) -> str:
        """The tables as a part that doesn't count yet."""
        path = self.commits.fresh()
        for name, rows in tables.items():
            rows.select(*[c.split()[0] for c in self.SCHEMAS[name].split(", ")]).write.parquet(f"{path}/{name}")
        return path

    def commit(self, path: str, kind: str = "add") -> int:
        return self.commits.append(kind, path)

    def top(self) -> int:
        """The greatest cell id, 0 in an empty bank."""
        return self.table("cells").agg(F.coalesce(F.max("cell_id"), F.lit(0))).first()[0]

    def numbered(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """`rows` with cell_id, going on above the bank's greatest id in the order of the columns."""
        placed = running_sums(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one")
        return placed.withColumn("cell_id", F.col("start") + self.top() + 1).drop("_one", "start")


def insert(bank: LoggedBank, rows: DataFrame, order: str, theta: float = 0.30, created: float = 0.0) -> DataFrame:
    """rows: `order`, label, weight, text, sources (ids of cells that a bound cell rests on; null or empty for a single one). Cells, texts and edges in one step; cell_id by `order`.

    A source that the bank doesn't hold refuses all of it.
    """
    new = stored(bank.numbered(rows, [order]), "inserted")
    edges = new.select(F.col("cell_id").alias("bound_cell_id"), F.explode("sources").alias("source_cell_id")).distinct()
    unknown = edges.join(bank.table("cells"), F.col("source_cell_id") == F.col("cell_id"), "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"no cell has the id {unknown.first()['source_cell_id']}")
    kind = F.when(F.size(F.coalesce("sources", F.array())) > 0, "bound").otherwise("single")
    cells = new.select("cell_id", "label", F.col("weight").cast("array<float>").alias("weight"), F.lit(theta).alias("theta"), kind.alias("kind"), F.lit(created).alias("created_at"))
    bank.commit(bank.write({"cells": cells, "texts": new.where("text IS NOT NULL").select("cell_id", "text"), "edges": edges}))
    return new.select(order, "cell_id")


def commit_candidates(bank: LoggedBank, candidates: DataFrame, source: str, smoke: list[float] | None = None, k: int = 5, theta: float = 0.30) -> DataFrame:
    """candidates: draft_id, text, label, weight, accepted. Accepted texts that the bank doesn't hold yet become cells, with their texts and log, in one step; the report in one row.

    Texts are compared in their normal form, also among each other. smoke: a query vector of which one of the best k cells must be a new one;
    else nothing is committed, and what was written stays unnamed. Without new cells nothing is written.
    """
    drafts = stored(candidates, "drafts")
    kept = drafts.where("accepted")
    fresh = governance.new_texts_only(kept.select("draft_id", "text"), bank.table("texts"))
    new = stored(bank.numbered(kept.join(fresh.select("draft_id"), "draft_id", "left_semi"), ["draft_id"]), "fresh")
    added = new.agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("a"), F.max("cell_id").alias("b")).first()
    hit, best, committed = None, None, False
    if added["n"]:
        cells = new.select("cell_id", "label", F.col("weight").cast("array<float>").alias("weight"), F.lit(theta).alias("theta"), F.lit("single").alias("kind"), F.lit(0.0).alias("created_at"))
        log = new.select(F.lit("add").alias("op"), "cell_id", F.col("text").alias("detail"), F.lit(source).alias("source"))
        path = bank.write({"cells": cells, "texts": new.select("cell_id", "text"), "log": log})
        if smoke is not None:
            asked = bank.spark.createDataFrame([(0, smoke)], "query_id long, vector array<double>")
            found = R.topk(bank.table("cells", path), asked, k, by="act", include_silent=True).orderBy("rank").collect()
            best, hit = found[0]["cell_id"], any(added["a"] <= r["cell_id"] <= added["b"] for r in found)
        if hit is not False:
            bank.commit(path)
            committed = True
    counts = drafts.agg(F.count(F.lit(1)).alias("proposed"), F.count_if("accepted").alias("passed"), F.sum(F.length("text")).alias("text_chars"))
    n, no = F.lit(added["n"]).cast("long"), F.lit(None).cast("long")
    return counts.select(
        F.lit(source).alias("source"), "proposed", F.when(F.lit(committed), n).otherwise(0).alias("added"), (F.col("proposed") - F.col("passed")).alias("rejected"), (F.col("passed") - n).alias("duplicates"), F.coalesce("text_chars", F.lit(0)).cast("long").alias("text_chars"),
        F.lit(hit is not None).alias("smoke_ran"), F.lit(bool(hit)).alias("smoke_hit"), F.lit(best).cast("long").alias("top_cell_id"), (F.lit(added["a"]).cast("long") if committed else no).alias("first_id"), (F.lit(added["b"]).cast("long") if committed else no).alias("last_id"), F.lit(committed).alias("reload_required"),
    )


def load_items(files: DataFrame, min_chars: int = 80, label_from: str = "filename", by_section: bool = False) -> DataFrame:
    """files: path, text. The items to load: path, k (their order in a file), text and label.

    Items are paragraphs divided by empty lines or, with by_section, the sections of .md files; those of fewer than min_chars are left
    out. label_from: filename (with the section's heading), heading, or none.
    """
    if label_from not in ("filename", "heading", "none"):
        raise ValueError("label_from is filename, heading or none")
    stem = F.translate(F.regexp_replace(F.regexp_extract("path", r"([^/]*?)/*$", 1), r"(?<=.)\.[^.]*$", ""), "_-", "  ")
    named = files.select("path", F.coalesce("text", F.lit("")).alias("text"), stem.alias("stem"))
    none = F.lit(None).cast("string")
    if by_section:
        md = F.lower("path").endswith(".md")
        sections = named.where(md).select("path", "stem", F.posexplode(markdown_sections(F.col("text"))).alias("k", "s")).where(F.length("s.body") >= min_chars).select("path", "stem", "k", F.col("s.body").alias("text"), F.col("s.heading").alias("heading"))
        named = named.where(~md)
    plain = named.select("path", "stem", F.posexplode(paragraphs(F.col("text"), r"\n\s*\n", min_chars)).alias("k", "text")).withColumn("heading", none)
    items = plain.unionByName(sections) if by_section else plain
    heading = F.nullif(F.col("heading"), F.lit(""))
    label = {"filename": F.concat_ws(" — ", "stem", heading), "heading": heading, "none": none}[label_from]
    return items.select("path", "k", "text", label.alias("label"))


def load_once(bank: LoggedBank, items: DataFrame, encoded: Column | None = None, dim: int = 64, theta: float = 0.30) -> int:
    """Loads items (path, k, text, label) that no former load has brought, and says how many; repeated ones count once.

    A ledger of content hashes (label and text) is a table of the same part as cells and texts, so that a load that was broken off has
    loaded nothing, and one that is run again adds what is missing. encoded: the vector of a text (None: the one that follows from its hash).
    """
    h = F.sha2(F.concat_ws("\x01", F.coalesce("label", F.lit("")), "text"), 256)
    first = items.withColumn("item_hash", h).groupBy("item_hash").agg(F.min(F.struct("path", "k", "text", "label")).alias("i")).select("item_hash", "i.*")
    new = stored(bank.numbered(first.join(bank.table("ledger"), "item_hash", "left_anti"), ["path", "k", "item_hash"]), "loaded")
    n = new.count()
    if n:
        weight = V.unit(V.hash_embedding(F.col("text"), dim)) if encoded is None else encoded
        cells = new.select("cell_id", "label", weight.cast("array<float>").alias("weight"), F.lit(theta).alias("theta"), F.lit("single").alias("kind"), F.lit(0.0).alias("created_at"))
        bank.commit(bank.write({"cells": cells, "texts": new.select("cell_id", "text"), "ledger": new.select("item_hash", "cell_id", F.col("path").alias("source"))}))
    release(new)
    return n


def with_sources(chosen: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """chosen: cell_id; edges: bound_cell_id, source_cell_id. The chosen cells and all that they rest on, directly or through others. Each round joins only what the last one has added; tables of former rounds stay stored until the end."""
    seen = stored(chosen.select("cell_id").distinct(), "closed")
    new = seen
    for _ in range(rounds):
        step = new.join(edges, F.col("cell_id") == F.col("bound_cell_id")).select(F.col("source_cell_id").alias("cell_id")).distinct().join(seen, "cell_id", "left_anti")
        new = stored(step, "closing")
        if new.isEmpty():
            return seen
        seen = stored(seen.unionByName(new), "closed")
    raise RuntimeError(f"the edges don't close in {rounds} rounds")


def export_subset(bank: LoggedBank, folder: str, n: int) -> LoggedBank:
    """The first n single cells by id, the bound cells that rest on them alone, and what those rest on, as a bank of its own with texts, edges, meta and whitening."""
    cells, edges = bank.table("cells"), bank.table("edges")
    singles = stored(cells.where("kind = 'single'").select("cell_id").orderBy("cell_id").limit(n), "singles")
    # a bound cell comes along if no source of it, through others too, is a single cell beyond the first n
    outside = cells.where("kind = 'single'").select("cell_id").join(singles, "cell_id", "left_anti")
    reversed_edges = edges.select(F.col("source_cell_id").alias("bound_cell_id"), F.col("bound_cell_id").alias("source_cell_id"))
    spoilt = with_sources(outside, reversed_edges)
    bound = cells.where("kind = 'bound'").select("cell_id").join(spoilt, "cell_id", "left_anti")
    kept = stored(singles.unionByName(bound), "kept")
    out = LoggedBank(bank.spark, folder)
    mine = lambda t, c="cell_id": t.join(kept.select(F.col("cell_id").alias(c)), c, "left_semi")
    out.commit(out.write({"cells": mine(cells), "texts": mine(bank.table("texts")), "edges": mine(edges, "bound_cell_id"), "meta": bank.table("meta"), "whitening": bank.table("whitening")}), "subset")
    return out


def dangling(bank: LoggedBank) -> DataFrame:
    """Edges whose cell or source the bank doesn't hold."""
    cells, edges = bank.table("cells").select("cell_id"), bank.table("edges")
    a = edges.join(cells, F.col("bound_cell_id") == F.col("cell_id"), "left_anti")
    return a.unionByName(edges.join(cells, F.col("source_cell_id") == F.col("cell_id"), "left_anti")).distinct()


def single_texts(bank: LoggedBank) -> DataFrame:
    """Single cells that have a text: cell_id, label, text."""
    return bank.table("cells").where("kind = 'single'").join(bank.table("texts").where(collapsed(F.col("text")) != ""), "cell_id").select("cell_id", "label", "text")
