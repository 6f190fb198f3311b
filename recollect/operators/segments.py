"""A lexical index in immutable segments: additions and deletions write small tables, statistics are merged where it is opened.

A segment holds postings, document lengths and the document frequencies of its own words. A deletion is a segment too,
of ids alone; it takes out the documents of earlier segments, from postings, lengths and document frequencies, so that a query
gets the scores of an index built anew. Segments are numbered; one counts from the moment its entry in the log is written,
which comes last, so that what a failed write leaves behind is never read. Entries of the log are files of one line, and none is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import lexical
from recollect.sources.commits import CommitLog


class Segments:
    """An index over (doc_id, text) in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, CommitLog(spark, folder)

    def log(self) -> list[tuple[int, str, str]]:
        """(number, docs or gone, path) of the segments that count, in order: those from the last compaction on."""
        rows = self.commits.entries()
        start = max([i for i, r in enumerate(rows) if r[1] == "compacted"], default=0)
        return [(seq, "docs" if kind == "compacted" else kind, at) for seq, kind, at in rows[start:]]

    def _write(self, postings: DataFrame, lengths: DataFrame, kind: str) -> None:
        path = self.commits.fresh()
        lengths.write.parquet(f"{path}/lengths")
        postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id").write.parquet(f"{path}/postings")
        written = self.spark.read.parquet(f"{path}/postings")
        written.groupBy("token").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
        self.commits.append(kind, path)

    def add(self, texts: DataFrame) -> None:
        """A segment of the rows (doc_id, text), whose ids are in no live segment; delete them first."""
        index = lexical.build_index(texts)
        self._write(index["postings"], index["tokenised"].select("doc_id", "dl"), "docs")

    def delete(self, ids: DataFrame) -> None:
        """ids: doc_id. Takes them out of all segments so far; ids that none holds do nothing."""
        path = self.commits.fresh()
        ids.select("doc_id").distinct().write.parquet(f"{path}/ids")
        self.commits.append("gone", path)

    def _parts(self, name: str, log: list) -> DataFrame | None:
        out = None
        for seq, kind, path in log:
            if kind == "docs":
                part = self.spark.read.parquet(f"{path}/{name}").withColumn("seq", F.lit(seq))
                out = part if out is None else out.unionByName(part)
        return out

    def open(self) -> dict[str, DataFrame]:
        """The tables that lexical.bm25_topk takes: postings (token, doc_id, dl, tf), terms (token, df) and stats (n, avgdl) of the live documents."""
        log = self.log()
        postings, terms, lengths = (self._parts(name, log) for name in ("postings", "terms", "lengths"))
        if postings is None:
            raise ValueError("the index has no segment of documents")
        gone = None
        for seq, kind, path in log:
            if kind == "gone":
                part = self.spark.read.parquet(f"{path}/ids").select("doc_id", F.lit(seq).alias("gone_at"))
                gone = part if gone is None else gone.unionByName(part)
        if gone is not None:
            # the last deletion of an id takes out what stands before it
            gone = gone.groupBy("doc_id").agg(F.max("gone_at").alias("gone_at")).select(F.col("doc_id").alias("gone_id"), "gone_at")
            dead = (F.col("doc_id") == F.col("gone_id")) & (F.col("seq") < F.col("gone_at"))
            lost = postings.join(gone, dead, "left_semi").groupBy("token").agg((-F.count(F.lit(1))).alias("df"))
            postings, lengths = postings.join(gone, dead, "left_anti"), lengths.join(gone, dead, "left_anti")
            terms = terms.select("token", "df").unionByName(lost)
        terms = terms.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        return {"postings": postings.drop("seq"), "terms": terms, "stats": lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))}

    def compact(self) -> None:
        """One segment of all live documents in place of those so far, whose files stay for readers that have them open."""
        log = self.log()
        live = self.open()
        lengths = self._parts("lengths", log)
        # documents without a word have no posting, so lengths are filtered by themselves
        for seq, kind, path in log:
            if kind == "gone":
                ids = self.spark.read.parquet(f"{path}/ids").select(F.col("doc_id").alias("gone_id"))
                lengths = lengths.join(ids, (F.col("doc_id") == F.col("gone_id")) & (F.col("seq") < seq), "left_anti")
        self._write(live["postings"], lengths.select("doc_id", "dl"), "compacted")
