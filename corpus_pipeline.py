"""The corpus pipeline: documents are classified, shared lines and near duplicates go, benchmark items go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.decontaminate import drop_contaminated
from recollect.llm.jaccard_join import drop_near_duplicates
from recollect.llm.line_dedup import drop_shared_lines
from recollect.llm.packing import pack_documents
from recollect.llm.quality_model import drop_low_quality
from recollect.session import scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the input's own documents."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three sites or more share, but for their first occurrence; documents of which nothing is left go. n_chars is that of the text that stays."""
    out = drop_shared_lines(docs)
    had = F.col("n_shared_lines") > 0
    emptied = had & (F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")) == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(had, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).drop("n_shared_lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.8 or more hold together, that of the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs, added_tokens=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: No SQL: a trained model and a tokenizer take part. The operators are tested against plain versions, packing by a round trip, and what the stages add to them by small cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
