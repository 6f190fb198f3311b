"""Governed change of a bank: base, overlay, tombstones and a provenance log, all of them tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import collapsed
from recollect.operators.corpus import global_offsets


def add_cells(overlay: DataFrame, texts: DataFrame, anchor: int, base_max: int, theta: float = 0.30) -> DataFrame:
    """The overlay with new rows (label, weight, source_text, order): ids go on above the anchor and the overlay's own, in the order of the integer column. A base that has grown past the anchor is an error."""
    if base_max > anchor:
        raise ValueError(f"the base holds ids up to {base_max}, above the overlay's anchor {anchor}")
    last = overlay.agg(F.coalesce(F.max("cell_id"), F.lit(anchor))).first()[0]
    numbered = global_offsets(texts.withColumn("_one", F.lit(1)), "order", "_one")
    new = numbered.withColumn("cell_id", (F.lit(max(last, anchor) + 1) + F.col("start")).cast("long")).withColumn("theta", F.lit(theta))
    return overlay.unionByName(new.select(*overlay.columns), allowMissingColumns=False)


def current_tombstones(log: DataFrame) -> DataFrame:
    """log: cell_id, reason, ts. Per cell its latest reason; a blank reason doesn't count."""
    return log.where(F.trim("reason") != "").groupBy("cell_id").agg(F.max_by("reason", "ts").alias("reason"), F.max("ts").alias("removed_at"))


def provenance(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Both kinds of change in one log, oldest first: op, cell_id, detail, ts."""
    a = adds.select(F.lit("add").alias("op"), "cell_id", F.col("source_text").alias("detail"), "ts")
    r = removes.select(F.lit("remove").alias("op"), "cell_id", F.col("reason").alias("detail"), "ts")
    return a.unionByName(r).orderBy("ts", "op", "cell_id")


def new_texts_only(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates: draft_id, text; existing: text. Candidates whose normal text is neither there already nor earlier among them."""
    key = F.lower(collapsed(F.col("text")))
    seen = existing.select(key.alias("k")).distinct()
    fresh = candidates.withColumn("k", key).where("k <> ''").join(seen, "k", "left_anti")
    first = fresh.groupBy("k").agg(F.min("draft_id").alias("draft_id"))
    return fresh.join(first, ["k", "draft_id"], "left_semi").drop("k")


def validate_added(overlay: DataFrame, log: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: cell_id, text. Per row whether the cell is there, holds the text and stands in the log."""
    got = overlay.select("cell_id", "source_text", F.lit(True).alias("there"))
    logged = log.where("op = 'add'").select("cell_id", F.lit(True).alias("logged")).distinct()
    j = expected.join(got, "cell_id", "left").join(logged, "cell_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    checks = j.select("cell_id", no(F.col("there")).alias("there"), no(F.col("source_text") == F.col("text")).alias("same_text"), no(F.col("logged")).alias("logged"))
    return checks.withColumn("ok", F.col("there") & F.col("same_text") & F.col("logged"))


def refused_deletes(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """wanted: cell_id; edges: bound_cell_id, source_cell_id. Cells that can't go because a bound cell rests on them."""
    return wanted.join(edges.select(F.col("source_cell_id").alias("cell_id")).distinct(), "cell_id", "left_semi")


def mismatches(current: dict[str, Column], expected: dict[str, Column]) -> Column:
    """The names of fields that differ between two calibrations."""
    return F.array_compact(F.array(*[F.when(~current[k].eqNullSafe(expected[k]), F.lit(k)) for k in sorted(expected)]))


def calibration_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 over the fields as name=value lines in the order of their names."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in sorted(fields.items())]), 256)


def ordered_hash(rows: DataFrame, id_col: str, size: Column, width: int = 4096) -> DataFrame:
    """One row, corpus_hash: SHA-256 over the hashes of ranges of `width` ids, of `width` such ranges, and so on; each over its rows' (id, size) in order. No task sees more than `width` rows of a range, however many there are."""
    level = rows.select(F.col(id_col).alias("i"), F.concat_ws(":", F.col(id_col).cast("string"), size.cast("string")).alias("h"))
    low, high = rows.agg(F.min(id_col), F.max(id_col)).first()
    while True:
        per = level.groupBy(F.floor(F.col("i") / width).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("s"))
        level = per.select(F.col("b").alias("i"), F.sha2(F.array_join(F.transform("s", lambda x: x["h"]), ","), 256).alias("h"))
        if low is None or low // width == high // width:
            return level.select(F.col("h").alias("corpus_hash"))
        low, high = low // width, high // width
