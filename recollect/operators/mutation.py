"""Governed change as one act: instructions become plans, plans are applied to an overlay, and what they left is read back.

A batch of instructions is a table with a number per row (seq) that says their order. Nothing is changed in place: applying
returns the rows that the overlay, the tombstones and the log gain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.vector import norm, unit
from recollect.operators.corpus import global_offsets
from recollect.operators.geometry import Whitening, fit_whitening
from recollect.operators.intents import instruction


def planned(instructions: DataFrame, tombstones: DataFrame, base_max: int | None, anchor: int | None = None) -> DataFrame:
    """instructions: seq, text; tombstones: cell_id, reason. Per row the plan: op, cell_id, reason, text, blocked, block_reason and prior_reason.

    Adding is blocked where the base's greatest id isn't known or lies above the anchor of the overlay's ids. Removing what
    is removed already is no block; prior_reason says what is going to be overwritten.
    """
    d = instructions.select("seq", instruction(F.col("text")).alias("i")).select("seq", F.col("i.kind").alias("op"), "i.cell_id", "i.reason", "i.text", "i.note")
    adding, removing = F.col("op") == "add", F.col("op") == "remove"
    grown = base_max is not None and anchor is not None and base_max > anchor
    why = (
        F.when(F.col("op") == "unknown", F.col("note"))
        .when(adding & F.lit(base_max is None), "the base's greatest id is not known")
        .when(adding & F.lit(grown), f"the base has grown to {base_max}, above the anchor {anchor}")
        .when(removing & F.col("cell_id").isNull(), "no cell")
    )
    prior = tombstones.groupBy("cell_id").agg(F.max("reason").alias("prior_reason"))
    d = d.withColumn("block_reason", why).withColumn("blocked", F.col("block_reason").isNotNull()).drop("note")
    return d.join(prior, "cell_id", "left").select("seq", "op", "cell_id", "reason", "text", "blocked", "block_reason", F.when(removing, F.col("prior_reason")).alias("prior_reason"))


def applied(plans: DataFrame, top: int) -> dict[str, DataFrame]:
    """What the plans that are not blocked leave: cells (cell_id, source_text, seq), tombstones (cell_id, reason, seq) and log (op, cell_id, detail, seq).

    top: the greatest id in use (of base, anchor and overlay); new ids go on above it in the order of seq. Of several
    removals of one cell the last one's reason stays; the log keeps all.
    """
    go = plans.where("NOT blocked")
    adds = global_offsets(go.where("op = 'add'").select("seq", "text", F.lit(1).alias("one")), "seq", "one")
    cells = adds.select((F.lit(top + 1) + F.col("start")).cast("long").alias("cell_id"), F.col("text").alias("source_text"), "seq")
    removals = go.where("op = 'remove'").select("cell_id", "reason", "seq")
    stones = removals.groupBy("cell_id").agg(F.max_by("reason", "seq").alias("reason"), F.max("seq").alias("seq"))
    log = cells.select(F.lit("add").alias("op"), "cell_id", F.col("source_text").alias("detail"), "seq").unionByName(removals.select(F.lit("remove").alias("op"), "cell_id", F.col("reason").alias("detail"), "seq"))
    return {"cells": cells, "tombstones": stones, "log": log}


def read_back(plans: DataFrame, overlay: DataFrame, tombstones: DataFrame, log: DataFrame) -> DataFrame:
    """Per plan: applied, cell_id and the checks present, same and logged (null where a plan has none), and ok.

    An added cell must be there with its text; a removed one must have a tombstone with the last reason given; both must
    stand in the log. Inspecting asks only that the log can be read.
    """
    told = log.select("seq", "op", F.col("cell_id").alias("logged_id"), F.lit(True).alias("_logged"))
    d = plans.join(told, ["seq", "op"], "left").withColumn("cell_id", F.coalesce("cell_id", "logged_id"))
    there = overlay.select("cell_id", F.col("source_text").alias("_text"))
    stone = tombstones.select("cell_id", F.col("reason").alias("_reason"), F.col("seq").alias("_last"))
    d = d.join(there, "cell_id", "left").join(stone, "cell_id", "left")
    add, remove = F.col("op") == "add", F.col("op") == "remove"
    no = lambda c: F.coalesce(c, F.lit(False))
    overwritten = F.col("seq") < F.col("_last")
    present = F.when(add, F.col("_text").isNotNull()).when(remove, F.col("_reason").isNotNull())
    same = F.when(add, no(F.col("_text") == F.col("text"))).when(remove, no(overwritten | (F.col("_reason") == F.col("reason"))))
    logged = F.when(add | remove, no(F.col("_logged")))
    did = ~F.col("blocked")
    checks = [F.when(did, c).alias(n) for n, c in (("present", present), ("same", same), ("logged", logged))]
    ok = did & F.coalesce(present & same & logged, F.col("op") == "inspect")
    return d.select("seq", "op", did.alias("applied"), F.when(did & (add | remove), F.col("cell_id")).alias("cell_id"), *checks, ok.alias("ok"))


def written(rows: DataFrame, top: int, white: Whitening | None = None, theta: float = 0.30, strict: bool = False, least: float = 1e-6) -> DataFrame:
    """The cells that a batch of encoded texts makes: cell_id, label, source_text, weight, theta.

    rows: order (integer), label, text, vector. Vectors are whitened (with `white`) and brought to unit length; ids go on
    above `top` in the given order. A vector of next to no length is left out, or an error where `strict`.
    """
    d = rows if white is None else white.apply(rows, "vector", "vector")
    d = d.withColumn("_norm", norm(F.col("vector")))
    if strict and not d.where(F.col("_norm").isNull() | (F.col("_norm") < least)).isEmpty():
        raise ValueError("a text's vector has next to no length")
    kept = d.where(F.col("_norm") >= least).select("order", "label", F.col("text").alias("source_text"), unit(F.col("vector")).alias("weight"))
    numbered = global_offsets(kept.withColumn("_one", F.lit(1)), "order", "_one")
    return numbered.select((F.lit(top + 1) + F.col("start")).cast("long").alias("cell_id"), "label", "source_text", "weight", F.lit(theta).alias("theta"))


def started(bank: DataFrame, rows: DataFrame, least: int = 200, **options) -> tuple[Whitening, DataFrame]:
    """The whitening and the first cells of an empty bank, from a reference corpus of `least` texts or more."""
    if not bank.isEmpty():
        raise ValueError("the bank has cells already")
    if rows.limit(least).count() < least:
        raise ValueError(f"a reference corpus has {least} texts or more")
    white = fit_whitening(rows, "vector")
    return white, written(rows, -1, white, **options)


def bound_ids(rows: DataFrame, ids: list[str], group: str, key: str = "memory_id") -> DataFrame:
    """`rows` with group_id set for the ids given; at least two of them must be there."""
    if rows.where(F.col(key).isin(ids)).limit(2).count() < 2:
        raise ValueError("binding takes two memories or more")
    return rows.withColumn("group_id", F.when(F.col(key).isin(ids), F.lit(group)).otherwise(F.col("group_id")))


def next_number(rows: DataFrame, key: str = "memory_id") -> int:
    """One more than the greatest number after the last dash of the ids; 0 without one. Ids of another form don't count."""
    number = F.element_at(F.split(key, "-"), -1).try_cast("int")
    return rows.agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("n")).first()["n"]


def loaded(overlay: DataFrame, cells: DataFrame, top: int, dim: int) -> DataFrame:
    """The overlay with a table of ready cells (order, label, weight, source_text): ids go on above `top`. A weight of another dimension is an error."""
    if cells.where(F.col("weight").isNull() | (F.size("weight") != dim)).limit(1).count():
        raise ValueError(f"cells have weights of a dimension other than {dim}")
    new = global_offsets(cells.withColumn("_one", F.lit(1)), "order", "_one").withColumn("cell_id", (F.lit(top + 1) + F.col("start")).cast("long"))
    return overlay.unionByName(new.select(*overlay.columns))
