"""The answer pipeline as one plan: retrieval, gate, prefilter, verification of a draft, rescue, and the outcome of each question.

What a text generator would draft comes in as a column; everything that decides whether the draft may be given is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.answercheck import MIN_COVERAGE, RESCUE_FLOOR, RESCUE_WINDOW, cell_forms, rescue, verified
from recollect.operators.gates import GATE, gate

TOPICS, SNIPPET = 3, 80


def topic(label: Column, text: Column) -> Column:
    """What a cell is about: its label, else the beginning of its text, else null."""
    said = F.trim(label)
    spaced = F.trim(F.regexp_replace(text, r"\s+", " "))
    short = F.concat(F.substring(spaced, 1, SNIPPET), F.when(F.length(text) > SNIPPET, "…").otherwise(""))
    return F.when(F.coalesce(said, F.lit("")) != "", said).when(F.coalesce(text, F.lit("")) != "", short)


def answered(questions: DataFrame, found: DataFrame, sources: DataFrame, threshold: float = GATE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per question: outcome, reason, fires, gate_margin, grounded, covered, total, rescue, citations, topics and silent.

    questions: query_id, question, draft; found: query_id, rank, cell_id, act (the best k cells); sources: cell_id, text, label.
    outcome: grounded (the draft may be given), silence_drift (the gate was passed, but the draft is not borne out) or
    silence_gate. Below the gate a draft is looked at only where one of the first cells reaches the rescue's floor, and given
    only where it is borne out and a first cell supports it directly. Cells without a text are shown to nobody.
    """
    gates = gate(found.select("query_id", "act"), threshold)
    held = found.join(sources, "cell_id", "left").select("query_id", F.struct("rank", "cell_id", "act", "text", "label").alias("c"))
    shown = held.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("all"))
    shown = shown.select("query_id", F.filter("all", lambda c: F.coalesce(c["text"], F.lit("")) != "").alias("cells"), "all")
    tops = F.filter(F.transform(F.slice("all", 1, TOPICS), lambda c: F.struct(topic(c["label"], c["text"]).alias("topic"), c["act"].alias("act"))), lambda t: t["topic"].isNotNull())
    shown = shown.select("query_id", "cells", tops.alias("topics"), F.exists(F.slice("all", 1, RESCUE_WINDOW), lambda c: c["act"] >= RESCUE_FLOOR).alias("plausible"), cell_forms(F.col("cells")).alias("forms"))
    none = F.array().cast("array<long>")
    d = questions.join(gates, "query_id", "left").join(shown, "query_id", "left").withColumnRenamed("draft", "answer").withColumnRenamed("reason", "gate_reason")
    d = d.withColumns({"fires": F.coalesce("fires", F.lit(False)), "gate_reason": F.coalesce("gate_reason", F.lit("no results")), "plausible": F.coalesce("plausible", F.lit(False))})
    empty = F.coalesce(F.size("cells"), F.lit(0)) < 1
    d = d.withColumn("looked_at", (F.col("fires") | F.col("plausible")) & ~empty)
    d = d.withColumns({"cells": F.coalesce("cells", F.array().cast(d.schema["cells"].dataType)), "forms": F.coalesce("forms", F.array().cast("array<string>"))})
    d = verified(d, min_coverage)
    d = rescue(d.withColumnRenamed("reason", "verify_reason")).withColumnRenamed("outcome", "rescue")
    given = F.col("looked_at") & F.col("grounded") & (F.col("fires") | (F.col("rescue") == "rescue"))
    outcome = F.when(given, "grounded").when(F.col("fires") & F.col("looked_at"), "silence_drift").otherwise("silence_gate")
    stopped = F.concat(F.lit("gate: "), F.col("gate_reason"))
    reason = (
        F.when(given, "")
        .when(~F.col("fires") & ~F.col("plausible"), stopped)
        .when(empty, F.when(F.col("fires"), "gate passed, no source text").otherwise(F.concat(stopped, F.lit("; no source text"))))
        .when(F.col("fires"), F.concat(F.lit("verify: "), "verify_reason"))
        .when(~F.col("grounded"), F.concat(stopped, F.lit("; verify: "), "verify_reason"))
        .otherwise(F.concat(stopped, F.lit("; rescue: "), "rescue"))
    )
    at = lambda c: F.when(F.col("looked_at"), F.col(c)).alias(c)
    cited = F.when(F.col("looked_at"), F.transform("cells", lambda c: c["cell_id"])).otherwise(none)
    saved = F.when(F.col("looked_at") & F.col("grounded") & ~F.col("fires"), F.col("rescue"))
    return d.select("query_id", outcome.alias("outcome"), reason.alias("reason"), "fires", "gate_margin", at("grounded"), at("covered"), at("total"), saved.alias("rescue"), cited.alias("citations"), F.coalesce("topics", F.array().cast(d.schema["topics"].dataType)).alias("topics"), (outcome != "grounded").alias("silent"))


def two_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Answers of a second, wider pass where the first stayed silent and the second did not; from_second says which one counts."""
    s = second.select("query_id", *[F.col(c).alias(f"_{c}") for c in second.columns if c != "query_id"])
    use = F.coalesce(F.col("silent") & ~F.col("_silent"), F.lit(False))
    d = first.join(s, "query_id", "left").withColumn("from_second", use)
    return d.select("query_id", *[F.when(F.col("from_second"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c != "query_id"], "from_second")


def accuracy_by_class(outcomes: DataFrame, by: str, expected: str) -> DataFrame:
    """Per class: n, correct (an outcome of grounded where that is expected, of silence elsewhere), accuracy and how often each outcome came."""
    right = F.col("outcome") == "grounded"
    ok = F.when(F.col(expected) == "grounded", right).otherwise(~right)
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("grounded", "silence_gate", "silence_drift")]
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy"), *counts)
