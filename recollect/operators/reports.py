"""Reports over verdicts and outcomes: audits, confusion by system, regressions, failure classes and sweeps.

Each takes rows that other operators have made and is one aggregation or one ordered choice per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.evaluation import wilson
from recollect.operators.intents import WRITE_WORDS, decision

RERANK_TOP = 3


def nli_agreement(verdict: Column, label: Column) -> Column:
    """How a verdict (accept, reject, ambiguous) and the label of an entailment model (entailment, contradiction, neutral; blank: none) go together."""
    pairs = {"accept": "entailment", "reject": "contradiction", "ambiguous": "neutral"}
    agree = F.lit(False)
    for v, l in pairs.items():
        agree = agree | ((verdict == v) & (label == l))
    return (
        F.when(F.coalesce(label, F.lit("")) == "", "not_provided")
        .when(agree, "agreement")
        .when((verdict == "accept") & (label == "contradiction"), "inspect_urgently")
        .when((verdict == "reject") & (label == "entailment"), "possible_over_refusal")
        .otherwise("review")
    )


def observed(rows: DataFrame, verdict: str = "verdict", expected: str = "expected", label: str = "nli_label") -> DataFrame:
    """`rows` with answered, false_accept, over_refusal, safe and nli_agreement. expected: accept or reject."""
    answered, want = F.col(verdict) == "accept", F.col(expected)
    d = rows.withColumns({"answered": answered, "false_accept": answered & (want == "reject"), "over_refusal": ~answered & (want == "accept"), "nli_agreement": nli_agreement(F.col(verdict), F.col(label))})
    return d.withColumn("safe", ~F.col("false_accept"))


def audit_metrics(observations: DataFrame, expected: str = "expected") -> DataFrame:
    """metric, positive, n, rate and the Wilson interval, of coverage, false accepts, over-refusals and accuracy where an answer was given. Without cases a rate is null."""
    want, said = F.col(expected), F.col("answered")
    counts = {
        "coverage": (said, F.lit(True)),
        "false_accept_rate": (F.col("false_accept"), want == "reject"),
        "over_refusal_rate": (F.col("over_refusal"), want == "accept"),
        "accuracy_among_answered": (said & (want == "accept"), said),
    }
    sums = observations.agg(*[c for name, (hit, among) in counts.items() for c in (F.count_if(hit & among).alias(f"{name}_p"), F.count_if(among).alias(f"{name}_n"))])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_p").alias("positive"), F.col(f"{name}_n").alias("n")) for name in counts])).alias("m")).select("m.*")
    low, high = wilson(F.col("positive"), F.col("n"))
    rate = F.when(F.col("n") > 0, F.col("positive") / F.col("n"))
    return rows.select("metric", "positive", "n", F.round(rate, 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def verdict_rates(rows: DataFrame, by: str, verdict: str = "verdict") -> DataFrame:
    """Per class and for all together (class: all): n and the shares of reject, accept and ambiguous."""
    g = rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col(verdict) == v).cast("int")), 6).alias(f"{v}_rate") for v in ("reject", "accept", "ambiguous")], F.grouping(by).alias("_all"))
    return g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(by)).alias(by), "n", "reject_rate", "accept_rate", "ambiguous_rate")


def confusion(rows: DataFrame) -> DataFrame:
    """rows: system, kind (exact, paraphrase, near_miss, unrelated), primary (the first candidate's verdict), accepted (how many), recalled (the target is a candidate), faithful. Per system nine rates; null where a kind doesn't occur."""
    kind, said = F.col("kind"), F.col("accepted") > 0
    positive, negative = kind.isin("exact", "paraphrase"), kind.isin("near_miss", "unrelated")
    share = lambda hit, among, name: F.round(F.avg(F.when(among, hit.cast("int"))), 6).alias(name)
    every = F.lit(True)
    return rows.groupBy("system").agg(
        share(F.col("recalled"), positive, "candidate_recall"),
        share(said, every, "accept_rate"),
        share(said, kind == "paraphrase", "paraphrase_accept_rate"),
        share(F.col("primary") == "reject", kind == "near_miss", "near_miss_reject_rate"),
        share(F.col("primary") == "reject", kind == "unrelated", "unrelated_reject_rate"),
        share(F.col("primary") == "ambiguous", every, "ambiguous_rate"),
        share(said, negative, "false_accept_rate"),
        share(F.col("primary") == "reject", kind == "exact", "false_reject_rate"),
        share(said & ~F.col("faithful"), every, "unsupported_rate"),
    )


def regression(off: DataFrame, on: DataFrame, key: list[str], outcome: str = "outcome") -> DataFrame:
    """before, after and n: how many rows went from which outcome to which when something was switched on."""
    j = off.select(*key, F.col(outcome).alias("before")).join(on.select(*key, F.col(outcome).alias("after")), key)
    return j.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def keyword_rank(texts: Column, keywords: Column) -> Column:
    """The place (from 1) of the first text that holds one of the keywords, in any case; null without one."""
    low = F.transform(keywords, F.lower)
    holds = F.transform(texts, lambda t: F.exists(low, lambda k: F.contains(F.lower(F.coalesce(t, F.lit(""))), k)))
    return F.nullif(F.array_position(holds, True), F.lit(0)).cast("int")


def rerank_status(before: Column, after: Column, top: int = RERANK_TOP) -> Column:
    """What a second ranking did for the right cell, by its rank before and after: lifted it among the first, left it there, or not."""
    was, now = before <= top, F.coalesce(after <= top, F.lit(False))
    return F.when(before.isNull(), "cant_help").when(was & now, "indifferent").when(~was & now, "helps").otherwise("neutral")


def mode_verdict(answer: Column, silent: Column, keywords: Column) -> Column:
    """silence, grounded (the answer holds a keyword in any case) or wrong."""
    hit = F.exists(keywords, lambda k: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(k)))
    return F.when(silent, "silence").when(hit, "grounded").otherwise("wrong")


def effective_decision(margin: Column, outcome: Column, eligible: Column, threshold: float) -> Column:
    """What comes of a question at a gate: its own outcome above it; below it rescued, silence_drift or silence_gate. eligible: a first cell supports the answer."""
    return F.when(margin >= threshold, outcome).when(eligible & (outcome == "grounded"), "rescued").when(eligible, "silence_drift").otherwise("silence_gate")


def decision_label(silent: Column, reason: Column, rescue: Column) -> Column:
    """grounded_normal, grounded_via_rescue, silence_drift, silence_rescue_reject or silence_gate. rescue: null where none was tried."""
    tried = rescue.isNotNull()
    return (
        F.when(~silent & tried, "grounded_via_rescue").when(~silent, "grounded_normal").when(F.startswith(F.coalesce(reason, F.lit("")), F.lit("verify")), "silence_drift").when(tried, "silence_rescue_reject").otherwise("silence_gate")
    )


def failure(ok: Column, question: Column, asked: Column, pool_rank: Column, top_rank: Column, k: int, fires: Column, hit: Column, grounded: Column) -> Column:
    """The stage at which a question failed. question, asked: as put and as rewritten; pool_rank, top_rank: of the right cell among many and among k."""
    among = F.coalesce(top_rank <= k, F.lit(False))
    return (
        F.when(ok, "OK")
        .when(F.lower(F.trim(question)) == F.lower(F.trim(asked)), "DECOMPOSER")
        .when(pool_rank.isNull(), "RETRIEVAL")
        .when(among & ~fires, "GATE")
        .when(~among, "RETRIEVAL")
        .when(~hit, "GENERATOR")
        .when(grounded == F.lit(False), "VERIFIER")
        .otherwise("UNCLASSIFIED")
    )


def agreement(measured: Column, claimed: Column, tolerance: float) -> Column:
    return F.when(F.abs(measured - claimed) <= tolerance, "match").otherwise("drift")


def grid(rows: DataFrame, windows: list[int], floors: list[float]) -> DataFrame:
    """rows: cells (structs with act and supports, by rank). window, floor, n and eligible: how many rows have a supporting cell within the window that reaches the floor."""
    choices = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(f).alias("floor")) for w in windows for f in floors])
    d = rows.select("cells", F.explode(choices).alias("g")).select("cells", "g.*")
    found = F.exists(F.slice("cells", 1, F.col("window")), lambda c: c["supports"] & (c["act"] >= F.col("floor")))
    return d.groupBy("window", "floor").agg(F.count(F.lit(1)).alias("n"), F.count_if(found).alias("eligible"))


def gate_signals(ranked: DataFrame, thresholds: list[float]) -> DataFrame:
    """ranked: query_id, rank, act. signal, threshold and fires: how many queries each of five gates would let through: the best activation, its lead over the second, over the mean of the others, its deviations above them, and its share of the sum."""
    others = F.when(F.col("rank") > 1, F.col("act"))
    of = lambda r: F.max(F.when(F.col("rank") == r, F.col("act")))
    per = ranked.groupBy("query_id").agg(of(1).alias("a"), of(2).alias("b"), F.avg(others).alias("m"), F.stddev_pop(others).alias("sd"), F.sum("act").alias("s"))
    signals = {"top1": F.col("a"), "margin": F.col("a") - F.col("b"), "margin_rest": F.col("a") - F.col("m"), "deviations": (F.col("a") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), "share": F.col("a") / F.nullif(F.col("s"), F.lit(0.0))}
    rows = per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), v.alias("v")) for n, v in signals.items()])).alias("x"), F.array(*map(F.lit, thresholds)).alias("ts")).select("x.*", F.explode("ts").alias("threshold"))
    return rows.groupBy("signal", "threshold").agg(F.count_if(F.col("v") >= F.col("threshold")).alias("fires"))


def multihop_counts(rows: DataFrame) -> DataFrame:
    """rows: decision (a label of decision_label), kw_hit. One row: n, grounded and rescued, each with the keyword in the answer and without (confidently wrong)."""
    rescued = F.col("decision") == "grounded_via_rescue"
    grounded, hit = rescued | (F.col("decision") == "grounded_normal"), F.col("kw_hit")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(grounded).alias("grounded"),
        F.count_if(grounded & hit).alias("grounded_kw_hit"),
        F.count_if(grounded & ~hit).alias("grounded_kw_miss"),
        F.count_if(rescued & hit).alias("rescued_kw_hit"),
        F.count_if(rescued & ~hit).alias("rescued_kw_miss"),
    )


def multihop_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """rows: margin, outcome (with the gate open) and kw_hit. Per gate threshold: n, grounded, grounded_kw_hit, grounded_kw_miss (confidently wrong), silence_gate and silence_drift. A question below the threshold is silent at the gate, whatever its draft."""
    at = F.explode(F.array(*map(F.lit, thresholds)))
    seen = rows.select("margin", "outcome", "kw_hit", at.alias("threshold")).withColumn("now", F.when(F.coalesce(F.col("margin") >= F.col("threshold"), F.lit(False)), F.col("outcome")).otherwise("silence_gate"))
    is_ = lambda o: F.col("now") == o
    return seen.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_("grounded")).alias("grounded"), F.count_if(is_("grounded") & F.col("kw_hit")).alias("grounded_kw_hit"), F.count_if(is_("grounded") & ~F.col("kw_hit")).alias("grounded_kw_miss"), F.count_if(is_("silence_gate")).alias("silence_gate"), F.count_if(is_("silence_drift")).alias("silence_drift"))


def chunk_tallies(chunks: DataFrame, cutoff: float) -> DataFrame:
    """chunks: low_share, skipped, top1. Per kind of chunk (low: low_share from the cutoff on): total, retrieved, and the three most frequent first cells among the retrieved (by count, then name)."""
    low = F.when(F.col("low_share") >= cutoff, "low").otherwise("high")
    got = ~F.col("skipped") & F.col("top1").isNotNull()
    d = chunks.select(low.alias("kind"), got.alias("got"), "top1")
    sums = d.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("got").alias("retrieved"))
    w = Window.partitionBy("kind").orderBy(F.col("c").desc(), "top1")
    first = d.where("got").groupBy("kind", "top1").agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.row_number().over(w)).where("r <= 3")
    tops = first.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "top1", F.col("c").cast("string")).alias("t")))).alias("s"))
    return sums.join(tops, "kind", "left").select("kind", "total", "retrieved", F.coalesce(F.array_join(F.transform("s", lambda x: x["t"]), ","), F.lit("")).alias("top3"))


def probed_cells(found: DataFrame, least: float = 0.25, most: int = 50) -> DataFrame:
    """found: probe (the order in which several probes ask), cell_id, act. The cells that reach `least`, each with its activation for the first probe that finds it, the best `most` of them."""
    first = found.where(F.col("act") >= least).groupBy("cell_id").agg(F.min_by("act", "probe").alias("act"))
    return first.orderBy(F.round("act", 9).desc(), "cell_id").limit(most)


def ratios_by_position(rows: DataFrame) -> DataFrame:
    """rows: position, ratio. Per position n, mean and deviation (n - 1) of the ratios that are numbers."""
    r = F.when(~F.isnan("ratio"), F.col("ratio"))
    return rows.groupBy("position").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("deviation"))


def position_bias(means: Column, benefit: Column, end_least: float = 0.5, middle_most: float = 0.3, gap: float = 0.2, benefit_least: float = 0.1) -> Column:
    """The verdict on means of six positions: whether what stands at the ends is used better than what stands in the middle. benefit: of a single fact over none."""
    at = lambda i: F.get(means, F.lit(i))
    strict = (at(0) >= end_least) & (at(5) >= end_least) & (at(2) < middle_most) & (at(3) < middle_most)
    wide = (at(0) + at(5)) / 2 - (at(2) + at(3)) / 2 > gap
    return F.when(benefit < benefit_least, "INCONCLUSIVE").when(strict, "POSITION_BIAS_CONFIRMED").when(wide, "PARTIAL_POSITION_BIAS").otherwise("NO_POSITION_BIAS")


def confusion_verdict(cohens_d: Column, above: Column) -> Column:
    """What a bank confuses: things of like meaning, both, or anything. above: the share of confused pairs over the random pairs' 95th percentile."""
    return F.when((cohens_d > 0.8) & (above > 0.5), "SEMANTIC").when((cohens_d > 0.3) & (above > 0.25), "MIXED").otherwise("NOISE")


def routing_report(rows: DataFrame, by: str) -> DataFrame:
    """rows: expected, routed (intents), recalls (whether memory should answer), used, cited_right. Per configuration: routing accuracy, recall, correct refusals, unsupported answers and right attributions; null without cases."""
    asks = F.col("expected") == "query"
    rate = lambda hit, among, name: F.round(F.avg(F.when(among, hit.cast("int"))), 6).alias(name)
    recalls, used = asks & F.col("recalls"), F.col("used")
    quiet = asks & ~F.col("recalls")
    return rows.groupBy(by).agg(
        rate(F.col("routed") == F.col("expected"), F.lit(True), "routing_accuracy"),
        rate(used, recalls, "recall"),
        rate(~used, quiet, "refusal_accuracy"),
        F.count_if(quiet & used).alias("unsupported"),
        rate(F.col("cited_right"), recalls & used, "attribution"),
    )


def controller_report(rows: DataFrame, by: str) -> DataFrame:
    """rows: expected, routed (intents), answer, retry (a controller's JSON and, where that was malformed, the second one), to_write, proposed and known (arrays of ids).

    Per configuration: turns, json_validity (of first answers), recovered (malformed ones mended by the retry), malformed_rate (malformed for
    good), routing_accuracy (a turn malformed for good is routed wrong), write_quality (what a write turn keeps is there and doesn't begin with the verb)
    and bind_precision (the mean share of known ids among those proposed). Null without cases.
    """
    first, second = decision(F.col("answer")).isNotNull(), decision(F.col("retry")).isNotNull()
    write = F.col("routed") == "write"
    said = F.btrim(F.coalesce("to_write", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    kept = (said != "") & ~said.rlike("(?i)^(" + "|".join(WRITE_WORDS) + ")")
    hits = F.size(F.filter("proposed", lambda i: F.array_contains("known", i)))
    share = F.when((F.col("routed") == "bind") & (F.size("proposed") > 0), hits / F.size("proposed"))
    rate = lambda hit, name: F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("int")), 6).alias(name)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("turns"),
        rate(first, "json_validity"),
        F.count_if(~first & second).alias("recovered"),
        rate(~first & ~second, "malformed_rate"),
        rate((first | second) & (F.col("routed") == F.col("expected")), "routing_accuracy"),
        F.round(F.avg(F.when(write & (first | second), kept.cast("int"))), 6).alias("write_quality"),
        F.round(F.avg(share), 6).alias("bind_precision"),
    )


def extreme_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """pairs: query_id, cell_id, act. The n pairs of the greatest activation (end: top) and the n of the least (bottom), to 9 decimals, then by ids: end, place, query_id, cell_id, act. Each end is one ordered cut, for which a task keeps n rows."""
    act = F.round("act", 9)
    ends = {"top": act.desc(), "bottom": act.asc()}
    made = [pairs.orderBy(o, "query_id", "cell_id").limit(n).withColumn("end", F.lit(e)).withColumn("place", F.row_number().over(Window.partitionBy("end").orderBy(o, "query_id", "cell_id"))) for e, o in ends.items()]
    return made[0].unionByName(made[1]).select("end", "place", "query_id", "cell_id", "act")


def judge_counts(rows: DataFrame) -> DataFrame:
    """rows: deterministic (a verdict), raw (the judge's answer). One row: calls, how many a deterministic rejection decided, how many answers were valid and how many malformed."""
    short = F.col("deterministic") == "reject"
    valid = F.coalesce(F.lower(F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "verdict string")["verdict"]).isin("accept", "reject", "ambiguous"), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.count_if(short).alias("short_circuits"), F.count_if(~short & valid).alias("valid"), F.count_if(~short & ~valid).alias("malformed"))


def masked_losses(rows: DataFrame, mask: str = "mask", loss: str = "loss") -> DataFrame:
    """Per mask of switched-off layers: n, the mean loss and its standard error (n - 1)."""
    return rows.groupBy(mask).agg(F.count(loss).alias("n"), F.round(F.avg(loss), 6).alias("mean_loss"), F.round(F.stddev_samp(loss) / F.sqrt(F.count(loss)), 6).alias("stderr"))


def training_plan(params: int, iters: int, batch: int, block: int, unique_target: int, candidate_tokens: int, per_param: int = 20) -> dict:
    """Token counts of a training run: the compute-optimal number, those presented, how often each unique one is, and what to mind."""
    optimal, presented = params * per_param, iters * batch * block
    notes = {
        "target below the optimum": unique_target < optimal,
        "less than one epoch": presented < unique_target,
        "candidates below the target": candidate_tokens < unique_target,
        "more than three epochs": presented > 3 * unique_target,
    }
    ratios = {"epochs": presented / unique_target, "target_to_candidates": unique_target / candidate_tokens, "presented_to_optimal": presented / optimal}
    return {"optimal": optimal, "presented": presented, **ratios, "notes": [n for n, said in notes.items() if said]}
