"""Verification of an answer against the cells that it cites: coverage, numbers, coherence, overlap, anchors, claims, rescue.

Each check is a column over (question, answer, cells); cells is an array of structs (cell_id, text) in the order of
presentation. Nothing is shuffled: a row holds all that its verdict needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import anchor_form, bound, content_tokens, name_runs, numeric_strings, tokens

MIN_COVERAGE = 0.5
RESCUE_WINDOW, RESCUE_FLOOR = 3, 0.40
# Where sentences and clauses end, what marks a citation, and phrases of a refusal.
SENTENCE_END = r"(?<=[.!?;])\s+"
CLAUSE_END = r"\s+--\s+|\s+—\s+|,\s+(?:and|but|while|whereas|however|though|although)\s+"
CITATION = r"\[\s*\d+\s*\]"
REFUSALS = ["i drafted an answer but could not ground it", "no matching memory"]
CLAIM_EDGES, MIN_CLAIM = " \t\r\n.,;:!?-—", 8


def cell_blob(cells: Column) -> Column:
    return F.lower(F.array_join(F.transform(cells, lambda c: F.coalesce(c["text"], F.lit(""))), " "))


def without_citations(answer: Column, cells: Column) -> Column:
    """The answer without [n] marks and without bare ids of the cells."""
    marks = F.regexp_replace(answer, r"\[[0-9]+\]", " ")
    ids = F.array_distinct(F.transform(cells, lambda c: c["cell_id"].cast("string")))
    longest = F.array_join(F.transform(F.array_sort(F.transform(ids, lambda i: F.struct((-F.length(i)).alias("n"), i.alias("i")))), lambda x: x["i"]), "|")
    return F.when(F.size(cells) > 0, F.regexp_replace(marks, F.concat(F.lit(r"\b(?:"), longest, F.lit(r")\b")), F.lit(" "))).otherwise(marks)


def coherent(question: Column) -> Column:
    """A question with a word-like token (three letters, one a vowel) and, from three tokens on, none that makes up over half."""

    def checked(t: Column) -> Column:
        wordlike = F.exists(t, lambda x: x.rlike("^[a-z]{3,}$") & x.rlike("[aeiouy]"))
        top = F.array_max(F.transform(F.array_distinct(t), lambda x: F.size(F.filter(t, lambda y: y == x))))
        return (F.size(t) > 0) & wordlike & ((F.size(t) < 3) | (top * 2 <= F.size(t)))

    return bound(tokens(question), checked)


def overlapping(question: Column, blob: Column) -> Column:
    """Whether the cells hold a content token of the question as a substring; questions with fewer than two pass."""
    return bound(F.array_distinct(content_tokens(question)), lambda q: (F.size(q) < 2) | F.exists(q, lambda t: F.contains(blob, t)))


def coverage(answer: Column, question: Column, blob: Column) -> tuple[Column, Column]:
    """(tokens of the answer that the cells hold, all its tokens), without those of the question, with repetitions."""
    t = content_tokens(answer, F.coalesce(content_tokens(question), F.array().cast("array<string>")))
    held = bound(F.array_distinct(tokens(blob)), lambda there: F.size(F.filter(t, lambda x: F.array_contains(there, x))))
    return held, F.size(t)


def uncited_numbers(answer: Column, question: Column, blob: Column) -> Column:
    """Numbers and months of the answer that are neither in the question nor, as substrings, in the cells."""
    return bound(numeric_strings(question), lambda known: F.filter(numeric_strings(answer), lambda n: ~F.array_contains(known, n) & ~F.contains(blob, F.lower(n))))


def anchors(question: Column) -> Column:
    """What answers must stand beside: names of several words, else single names, else content tokens of three letters or more."""
    words = F.array_distinct(F.filter(content_tokens(question), lambda t: F.length(t) >= 3))

    def tiers(norms: Column) -> Column:
        many, one = F.filter(norms, lambda n: F.contains(n, F.lit(" "))), F.filter(norms, lambda n: ~F.contains(n, F.lit(" ")))
        return F.when(F.size(many) > 0, many).when(F.size(one) > 0, one).otherwise(words)

    return bound(F.transform(name_runs(question), lambda r: r["norm"]), tiers)


def novel_entities(answer: Column, question: Column) -> Column:
    """Names in the answer that the question doesn't hold: structs (span, norm)."""
    return bound(anchor_form(F.coalesce(question, F.lit(""))), lambda q: F.filter(name_runs(answer), lambda r: (r["norm"] != "") & ~F.contains(q, r["norm"])))


def cell_forms(cells: Column) -> Column:
    """The anchor forms of the cells' texts, in their order."""
    return F.transform(cells, lambda c: anchor_form(F.coalesce(c["text"], F.lit(""))))


def unanchored(answer: Column, question: Column, forms: Column) -> Column:
    """Novel names for which no cell (forms: of its text) holds both the name and an anchor of the question; none if the question has no anchor."""
    none = F.array().cast("array<string>")

    def apart(marks: Column, there: Column) -> Column:
        beside = lambda r: F.exists(there, lambda f: F.contains(f, r["norm"]) & F.exists(marks, lambda a: F.contains(f, a)))
        names = F.transform(F.filter(novel_entities(answer, question), lambda r: ~beside(r)), lambda r: r["span"])
        return F.when(F.size(marks) > 0, names).otherwise(none)

    return bound(anchors(question), lambda marks: bound(forms, lambda there: apart(marks, there)))


def verified(rows: DataFrame, min_coverage: float = MIN_COVERAGE, strict: bool = True) -> DataFrame:
    """rows: question, answer, cells and others; forms (cell_forms of the cells) may be there already, computed once for all answers to the same cells. Adds covered, total, uncited, unanchored, grounded and reason; the first failing check names the reason."""
    q, a = F.coalesce(F.col("question"), F.lit("")), F.col("_v_answer")
    d = rows.withColumn("_v_answer", without_citations(F.coalesce(F.col("answer"), F.lit("")), F.col("cells"))).withColumn("_v_blob", cell_blob(F.col("cells")))
    covered, total = coverage(a, q, F.col("_v_blob"))
    d = d.withColumns({"covered": covered, "total": total, "uncited": uncited_numbers(a, q, F.col("_v_blob")), "unanchored": unanchored(a, q, F.col("forms") if "forms" in rows.columns else cell_forms(F.col("cells"))) if strict else F.array().cast("array<string>")})
    share = F.col("covered") / F.nullif(F.col("total"), F.lit(0))
    enough = F.coalesce(share >= min_coverage, F.lit(True))
    cited, placed = F.size("uncited") == 0, F.size("unanchored") == 0
    reason = F.when(F.lit(strict) & ~coherent(q), "incoherent question").when(F.lit(strict) & ~overlapping(q, F.col("_v_blob")), "no overlap of question and cells")
    reason = reason.when((F.col("total") == 0) & cited, "nothing to verify").when((F.col("total") == 0), "uncited number")
    reason = reason.when(enough & cited & placed, "covered").when(~enough & ~cited, "low coverage and uncited number").when(~enough, "low coverage").when(~cited, "uncited number").otherwise("unanchored name")
    d = d.withColumn("reason", reason).withColumn("grounded", F.col("reason").isin("covered", "nothing to verify"))
    return d.drop("_v_answer", "_v_blob")


def rescue(rows: DataFrame, window: int = RESCUE_WINDOW, floor: float = RESCUE_FLOOR) -> DataFrame:
    """rows of grounded answers with question, answer, cells (cell_id, text, act, by rank). Adds outcome: rescue or why not.

    The first novel name counts; the first cell that holds it and an anchor must stand within the window and reach the floor.
    """
    q, a = F.coalesce(F.col("question"), F.lit("")), F.coalesce(F.col("answer"), F.lit(""))
    forms = F.col("forms") if "forms" in rows.columns else cell_forms(F.col("cells"))
    primary = F.when(F.size(F.col("_marks")) > 0, F.get(novel_entities(a, q), F.lit(0))["span"])

    def place(form: Column) -> Column:
        supports = F.transform(forms, lambda f: F.contains(f, form) & F.exists(F.col("_marks"), lambda m: F.contains(f, m)))
        return F.when(form != "", F.array_position(supports, True) - 1)

    d = rows.withColumn("_marks", F.transform(anchors(q), anchor_form)).withColumn("_primary", primary)
    d = d.withColumn("support_rank", bound(anchor_form(F.col("_primary")), place).cast("int"))
    found = F.col("support_rank") >= 0
    outcome = (
        F.when(F.col("_primary").isNull() | (anchor_form(F.col("_primary")) == ""), "reject_no_primary")
        .when(~F.coalesce(found, F.lit(False)), "reject_no_supporting_cell")
        .when(F.col("support_rank") >= window, "reject_outside_window")
        .when(F.get("cells", F.col("support_rank"))["act"] < floor, "reject_below_floor")
        .otherwise("rescue")
    )
    return d.withColumn("outcome", outcome).withColumn("support_rank", F.when(found, F.col("support_rank"))).drop("_primary", "_marks")


def rank_support(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: the keys, question, answer, cells and forms. One row per cell in its place (rank, from 0): the answer's new names and the question's anchors that stand in it, whether it holds all of the names (supports_all), and whether it alone bears the answer out (validates: an anchor too)."""
    d = rows.select(*keys, "cells", "forms", novel_entities(F.col("answer"), F.col("question")).alias("_new"), F.transform(anchors(F.col("question")), anchor_form).alias("_marks"))
    d = d.select(*keys, "_new", "_marks", F.posexplode(F.arrays_zip("cells", "forms")).alias("rank", "_c")).select(*keys, "rank", F.col("_c.cells.cell_id").alias("cell_id"), F.col("_c.cells.text").alias("_text"), F.col("_c.forms").alias("_form"), "_new", "_marks")
    names = F.transform(F.filter("_new", lambda n: F.contains(F.col("_form"), n["norm"])), lambda n: n["span"])
    marks = F.filter("_marks", lambda m: (m != "") & F.contains(F.col("_form"), m))
    d = d.select(*keys, "rank", "cell_id", (F.coalesce("_text", F.lit("")) != "").alias("has_text"), names.alias("names"), marks.alias("anchors"), ((F.size("_new") > 0) & (F.size(names) == F.size("_new"))).alias("supports_all"))
    return d.withColumn("validates", F.col("supports_all") & (F.size("anchors") > 0))


# What an answer from verified cells says.
NOTHING_VERIFIED, VERIFIED = "Memory is silent: no candidate was verified as a match.", "From verified memory:"


def verified_answer(candidates: Column) -> Column:
    """candidates: structs (cell_id, text, accepted), in order. What may be said from those accepted: a struct of text, cited and refused. Others are neither said nor cited, however loudly they fired."""
    kept = F.filter(candidates, lambda c: c["accepted"])
    lines = F.transform(kept, lambda c: F.concat(F.lit("- ("), c["cell_id"].cast("string"), F.lit(") "), F.coalesce(c["text"], F.lit(""))))
    silent = F.size(kept) == 0
    text = F.when(silent, NOTHING_VERIFIED).otherwise(F.concat(F.lit(f"{VERIFIED}\n"), F.array_join(lines, "\n")))
    return F.struct(text.alias("text"), F.transform(kept, lambda c: c["cell_id"]).alias("cited"), silent.alias("refused"))


def claims(answers: DataFrame, id_col: str, column: str = "answer") -> DataFrame:
    """One row per claim: id, claim_index, start, end (code points), claim. Sentences end at .!?; and white space; clauses at dashes and at a comma with a conjunction. Short fragments and refusals are no claims.

    A match is a fragment with the end behind it; the places of fragments are the running sums of the matches' lengths, so that time is in
    proportion to the number of claims. An answer's matches meet in one window.
    """
    # the row is told from others of its id by a number of its own
    text = F.coalesce(F.col(column), F.lit(""))
    pattern = F.lit(rf"(?sU)(.*?)(?:{SENTENCE_END}|{CLAUSE_END}|\z)")
    matches = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("part"), F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("n"))
    cut = answers.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("id"), matches.alias("m")).select("_row", "id", F.posexplode("m").alias("i", "m")).select("_row", "id", "i", "m.part", "m.n")
    w = Window.partitionBy("_row").orderBy("i")
    placed = cut.withColumn("at", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    tail = F.regexp_replace("part", r"(?U)^\s+", "")
    body = F.regexp_replace(tail, r"(?U)\s+$", "")
    found = placed.select("_row", "id", "i", (F.col("at") + F.length("part") - F.length(tail)).alias("start"), body.alias("claim"))
    bare = F.btrim(F.regexp_replace("claim", CITATION, ""), F.lit(CLAIM_EDGES))
    said = found.withColumn("_bare", bare).where((F.length("_bare") >= MIN_CLAIM) & ~F.exists(F.array(*map(F.lit, REFUSALS)), lambda r: F.contains(F.lower("_bare"), r)))
    return said.select("id", (F.row_number().over(w) - 1).alias("claim_index"), "start", (F.col("start") + F.length("claim")).alias("end"), "claim")


def claim_support(claim_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """claim_rows: id, claim_index, claim, question; cells: id, cells. Adds signals, skipped (no signal), supporter (the first cell that holds all of them) and ok."""
    numbers = bound(numeric_strings(F.col("question")), lambda known: F.filter(numeric_strings(F.col("claim")), lambda n: ~F.array_contains(known, n)))
    marks = F.transform(name_runs(F.col("question")), lambda r: r["norm"])
    said = F.transform(name_runs(F.col("claim")), lambda r: r["norm"])
    names = bound(marks, lambda known: F.filter(said, lambda n: ~F.exists(known, lambda m: F.contains(m, n) | F.contains(n, m))))
    # forms of the cells' texts are made before the join, once for all claims about them
    formed = cells.select("id", F.transform("cells", lambda c: F.struct(c["cell_id"].alias("cell_id"), anchor_form(F.coalesce(c["text"], F.lit(""))).alias("form"))).alias("_cells"))
    d = claim_rows.withColumn("signals", F.concat(F.transform(numbers, anchor_form), names)).join(formed, "id")
    first = F.get(F.filter("_cells", lambda c: F.forall(F.col("signals"), lambda s: F.contains(c["form"], s))), F.lit(0))["cell_id"]
    d = d.withColumn("skipped", F.size("signals") == 0).withColumn("supporter", F.when(~F.col("skipped"), first))
    return d.withColumn("ok", F.col("skipped") | F.col("supporter").isNotNull()).drop("_cells")
