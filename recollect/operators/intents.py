"""Routing of instructions by the form of their text, with the operands that each kind of instruction carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of a bank operator's instructions.
REMOVE = r"^\s*(?:tombstone|remove|delete|drop)\s+(?:cell\s+)?(\d+)\s*(?:[:\-,]\s*|\s+because\s+|\s+reason\s+)(\S.*?)\s*$"
INSPECT = r"^\s*(?:show|list|inspect|print)\s+provenance\s*$"
ADD = r"^\s*(?:remember|add|note|record|store)(?:\s+that)?\s*:?\s*(\S.+?)\s*$"
QUOTES = "\"“”‘’"
# Words that tell what a user's turn asks of a memory.
WRITE_WORDS = ["remember", "note", "store", "save", "memorize", "memorise", "record", "log"]
DELETE_WORDS = ["delete", "forget", "remove", "erase", "unlearn", "drop"]
BIND_WORDS = ["bind", "group", "link", "associate", "combine", "connect", "merge"]
QUESTION_WORDS = ["what", "who", "when", "where", "why", "how", "which", "whose", "whom"]
MEMORY_ID = r"\b(mem[-_][0-9a-zA-Z]+)\b"
# The same as patterns, in the order in which they are tried.
DELETE_FORM = r"\b(delete|forget|remove|unlearn|erase)\b"
BIND_FORM = r"\b(bind|group|link|associate|combine)\b"
WRITE_FORM = r"\b(remember|note that|store|save|memori[sz]e|keep in mind)\b"
QUERY_FORM = r"(\bwhat\b|\bwho\b|\bwhen\b|\bwhere\b|\bwhy\b|\bhow\b|\bwhich\b|\brecall\b|\bdo you (?:remember|know)\b|\?\s*$)"
# The verb before what is to be remembered.
LEADING_WRITE = r"^\s*(please\s+)?(" + "|".join(sorted(WRITE_WORDS)) + r")(\s+that)?[:,]?\s*"

_SPACE = " \t\n\x0b\f\r"


def _stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, "(?id)" + pattern, group)


def instruction(text: Column) -> Column:
    """A struct of kind (add, remove, inspect or unknown, which means that nothing is to be done), cell_id, reason, text and note."""
    t = _stripped(text)
    says = lambda p: t.rlike("(?id)" + p)
    payload = F.btrim(F.btrim(_part(t, ADD, 1), F.lit(_SPACE)), F.lit(QUOTES))
    kind = F.when(says(REMOVE), "remove").when(says(INSPECT), "inspect").when(says(ADD) & (payload != ""), "add").otherwise("unknown")
    note = F.when(t == "", "empty instruction").when(says(ADD) & (payload == ""), "nothing to add").when(kind == "unknown", "no known form")
    removing = says(REMOVE)
    return F.struct(
        kind.alias("kind"),
        F.when(removing, _part(t, REMOVE, 1).try_cast("long")).alias("cell_id"),
        F.when(removing, _part(t, REMOVE, 2)).alias("reason"),
        F.when(kind == "add", payload).alias("text"),
        note.alias("note"),
    )


def memory_text(text: Column) -> Column:
    """What a turn asks to remember, without the verb before it and the stop after it; the turn itself where nothing else is left."""
    t = _stripped(text)
    bare = F.btrim(F.rtrim(F.regexp_replace(t, "(?i)" + LEADING_WRITE, ""), F.lit(" .")), F.lit(_SPACE))
    return F.when(bare != "", bare).otherwise(t)


# How sure an intent is, by what speaks for it.
SURE = {"delete with id": 0.9, "delete": 0.5, "bind": 0.7, "write": 0.85, "question": 0.8, "other": 0.4, "nothing": 0.0}


def _routed(text: Column, delete: Column, bind: Column, write: Column, ask: Column) -> Column:
    t = _stripped(text)
    found = F.nullif(F.regexp_extract(t, MEMORY_ID, 1), F.lit(""))
    action = F.when(delete, "delete").when(bind, "bind").when(write, "write").when(t != "", "query").otherwise("unknown")
    deleted = F.when(found.isNotNull(), SURE["delete with id"]).otherwise(SURE["delete"])
    sure = F.when(delete, deleted).when(bind, SURE["bind"]).when(write, SURE["write"]).when(ask, SURE["question"]).when(t != "", SURE["other"]).otherwise(SURE["nothing"])
    return F.struct(action.alias("intent"), sure.alias("confidence"), F.when(action == "delete", found).alias("memory_id"), F.when(action == "write", memory_text(text)).alias("to_write"))


def by_keywords(text: Column) -> Column:
    """A struct of intent, confidence, memory_id (of what is to be deleted) and to_write, from the words of a turn; other turns are questions."""
    t = F.lower(_stripped(text))
    words = F.regexp_extract_all(t, F.lit("[a-z0-9']+"), F.lit(0))
    among = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    ask = F.coalesce(F.get(words, F.lit(0)).isin(QUESTION_WORDS), F.lit(False)) | t.endswith("?")
    return _routed(text, among(DELETE_WORDS), among(BIND_WORDS), among(WRITE_WORDS), ask)


def by_patterns(text: Column) -> Column:
    """The same from patterns, which know phrases too."""
    t = _stripped(text)
    says = lambda p: t.rlike("(?i)" + p)
    return _routed(text, says(DELETE_FORM), says(BIND_FORM), says(WRITE_FORM), says(QUERY_FORM))


def decision(raw: Column) -> Column:
    """A controller's JSON (action, confidence, reason) with confidence held within 0 and 1; null where it is malformed."""
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "action string, confidence double, reason string")
    sure = F.least(F.greatest(F.coalesce(parsed["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(parsed["action"].isNotNull(), F.struct(parsed["action"].alias("action"), sure.alias("confidence"), parsed["reason"].alias("reason")))


def judged(deterministic: Column, raw: Column) -> Column:
    """The verdict of a judge: a deterministic rejection is final; a malformed answer is ambiguous."""
    verdict = F.lower(F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "verdict string")["verdict"])
    return F.when(deterministic == "reject", "reject").otherwise(F.when(verdict.isin("accept", "reject"), verdict).otherwise("ambiguous"))


def claimed_within(claimed: Column, fired: Column) -> Column:
    """Whether all ids that an answer claims have fired."""
    return F.size(F.array_except(claimed, fired)) == 0


def within_fired(claimed: Column, fired: Column) -> Column:
    """The claimed ids that have fired, in their order; an answer may rest on no others."""
    return F.filter(claimed, lambda c: F.array_contains(fired, c))
