"""Personal data: generators with high recall propose overlapping spans, boosted trees judge them.

Base patterns report by form and checksum. Looser generators propose further spans (written-out @ and dots, numbers in
groups without a plus sign, dotted numbers); each gets features of its format and context. Trees are boosted on all of
the corpus's own candidates that the base patterns label, and on variants made from them (a written-out
address is still an address; a card number with a changed digit is none). Thresholds per kind come from isotonic
calibration on documents that training didn't see. Spans above them that touch no base span are added. A proposal that no
base pattern has confirmed or turned down is not labelled and trains nothing.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.boosting import Trees, calibrated_threshold, in_bins, sigmoid, spread_edges, spread_trees
from recollect.session import release, stored

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds of spans that the model adds.
ADDED = {"email": "email_form", "ip": "ip_form", "card": "card_form", "phone": "phone_form"}
KINDS = [*BASE_KINDS, *ADDED.values()]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_AT = re.compile(r"@|[(\[{]\s?(?:at|AT)\s?[)\]}]")
_LOOSE_EMAIL = re.compile(rf"(?<![\w.%+-])[\w.%+-]++\s{{0,2}}(?:{_AT.pattern})" r"\s{0,2}[A-Za-z0-9-]++(?:(?:\.|\s{0,2}[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s{0,2})[A-Za-z0-9-]++)+")
_NUMBERS = re.compile(r"(?<![\w.+(-])[+(]?\(?[0-9](?:[0-9\x20()-]|\.(?!\x20))*+")
_GROUP = re.compile(r"[+(]*[0-9]+")
#: Words before a span that speak for a kind.
CUES = {
    "email": ("mail", "contact", "correo", "courriel", "write"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "handy", "cell", "whatsapp"),
}
FEATURES = ["length", "digits", "digit_share", "groups", "longest_group", "shortest_group", "dots", "dashes", "spaces", "brackets", "plus", "luhn", "parts_fit", "at", "written_out", "tail_letters", "before", "after", "cue", "leading_zero", "is_email", "is_ip", "is_card", "is_phone"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, kind by kind, each in time proportional to the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def number_runs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of digits, spaces, dashes, dots and brackets that begin and end with a digit (before it a plus sign or bracket), seven signs or more from digit to digit, with no letter or digit beside them."""
    at = 0
    while m := _NUMBERS.search(text, at):
        start, end = m.span()
        first = _DIGIT.search(text, start).start()
        if text[end - 1].isdigit() and (text[end : end + 1].isalnum() or text[end : end + 1] == "_"):
            while end > first and "0" <= text[end - 1] <= "9":  # these digits belong to a word
                end -= 1
        while end > first and not "0" <= text[end - 1] <= "9":
            end -= 1
        if end - first >= 7:
            yield start, end
            at = end
        else:
            at = m.end()


def each_proposal(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) that the loose generators propose, one by one; one span may be proposed as several kinds.

    Of a run of numbers the whole is proposed and each series of neighbouring groups in it; 19 digits at most for each.
    """
    if _AT.search(text):
        for m in _LOOSE_EMAIL.finditer(text):
            yield "email", m.start(), m.end()
    if not _DIGIT.search(text):
        return
    for begin, last in number_runs(text):
        if text.count(".", begin, last) >= 3 and sum(1 for _ in _DIGIT.finditer(text, begin, last)) > 19:
            yield "ip", begin, last
        found = ((g.start(), g.end(), sum(c.isdigit() for c in g[0])) for g in _GROUP.finditer(text, begin, last))
        near: deque[tuple[int, int, int]] = deque(itertools.islice(found, 19))  # the next groups; each has a digit
        while near:
            n = dots = 0
            start, before = near[0][0], None
            for first, end, digits in near:
                n += digits
                if n > 19:
                    break
                dots += text.count(".", before, first) if before is not None else 0
                before = end
                for kind, fits in (("ip", dots >= 3), ("card", n >= 13), ("phone", 7 <= n <= 15)):
                    if fits:
                        yield kind, start, end
            near.popleft()
            near.extend(itertools.islice(found, 1))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """All of each_proposal at once, for texts of a common length."""
    return list(each_proposal(text))


def _cut(text: str, s: int, e: int) -> bool:
    """Whether more of the same run of numbers lies before or after [s, e): a part that no base pattern has judged by itself."""
    return bool(re.search(r"[0-9](?:[\x20()-]|\.(?!\x20))*$", text[max(0, s - 8) : s]) or re.match(r"(?:[\x20()-]|\.(?!\x20))*[0-9]", text[e : e + 8]))


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """The values of FEATURES for a span of some kind with up to 40 characters before and 1 after it."""
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    low = before.lower()
    return [
        len(span), len(digits), len(digits) / max(1, len(span)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count(")"), span.startswith("+"),
        16 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and all(map(_small, groups)),
        "@" in span, bool(re.search(r"[(\[{]\s?(?:at|dot)", span, re.I)), len(span) - len(span.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")),
        0 if not before else 1 if before[-1].isspace() else 2 if before[-1].isalnum() else 3, 0 if not after else 1 if after[0].isspace() else 2 if after[0].isalnum() else 3,
        any(c in low for c in CUES[kind]), digits.startswith("0"), *[kind == k for k in BASE_KINDS],
    ]


def variants(kind: str, span: str) -> list[tuple[str, int]]:
    """(span, label) made from a true span: other ways to write it (1) and things that only look like it (0)."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        name, _, domain = span.partition("@")
        letters = re.sub("[0-9]", "", f"{name} (at) {domain.replace('.', ' (dot) ')}")
        return [(letters, 1), (f"{name} (at) {domain.replace('.', ' (dot) ')}", 1), (f"{name}[at]{domain}", 1), (f"{name} at {domain}", 0), (f"@{domain}", 0)]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        return [("-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), 1), (wrong, 0), (digits[:14], 0), (digits + digits[:6], 0)]
    if kind == "ip":
        a, b, c, d = span.split(".")
        return [(f"{a}.{b}.{int(c) % 100 + 300}.{d}", 0), (f"{a}.{b}.{c}.{d}.{a}", 0), (f"{int(a) % 10}.{int(b) % 10}.{int(c) % 10}.{int(d) % 2000 + 1000}", 0)]
    local = digits[-10:]
    parts = local[:3], local[3:6], local[6:]
    spaced = [f"({parts[0]}) {parts[1]}-{parts[2]}", "-".join(parts), " ".join(parts), f"{parts[0]} {parts[1]}-{parts[2]}"] if len(local) == 10 else [local]
    day = f"20{local[:2]}-{local[2:4]}-{local[4:6]} {local[6:8]}"
    abroad = [f"00{digits[:2]} {digits[2:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}"]
    # pieces of two numbers side by side, days, and runs of other lengths
    across = [f"{parts[2]} ({parts[0]}) {parts[1]}", f"{parts[2]} {parts[0]}-{parts[1]}", f"{parts[1]}-{parts[2]} ({parts[0]}) {parts[1]}", f"{parts[1]}-{parts[2]} {parts[0]}-{parts[1]}"]
    others = [local[:8], f"{local[:4]} {local[4:8]}", f"{local[:2]}-{local[2:6]}-{local[6:8]}", day, local * 2, (local[::-1] + local)[:14], (local[::-1] + local)[:12], ".".join(local[:4])]
    return [*[(v, 1) for v in (*spaced, *abroad)], *[(v, 0) for v in (*across, *others)]]


_SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Proposals that a task holds with their features at once.
BLOCK = 8192
_EXAMPLES = "kind string, held boolean, other boolean, y int, n long, x binary"


def _around(text: str, s: int, e: int) -> tuple[str, str]:
    return text[max(0, s - 40) : s], text[e : e + 1]


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What there is to learn from in all texts: kind, y (the label), x (the features as 8-byte numbers) and n, how often that occurs. held: whether it calibrates thresholds (a fifth of the documents, by crc32 of the id); other: the same by the features, for ids that leave no two parts.

    Proposals count whose label the base patterns give: 1 if a base span of the kind overlaps, 0 if the kind's base pattern has turned the
    span down; a part of a run is 1 only where it is a base span, and has no label else. True ones bring their variants with them.
    """

    def rows(held: bool, text: str) -> Iterator[tuple]:
        spans = base_spans(text)
        by_kind = {k: [(s, e) for x, s, e in spans if x == k] for k in BASE_KINDS}
        whole = {k: set(v) for k, v in by_kind.items()}
        for k, s, e in each_proposal(text):
            if k != "email" and _cut(text, s, e):
                true = 1 if (s, e) in whole[k] else -1
            else:
                true = 1 if _touches(by_kind[k], s, e) else 0 if _turned_down(k, text[s:e]) else -1
            if true >= 0:
                around = _around(text, s, e)
                for span, label in [(text[s:e], true), *(_variants(k, text[s:e]) if true else [])]:
                    x = np.array(features(k, span, *around), float).tobytes()
                    yield k, held, zlib.crc32(x) % 5 == 0, label, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for i, t in zip(b.column(0), b.column(1)) for r in rows(bool(i.as_py()), t.as_py() or ""))
        while block := list(itertools.islice(every, BLOCK)):
            kind, held, other, y, x, n = zip(*((*r, n) for r, n in Counter(block).items()))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(held), pa.array(other), pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(x, pa.binary())], names=["kind", "held", "other", "y", "n", "x"])

    held = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0
    made = docs.select(held.alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _EXAMPLES)
    return made.groupBy("kind", "held", "other", "y", "x").agg(F.sum("n").alias("n"))


def _turned_down(kind: str, span: str) -> bool:
    """Whether the form of a base pattern is there, so that only its check can have failed."""
    return kind == "card" or kind == "ip" and bool(_IP.search(span)) or kind == "phone" and "+" in span


def _joints(values: list[float]) -> int:
    """How many neighbours of a span are neither space nor the text's end."""
    return sum(values[FEATURES.index(f)] > 1 for f in ("before", "after"))


def _touches(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether one of the spans, which are in order and apart, overlaps [s, e)."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if spans[mid][1] <= s else (lo, mid)
    return lo < len(spans) and spans[lo][0] < e


#: Rows of examples, equal ones added up, for which a task of their own is worth while.
TASK_ROWS = 100_000


def train(rows: DataFrame, precision: float = 0.95) -> dict[str, tuple[Trees, float]] | None:
    """Each kind's trees and threshold (a kind without examples of both labels has none), from all examples; None without any true one.

    Those that are held calibrate the thresholds and aren't trained on. Examples stay in tables; borders, sums and scores (to 6 decimals) reach the driver.
    """
    rows = rows_stored = stored(rows, "examples")
    parts = {(r["held"], r["y"]) for r in rows.select("held", "y").distinct().collect()}
    if not any(y for _, y in parts):
        return None
    if len({h for h, _ in parts}) < 2 or len({y for h, y in parts if not h}) < 2:
        rows = rows.withColumn("held", F.col("other"))
    edges = spread_edges(rows.where("NOT held"))
    bins = stored(in_bins(rows, edges, ("held", "y")), "bins")
    seen = bins.where("NOT held")
    models = spread_trees(seen.coalesce(-(-seen.count() // TASK_ROWS) or 1), edges)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, trees in sent.value.items():
                own = [(b, n * y, n) for x, b, y, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "b", "y", "n"))) if x == k]
                if own:
                    b, p, n = zip(*own)
                    s = sigmoid(trees.raw(np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(b)), pa.array(np.round(s, 6)), pa.array(p), pa.array(n)], names=["kind", "score", "p", "n"])

    judged = bins.where("held").mapInArrow(scores, "kind string, score double, p long, n long").groupBy("kind", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toPandas()
    out = {}
    for k, trees in models.items():
        own = judged[judged["kind"] == k]
        out[k] = trees, calibrated_threshold(own["score"].to_numpy(), (own["p"] / own["n"]).to_numpy(), precision, own["n"].to_numpy())
    release(rows_stored, bins)
    return out


def _variants(kind: str, span: str) -> list[tuple[str, int]]:
    try:
        return variants(kind, span)
    except (ValueError, IndexError):  # a true span of another shape than the variants are made for
        return []


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95) -> DataFrame:
    """One row per row of `docs`: doc_id and spans (kind, start, end in code points, end exclusive) by kind as listed in KINDS, then start.

    Base spans always stay; added ones touch neither those nor each other (the better score stays). Texts are read twice, for all
    labelled proposals to learn from and to be judged; a task holds the features of BLOCK proposals at once, and of the others only
    those that reach their threshold. A null or empty text has no spans; a null doc_id stays null; repeated rows are scanned one by one; no rows
    give none, and without any true span nothing is added. Other columns are dropped. Texts are scanned whole.
    """
    model = train(examples(docs, id_col, text_col), precision)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {k: i for i, k in enumerate(KINDS)}

    def reached(texts: list[str]) -> list[list[tuple]]:
        """Per text (score, joints, start, end, kind) of the proposals that reach their kind's threshold."""
        out: list[list[tuple]] = [[] for _ in texts]
        every = ((i, k, s, e) for i, t in enumerate(texts) for k, s, e in each_proposal(t) if k in sent.value)
        while block := list(itertools.islice(every, BLOCK)):
            for kind, (trees, least) in sent.value.items():
                own = [p for p in block if p[1] == kind]
                if own:
                    x = np.array([features(k, texts[i][s:e], *_around(texts[i], s, e)) for i, k, s, e in own], float)
                    v = trees.score(x)
                    for j in np.flatnonzero(v >= least).tolist():
                        i, k, s, e = own[j]
                        out[i].append((float(v[j]), _joints(x[j]), s, e, k))
        return out

    def judged(text: str, better: list[tuple]) -> list[dict]:
        spans = base_spans(text)
        taken: list[tuple[int, int]] = []  # in order and apart
        for s, e in sorted((s, e) for _, s, e in spans):
            if taken and s < taken[-1][1]:
                s, e = taken[-1][0], max(e, taken.pop()[1])
            taken.append((s, e))
        # of equal scores the one with fewer borders at a joint of its number, then the longer
        for _, _, s, e, k in sorted(better, key=lambda z: (-z[0], z[1], z[2] - z[3], z[2], z[4])):
            if not _touches(taken, s, e):
                bisect.insort(taken, (s, e))
                spans.append((ADDED[k], s, e))
        return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda z: (order[z[0]], z[1]))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = [t.as_py() or "" for t in b.column(1)]
                better = reached(texts) if sent.value else [[]] * len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([judged(t, x) for t, x in zip(texts, better)], span_type)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, "doc_id long, spans " + _SPANS)
