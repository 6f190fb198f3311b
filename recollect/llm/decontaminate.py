"""Benchmark decontamination: the q-gram lemma as a filter, banded alignment as the proof.

A text region within k edits of an item of n characters shares at least n - q + 1 - kq of its q-grams, and these lie on
at most k + 1 neighbouring diagonals (place in the text minus place in the item). Shared q-grams are counted per item in
bands of 2k + 1 diagonals that overlap by half, so that one band holds them all; bands that reach the bound are aligned
in full. Nothing within the budget is lost: folding and hashing of characters can only add shared q-grams.

The items are sent to the executors in blocks whose size is a parameter; documents are read where they lie, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.joins import without_ids
from recollect.session import stored

SCHEMA = "doc_id long, item_id long, start long, end long, edits long"
GAP = b"\0" * 24
_FOLD = bytes(c + 32 if 65 <= c <= 90 or (0xC0 <= c <= 0xDE and c != 0xD7) else 32 if 9 <= c <= 13 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 22


def folded(text: str) -> bytes:
    """One byte per character: lower case, any white space a space; characters beyond Latin-1 are hashed to a byte."""
    try:
        return text.encode("latin-1").translate(_FOLD).replace(b"\0", b" ")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = np.frombuffer(_same_length_lower(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.where(lower < 256, lower, 1 + (lower * np.uint32(2654435761) >> np.uint32(17)) % 255)
        assert len(points) == len(small)
        return small.astype(np.uint8).tobytes().translate(_FOLD).replace(b"\0", b" ")


def _same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def letters(text: str) -> np.ndarray:
    """The characters that alignment compares: code points in lower case, white space as a space."""
    points = np.frombuffer(_same_length_lower(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 9) & (points <= 13), 32, points)


def grams(data: bytes, q: int) -> np.ndarray:
    """A 64-bit value per q-gram (8 <= q <= 16): two overlapping words of 8 bytes."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v = np.ndarray((len(a) - 7,), "<u8", buffer=a, strides=(1,))
    return (v[:n] * _M1) ^ ((v[q - 8 : q - 8 + n] >> np.uint64(3)) * _M2)


class ItemIndex:
    """The q-grams of a block of items, with each item's edit budget and count bound."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        self.items = [(i, t, folded(t)) for i, t in items if len(t) >= q]
        self.n = np.array([len(f) for *_, f in self.items], np.int64)
        self.k = np.minimum((self.n * rate).astype(np.int64), (self.n - q) // q)
        self.bound = self.n - q + 1 - self.k * q
        parts = [grams(f, q) for *_, f in self.items]
        g = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, first, self.count = np.unique(g, return_index=True, return_counts=True)
        # return_index counts in the order given; in sorted order groups are consecutive
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.text = [letters(t) for _, t, _ in self.items]

    def bands(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, lowest diagonal) of bands that reach the bound; data: folded texts with gaps, which begin at `starts`."""
        none = (np.zeros(0, np.int64),) * 3
        g = grams(data, self.q)
        if not len(self.grams) or not len(g):
            return none
        at = np.flatnonzero(self.bitmap[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        j = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        there = self.grams[j] == g[at]
        at, j = at[there], j[there]
        if not len(at):
            return none
        doc = np.searchsorted(starts, at, "right") - 1
        # a text with fewer hits than the smallest bound has no band
        enough = np.bincount(doc, minlength=len(starts))[doc] >= self.bound.min()
        at, j, doc = at[enough], j[enough], doc[enough]
        found = []
        for a in range(0, len(at), 1 << 18):  # blocks end where a text ends
            lo = a if not a else int(np.searchsorted(doc, doc[a], "left"))
            hi = len(at) if a + (1 << 18) >= len(at) else int(np.searchsorted(doc, doc[a + (1 << 18)], "left"))
            if lo < hi:
                found.append(self._count(at[lo:hi], j[lo:hi], doc[lo:hi], starts))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else none

    def _count(self, at, j, doc, starts):
        """Bands that reach the bound, of hits on the index's grams; a gram may stand in many items, so hits are multiplied out in blocks."""
        total = len(self.items)
        cuts = np.flatnonzero(np.diff(np.cumsum(self.count[j]) // _BLOCK, prepend=0))
        blocks = list(zip(np.r_[0, cuts], np.r_[cuts, len(at)]))

        def spread(lo: int, hi: int):
            n = self.count[j[lo:hi]]
            entry = np.repeat(self.first[j[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return np.repeat(doc[lo:hi], n), self.item[entry], np.repeat(at[lo:hi] - starts[doc[lo:hi]], n) - self.place[entry]

        keys, many = _added([np.unique(d * total + i, return_counts=True) for d, i, _ in (spread(lo, hi) for lo, hi in blocks)])
        keys = keys[many >= self.bound[keys % total]]
        found = []
        for lo, hi in blocks if len(keys) else ():
            d, i, diagonal = spread(lo, hi)
            key = d * total + i
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = keys[place] == key
            place, band = place[here], np.floor_divide(diagonal[here], self.k[i[here]] + 1)
            # one number for (document and item, band): bands lie between minus an item's and a document's length
            both = np.r_[place, place] << 40 | (np.r_[band, band - 1] + (1 << 39))
            found.append(np.unique(both, return_counts=True))
        both, many = _added(found)
        key, band = keys[both >> 40] if len(keys) else both, (both & ((1 << 40) - 1)) - (1 << 39)
        enough = many >= self.bound[key % total]
        key, band = key[enough], band[enough]
        return key // total, key % total, band * (self.k[key % total] + 1)


#: Pairs of a hit and an item that are held at once.
_BLOCK = 1 << 20


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, in order, and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, back = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(back, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the region's best match of the whole item with at most k edits, on diagonals low to high; None if there is none.

    Ties: fewest edits, then the smallest end, then the largest start that the recurrence keeps.
    """
    n, width, far = len(item), high - low + 1, 1 << 30
    offsets = np.arange(width)
    columns = low + offsets  # the region's place at row 0 on each diagonal
    cost = np.where((columns >= 0) & (columns <= len(region)), 0, far)
    start = columns.copy()
    padded = np.full(len(region) + 2 * (n + width) + abs(low) + 2, -1, np.int64)
    shift = n + width + abs(low)
    padded[shift : shift + len(region)] = region
    for i in range(1, n + 1):
        place = columns + i  # columns consumed after this row
        letter = padded[shift + low + i - 1 : shift + low + i - 1 + width]
        step = cost + (letter != item[i - 1])
        from_ = start
        up = np.append(cost[1:] + 1, far)
        better = up < step
        step = np.where(better, up, step)
        from_ = np.where(better, np.append(start[1:], 0), from_)
        step = np.where((place >= 0) & (place <= len(region)), step, far)
        run = np.minimum.accumulate(step - offsets)
        left = run + offsets
        source = np.maximum.accumulate(np.where(step - offsets == run, offsets, 0))
        cost, start = np.minimum(left, far), from_[source]
        if cost.min() > k:
            return None
    best = int(np.argmin(cost))
    return (int(cost[best]), int(start[best]), int(columns[best] + n)) if cost[best] <= k else None


def matches(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, edits) of the regions of texts within an item's edit budget; those of one item don't overlap."""
    parts, starts, at = [], [], 0
    for t in texts:
        f = folded(t)
        starts.append(at)
        parts += [f, GAP]
        at += len(f) + len(GAP)
    if not texts:
        return
    doc, item, low = index.bands(b"".join(parts), np.array(starts, np.int64))
    cache: dict[int, np.ndarray] = {}
    regions: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, i, lo in zip(doc.tolist(), item.tolist(), low.tolist()):
        if d not in cache:
            cache = {d: letters(texts[d])}
        n, k = int(index.n[i]), int(index.k[i])
        lo, hi = lo - k, lo + 3 * k + 2
        first, last = max(0, lo), min(len(cache[d]), hi + n + 1)
        found = align(index.text[i], cache[d][first:last], lo - first, hi - first, k)
        if found:
            regions.setdefault((d, i), []).append((found[0], found[1] + first, found[2] + first))
    for (d, i), spans in regions.items():
        taken: list[tuple[int, int]] = []
        for edits, s, e in sorted(set(spans)):
            if not any(a < e and s < z for a, z in taken):
                taken.append((s, e))
                yield d, index.items[i][0], s, e, edits


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = 10,
    rate: float = 0.08,
    block_chars: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per region of a document that matches a benchmark item whole: doc_id, item_id, start, end (code points), edits.

    An item of n characters may differ by min(rate * n, (n - q) / q) edits, letters' case and the kind of white space
    aside. Items shorter than q characters, null ones and those without an id can't be proof and are passed over; so are
    null and empty texts. A null doc_id stays null. Repeated rows give repeated rows, repeated items are one. Regions of
    one item in a document don't overlap; regions of different items may. No documents or no items: no rows. Other columns
    are dropped. The items are read in blocks of about `block_chars` characters, each of which is sent to the
    executors and held against all documents; a longer item is a block of its own.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where(f"i IS NOT NULL AND char_length(t) >= {int(q)}").distinct()
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(f"char_length(text) >= {int(q) - int(q * rate)}")

    def scan(b: int) -> DataFrame:
        rows = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").toLocalIterator()]
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, q, rate)
            kind = pa.schema([(x, pa.int64()) for x in ("doc_id", "item_id", "start", "end", "edits")])
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                first = 0
                while first < len(texts):
                    last, size = first, 0
                    while last < len(texts) and (last == first or size + len(texts[last]) < 1 << 20):
                        size += len(texts[last])
                        last += 1
                    found = [(ids[first + d], *rest) for d, *rest in matches(index, texts[first:last])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=kind)
                    first = last

        return source.mapInArrow(run, SCHEMA)

    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    out = scan(0)
    for b in range(1, blocks):
        out = out.unionByName(scan(b))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark item, with the same columns. A null id can't be told from others: all rows with it go if one is hit."""
    hit = stored(find_contamination(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct(), "hit")
    return without_ids(docs, hit, id_col, null_too=True)
