"""Exact Jaccard join of documents on word shingles, as a join in a metric space.

1 - Jaccard is a metric on sets, and linked documents lie within R = 1 - threshold of each other. Pivots split the space:

* Level 0. Unrelated documents are at distance 1 from each other, so no document separates them and none is nearer to one
  pivot than to another; the first pivots are sets of one shingle. In one global order of shingles (common ones last) a
  document is put into the regions of its first shingles only, n - ceil(t * n) + l of them: documents within R share l
  of these at least, with l growing with n. A document that meets others in fewer regions than that has no link and
  drops out. The smallest document of such a region becomes its pivot; regions with the same pivot are one. Of its
  regions a document leaves the least ones, with fewer than l / 2 of its shingles in all: two linked documents that do so
  still have one region in common, and chance meetings vanish.
* A region of up to `cap` documents is joined in one task, against an inverted list of its shingles.
* Level 1. In a larger region all distances to the pivot are computed. Documents within R of it are linked to it, and so in
  one component without further tests.
* Windows. By the triangle inequality, linked documents' distances to a pivot differ by R at most. Rings of width R / 2
  around the pivot are the cells of the next level: a document is at home in its ring and is copied into the next two.
* A cell of up to `cap` documents is joined in one task likewise; of a larger one a new pivot is taken, and so on. Where a
  pivot has left more than half of its documents in one cell, or after `levels` pivots in turn, a cell's documents are
  dealt into blocks and the blocks joined pair by pair, so that no task holds more than two blocks. A cell of few but very long documents is dealt by its shingles.

Equal sets are one class throughout: copies cost nothing beyond their row. Results are exact but for collisions of the
63-bit hashes that stand for shingles and classes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.bytes_np import LOWER, HashIndex, chunks, mix, span_hashes, windows, word_spans
from recollect.llm.components import components
from recollect.llm.joins import SENT_ROWS, sent, without_ids
from recollect.session import release, stored

WORDS = 5
#: Linked documents meet in n / SHARE + 1 regions of level 0 at least; a smaller SHARE costs longer prefixes and lets fewer documents through.
SHARE = 10
#: Documents of a region that one task compares with a copy of its pivot.
BLOCK = 512
_TOP = np.uint64(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each k-word shingle, in order; fewer words are one shingle."""
    rows = len(offsets) - 1
    low = LOWER[data]
    start, end, row = word_spans(low, offsets)
    h = span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
    g, where = windows(h, row, k)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            s = np.full(len(short), n, np.uint64) * np.uint64(0xA0761D6478BD642F)
            for j in range(n):
                s = mix(s * np.uint64(0x9FB21C651E98DF25) + h[first[short] + j])
            g, where = np.concatenate([g, s]), np.concatenate([where, short])
    return g >> np.uint64(1), where


def sets(data: np.ndarray, offsets: np.ndarray, hot: HashIndex | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(elements, row of each, size of each row's set, fingerprint of each row's set); elements in the global order within a row."""
    rows = len(offsets) - 1
    g, row = shingles(data, offsets)
    if hot is not None and hot.count and len(g):
        g = np.where(hot.find((g << np.uint64(1)) | np.uint64(1)) >= 0, g | _TOP, g)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
    size = np.bincount(row, minlength=rows)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((g & ~_TOP) + np.uint64(0x51_7C_C1_B7)), dtype=np.uint64)])
    ends = np.cumsum(size)
    print_ = mix(sums[ends] - sums[ends - size] + size.astype(np.uint64))
    return g, row, size, (print_ >> np.uint64(1)).astype(np.int64)


def _common(docs: DataFrame, most: int, block: int = 1 << 22, least: int = 8) -> np.ndarray:
    """Up to `most` shingles that stand in many documents: those seen `least` times in a block of some task, by their sum. They only set the order; any choice is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= least
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(((u[keep] << np.uint64(1)) | np.uint64(1)).view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["s", "n"])

        for _, data, offsets in chunks(batches, "text"):
            g, row, _, _ = sets(data, offsets, None)
            held.append(g)
            if sum(map(len, held)) >= block:
                yield flush()
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(most).select("s").toPandas()
    return rows["s"].to_numpy(np.int64).view(np.uint64)


def _signed(docs: DataFrame, hot, num: int, den: int) -> DataFrame:
    """Per row: doc_id, n_shingles, class (the set's fingerprint) and prefix (its first elements in the global order; null if a row before it in the partition has the same set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex()
        index.add(hot.value)
        seen: set[int] = set()
        for part, data, offsets in chunks(batches, "text"):
            g, row, size, print_ = sets(data, offsets, index)
            keep = size - -(-num * size // den) + size // SHARE + 1
            at = np.arange(len(g)) - (np.cumsum(size) - size)[row]
            new = np.array([x not in seen and not seen.add(x) for x in print_.tolist()]) & (size > 0)
            if len(seen) > 1 << 20:  # a repeated prefix costs rows, nothing else
                seen.clear()
            chosen = (at < keep[row]) & new[row]
            borders = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(size)))]).astype(np.int32))
            lists = pa.ListArray.from_arrays(borders, pa.array(g[chosen].view(np.int64)), mask=pa.array(~new))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(print_), lists], names=["doc_id", "n_shingles", "class", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class long, prefix array<long>")


def _named_texts(docs: DataFrame) -> DataFrame:
    """Per row: class and the text. Texts travel in place of sets: they are less than half as large, and a task makes sets of them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(sets(data, offsets, None)[3]), part.column(part.schema.get_field_index("text"))], names=["class", "text"])

    return docs.select("text").mapInArrow(run, "class long, text string")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list], list[np.ndarray]]]:
    """The columns before the text, and each row's set as sorted numbers."""
    for part, data, offsets in chunks(batches, "text"):
        g, _, size, _ = sets(data, offsets, None)
        ends = np.cumsum(size)
        yield [c.to_pylist() for c in part.columns[:-1]], [g[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]


def _distances(members: DataFrame, whole: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """members (stored): region, m (its documents), pivot, node. Per row: pivot, near (within reach of the pivot), ring and, for the pivot itself, ring -1."""
    sized = sent(members, most)
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = whole.join(sized, F.col("node") == F.col("class")).select("region", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(1).alias("turn"), "node", "text")
    pivots = whole.join(sized.where("node = pivot"), F.col("node") == F.col("class")).select("region", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("turn"), "node", "text")
    dealt = rows.unionByName(pivots).repartition(F.col("region"), F.col("part")).sortWithinPartitions("region", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_node = np.zeros(0, np.uint64), None
        for (regions, _, turns, nodes), own_sets in _with_sets(batches):
            out = []
            for region, turn, node, own in zip(regions, turns, nodes, own_sets):
                if turn == 0:
                    pivot, pivot_node = own, node
                elif node == pivot_node:
                    out.append((region, node, pivot_node, True, -1))
                else:
                    both = len(np.intersect1d(pivot, own, assume_unique=True))
                    union = len(pivot) + len(own) - both
                    # a ring is R / 2 wide: floor of 2 * (1 - both / union) / (1 - num / den)
                    out.append((region, node, pivot_node, both * den >= num * union, 2 * (union - both) * den // (union * (den - num))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()))], names=["region", "node", "pivot", "near", "ring"])

    return dealt.mapInArrow(run, "region long, node long, pivot long, near boolean, ring int")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[i] = j
        return i != j


def cell_links(nodes: list[int], own: list[np.ndarray], home: list[bool], near: list[bool] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join a cell's documents into the components that its links make. Pairs of copied-in documents, and of those near the pivot, are settled elsewhere; near None: nothing is settled yet, and the first document is the pivot."""
    size = np.array([len(x) for x in own])
    values = np.concatenate(own)
    owner = np.repeat(np.arange(len(own)), size)
    order = np.argsort(values, kind="stable")
    owner_sorted = owner[order]
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    ends = np.cumsum(size)
    home_ = np.array(home)
    forest, out = _Forest(len(own)), []

    def linked(i: int) -> list[int]:
        groups = inverse[ends[i] - size[i] : ends[i]]
        groups = groups[count[groups] > 1]
        n = count[groups]
        entry = np.repeat(first[groups], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owner_sorted[entry], minlength=len(own))
        hit = (both * den >= num * (size + size[i] - both)) & (home_ | home_[i])
        hit[i] = False
        return np.flatnonzero(hit).tolist()

    if near is None:
        at_pivot = [0, *linked(0)]
        out += [(nodes[0], nodes[j]) for j in at_pivot[1:]]
    else:
        at_pivot = np.flatnonzero(near).tolist()
    for j in at_pivot[1:]:
        forest.join(at_pivot[0], j)
    for i in np.setdiff1d(np.arange(len(own)), at_pivot).tolist():
        out += [(nodes[i], nodes[j]) for j in linked(i) if forest.join(i, j)]
    return out


def _cells(cells: DataFrame, whole: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """cells: cell (long, long), node, home, near (null throughout a cell: nothing is settled). The links within each cell."""
    rows = whole.join(cells, F.col("node") == F.col("class")).select("region", "part", "node", "home", "near", "text")
    dealt = rows.repartition(F.col("region"), F.col("part")).sortWithinPartitions("region", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush() -> pa.RecordBatch | None:
            nodes, home, near, own = zip(*held)
            found = cell_links(list(nodes), list(own), list(home), None if near[0] is None else list(near), num, den) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"]) if found else None

        for columns, own_sets in _with_sets(batches):
            for region, part, node, home, near, own in zip(*columns, own_sets):
                if (region, part) != key:
                    if held and (made := flush()) is not None:
                        yield made
                    held, key = [], (region, part)
                held.append((node, home, near, own))
        if held and (made := flush()) is not None:
            yield made

    return dealt.mapInArrow(run, "a long, b long")


def _links(members: DataFrame, whole: DataFrame, num: int, den: int, cap: int, shingles_cap: int, levels: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links that join the documents of all regions into their components, and the stored tables that they are read from.

    members (stored): region, m and total (its documents and their shingles), pivot, node, n (the document's shingles).
    """
    small = (F.col("m") <= cap) & (F.col("total") <= shingles_cap)
    whole_regions = sent(members, most).where(small)
    found = _cells(whole_regions.select("region", F.lit(0).alias("part"), "node", F.lit(True).alias("home"), F.lit(None).cast("boolean").alias("near")), whole, num, den, most)
    held, large = [], members.where(~small)
    for level in range(levels):
        if large.isEmpty():
            return found, held
        members = stored(large, "large")
        distances = stored(_distances(members, whole, num, den, most), "distances")
        found = found.unionByName(distances.where("near AND ring >= 0").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        placed = distances.where("ring >= 0").join(members.select("region", "node", "n", F.col("m").alias("of")), ["region", "node"])
        # what the pivot has not settled: regions with a document beyond its reach and a third one
        open_ = stored(placed.groupBy("region").agg(F.count_if(~F.col("near")).alias("far"), F.count(F.lit(1)).alias("m"), F.min(F.when(~F.col("near"), F.col("ring"))).alias("first_far")).where("far > 0 AND m > 1"), "open")
        # documents near the pivot whose ring lies below every window of a far one are settled too
        left = placed.join(sent(open_, most).select("region", "first_far"), "region").where("NOT near OR ring >= first_far - 2")
        copied = left.select("region", "of", "node", "n", "near", "ring", F.explode(F.array(*[F.struct((F.col("ring") + i).alias("part"), F.lit(i == 0).alias("home")) for i in range(3)])).alias("c")).select("region", "of", "c.part", "node", "n", "c.home", "near")
        copied = stored(copied, "copied")  # so that neither the join before it nor what follows keeps a region in one task
        sizes = stored(copied.groupBy("region", "part").agg(F.count(F.lit(1)).alias("m"), F.first("of").alias("of"), F.sum("n").alias("total"), F.count_if("home").alias("homes"), F.count_if(~F.col("near")).alias("far")).where("m > 1 AND homes > 0 AND far > 0"), "sizes")
        cells = stored(copied.drop("of").join(sent(sizes, most).select("region", "part", "of", "m", "total"), ["region", "part"]), "cells")
        release(open_, copied, sizes)
        held += [members, distances, cells]
        found = found.unionByName(_cells(sent(cells, most).where(small).select("region", "part", "node", "home", "near"), whole, num, den, most))
        cell = F.xxhash64("region", "part", F.lit(level))
        unsplit = (F.col("m") * 2 > F.col("of")) | F.lit(level == levels - 1)
        found = found.unionByName(_blocks(cells.where(~small & unsplit).select(cell.alias("region"), "node", "home", "near", "m", "total"), whole, num, den, cap, shingles_cap, most))
        large = cells.where(~small & ~unsplit)
        first = stored(large.groupBy("region", "part").agg(F.min_by("node", F.struct("near", F.xxhash64("node"))).alias("pivot")), "pivots")
        held.append(first)
        large = large.join(sent(first, most), ["region", "part"]).select(cell.alias("region"), "m", "total", "pivot", "node", "n").distinct()
    return found, held


def _blocks(large: DataFrame, whole: DataFrame, num: int, den: int, cap: int, shingles_cap: int, most: int) -> DataFrame:
    """Cells that pivots don't split: documents in blocks of about half of what a task may hold, each pair of blocks one task's work."""
    n = F.greatest(F.ceil(F.col("m") * 2 / cap), F.least(F.ceil(F.col("total") * 2 / shingles_cap), F.col("m"))).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    placed = large.select("*", n.alias("blocks"), own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("part")
    return _cells(placed.select("region", part, "node", "home", "near"), whole, num, den, most)


def _met(postings: DataFrame) -> DataFrame:
    """class, n, s and pivot of the postings (class, n, s) whose shingle has two classes or more, each once; pivot is the smallest of them.

    A common shingle (negative: at most as many as were sent) may stand in any number of documents: its first and last class are
    found map-side and sent back. Another one's documents meet in a task, as rows of three numbers.
    """
    common, rare = postings.where("s < 0"), postings.where("s >= 0")
    ends = common.groupBy("s").agg(F.max("class").alias("_last"), F.min("class").alias("pivot")).where("_last > pivot").select("s", "pivot")
    w = Window.partitionBy("s")
    met = rare.select("*", F.max("class").over(w).alias("_last"), F.min("class").over(w).alias("pivot")).where("_last > pivot")
    met = met.groupBy("s", "class").agg(F.first("n").alias("n"), F.first("pivot").alias("pivot"))  # dealt by s already
    return met.unionByName(common.join(F.broadcast(ends), "s").groupBy("s", "class").agg(F.first("n").alias("n"), F.first("pivot").alias("pivot")))


def _regions(meet: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """region, m, total, pivot, node, n: who is in which region. meet: class, n, s, pivot."""
    shared = meet.groupBy("pivot", "class").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    by_size = Window.partitionBy("class").orderBy("k", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    # linked documents share need shingles here; each leaves regions with fewer than half of that
    kept = shared.select("*", F.sum("k").over(by_size).alias("_left")).where(F.expr(f"_left > ({_need(num, den)} - 1) div 2"))
    members = stored(kept.select(F.col("pivot").alias("region"), F.col("class").alias("node"), "n"), "members")
    of = members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min("node").alias("pivot")).where("m > 1")
    of = stored(of, "region-sizes")
    out = stored(members.join(sent(of, most), "region").select("region", "m", "total", "pivot", "node", "n"), "regions")
    release(members, of)
    return out


def _need(num: int, den: int) -> str:
    """How many regions two linked documents share at least, for a set of n shingles."""
    return f"(n * {int(num)} div ({int(den)} * {SHARE}) + 1)"


def jaccard_components(
    docs: DataFrame,
    num: int = 4,
    den: int = 5,
    cap: int = 1024,
    shingles_cap: int = 4_000_000,
    common: int = 1 << 16,
    levels: int = 3,
    broadcast_rows: int = SENT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles (the set's size), class (documents with equal sets share it) and component_id.

    Words are runs without white space ([^\\x20\\x09-\\x0D]), A-Z in lower case; a set holds the distinct 5-word shingles, or
    the whole sequence where there are fewer words. Two documents link if den * |intersection| >= num * |union|;
    component_id is the smallest doc_id that links reach. A null, empty or blank text has no shingles and links with nothing:
    its component is itself. Null ids are ignored as the smallest; a component of null ids alone gets null. Repeated
    rows and ties share a component. No rows give none. Other columns are dropped. broadcast_rows: tables of ids
    with up to so many rows are sent to all tasks, so that texts travel once, to their regions; larger ones are joined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hot = spark.sparkContext.broadcast(_common(rows, common))
    signed = stored(_signed(rows, hot, num, den), "signed")
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy("class").agg(F.min("doc_id").alias("first_id"))
    postings = filled.select("class", F.col("n_shingles").alias("n"), F.explode("prefix").alias("s"))
    meet = stored(_met(postings), "meetings")
    # fewer meetings than a linked document of the least size would cause rule a link out; who met only such documents drops out too
    alive = stored(meet.groupBy("class").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where(f"k >= {_need(num, den)}").select("class"), "alive")
    again = stored(_met(meet.select("class", "n", "s").join(sent(alive, broadcast_rows), "class", "left_semi")), "meetings")
    release(meet, alive)
    members = _regions(again, num, den, broadcast_rows)
    release(again)
    wanted = stored(members.select(F.col("node").alias("class")).distinct().join(classes, "class"), "wanted")
    ids = stored(wanted.select(F.col("first_id").alias("_id")).distinct(), "ids")
    texts = rows.join(sent(ids, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    named = _named_texts(texts).join(sent(wanted, broadcast_rows).select("class"), "class", "left_semi")
    whole = stored(named.groupBy("class").agg(F.min("text").alias("text")), "texts")
    found, held = _links(members, whole, num, den, cap, shingles_cap, levels, broadcast_rows)
    links = stored(found, "links")
    release(members, wanted, ids, whole, *held)
    roots = components(links)
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(smallest, "root").select("class", "component_id")
    out = filled.join(labels, "class").select("doc_id", "n_shingles", "class", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component, that of the smallest id; documents without shingles stay.

    Rows that share an id are one document: it stays if any of them is the smallest of its component, and of its rows the one
    with the smallest text stays. Rows without an id stay.
    """
    found = stored(jaccard_components(docs, id_col=id_col, text_col=text_col, **options).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("class").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("n")), "decisions")
    kept = without_ids(docs, stored(found.where("NOT stays").select("doc_id"), "gone"), id_col)
    repeated = stored(found.where("stays AND n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    i, t = (f"_{c}_{uuid.uuid4().hex}" for c in "it")  # names that no column of docs has
    once = kept.join(sent(repeated).toDF(i), F.col(f"`{id_col}`") == F.col(i), "left_semi")
    least = once.groupBy(F.col(f"`{id_col}`").alias(i)).agg(F.min(f"`{text_col}`").alias(t))
    once = once.join(least, (F.col(f"`{id_col}`") == F.col(i)) & F.col(f"`{text_col}`").eqNullSafe(F.col(t))).dropDuplicates([id_col]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return without_ids(kept, repeated, id_col).unionByName(once)
