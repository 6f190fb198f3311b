"""Removal of lines that many sites share.

Each line's 64-bit hash gets a HyperLogLog sketch of the sites on which it stands (approx_count_distinct: registers are
merged map-side and again after the shuffle). Lines far above the threshold are decided by the estimate; all others that
stand on two sites or more, where a few sites may have met in one register, by an exact distinct count over those lines alone. Of a shared line the first
occurrence, in the document with the smallest id, stays; the others go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.session import stored

WHITE = " \t\n\x0b\f\r"


def _counted(line: Column, min_words: int) -> Column:
    return F.btrim(line, F.lit(WHITE)).rlike(r"^[^\x20\x09-\x0D]+" + r"([\x20\x09-\x0D]+[^\x20\x09-\x0D]+)" * (min_words - 1))


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(WHITE)))


def _own(id_: Column, text: Column) -> Column:
    """What tells rows without an id from each other: a hash of their text."""
    return F.when(id_.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def shared_lines(lines: DataFrame, min_sites: int, error: float = 0.1, band: float = 0.5) -> DataFrame:
    """Per hash (h) that stands on at least `min_sites` sites: h and first, the smallest (id, own) with it, a null id before others. lines: h, site, id, own.

    error: the sketch's relative standard deviation; up to min_sites * (1 + band), five deviations, sites are counted exactly.
    """
    first = F.min(F.struct(F.col("id").isNotNull().alias("named"), "id", "own")).alias("first")
    spread = lines.groupBy("h").agg(F.approx_count_distinct("site", error).alias("about"), F.count(F.lit(1)).alias("n"), first, (F.min(F.xxhash64("site")) != F.max(F.xxhash64("site"))).alias("sites_differ"))
    spread = spread.where((F.col("n") >= min_sites) & (F.col("sites_differ") | F.lit(min_sites < 2)))
    spread = stored(spread, "line-spread")
    near = spread.where(F.col("about") <= min_sites * (1 + band)).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    far = spread.where(F.col("about") > min_sites * (1 + band))
    sure = spread.join(exact.where(F.col("sites") >= min_sites), "h", "left_semi").unionByName(far)
    return sure.select("h", F.col("first.id").alias("first_id"), F.col("first.own").alias("first_own"), "about")


def drop_shared_lines(
    docs: DataFrame, min_sites: int = 3, min_words: int = 3, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with the column text without shared lines, and n_shared_lines, the lines that were removed.

    A line is divided by \\n, compared without white space at its ends, and counts from `min_words` words on. It is shared
    if it stands on `min_sites` sites or more. It stays at its first occurrence in the document of the smallest id and goes everywhere else;
    rows with equal ids are one document. Rows without an id are documents by their text and come before all others, in the order of
    its hash. A null site is a site of its own. A null text stays null, an empty one empty; no rows give none. Other columns pass
    through, whatever their names, but one named n_shared_lines is replaced.
    """
    mine = f"_{uuid.uuid4().hex}_"  # no column of docs begins so
    key, body = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    lines = docs.select(key.alias("id"), _own(key, body).alias("own"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`").cast("string")), F.lit("-")).alias("site"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line")).where(_counted(F.col("line"), min_words))
    lines = stored(lines.select("id", "own", "site", "pos", _hash(F.col("line")).alias("h")), "lines")
    shared = stored(shared_lines(lines, min_sites).select("h", "first_id", "first_own"), "shared")
    own_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("own") == F.col("first_own"))
    # joined by hash and document, then counted down: a line that stands everywhere is spread over its documents
    stays = lines.join(shared.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & own_first).groupBy("h", "first_id", "first_own").agg(F.min("pos").alias("first_pos"))
    gone = lines.select("id", "own", "pos", "h").join(stays, "h").where(~(own_first & (F.col("pos") == F.col("first_pos"))))
    by_doc = gone.groupBy(F.col("id").alias(f"{mine}id"), F.col("own").alias(f"{mine}own")).agg(F.collect_set(F.struct("pos", "h")).alias(f"{mine}gone"))
    taken, all_, kept = (F.col(f"{mine}{x}") for x in ("gone", "all", "kept"))
    joined = docs.drop("n_shared_lines").withColumn(f"{mine}o", _own(key, body)).join(by_doc, key.eqNullSafe(F.col(f"{mine}id")) & (F.col(f"{mine}o") == F.col(f"{mine}own")), "left")
    joined = joined.withColumn(f"{mine}all", F.when(taken.isNotNull(), F.split(body, "\n", -1)))
    # lines are known by place and hash: a few are looked up in a list, many by array_except in a hash set, so that time stays in proportion to the lines
    few = F.filter(all_, lambda line, i: ~F.array_contains(taken, F.struct(i.alias("pos"), _hash(line).alias("h"))))
    said = lambda pos, h: F.concat(pos.cast("string"), F.lit(":"), h.cast("string"))
    left = F.array_except(F.transform(all_, lambda line, i: said(i, _hash(line))), F.transform(taken, lambda g: said(g["pos"], g["h"])))
    many = F.transform(left, lambda k: F.get(all_, F.substring_index(k, ":", 1).cast("int")))
    joined = joined.withColumn(f"{mine}kept", F.when(F.size(taken) <= 64, few).otherwise(many))
    text = F.when(kept.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"`{text_col}`"))
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_shared_lines"]
    return joined.select(*out, F.when(kept.isNotNull(), F.size(all_) - F.size(kept)).otherwise(0).cast("long").alias("n_shared_lines"))
