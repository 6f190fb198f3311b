"""Centroid clustering: Lloyd's rounds over what has changed.

Owners and distances are kept with the vectors in a stored table, and the clusters' sums with the driver (k x (dims + 1) whole
numbers). A round compares a vector whose centroid stood still with the moved centroids only, as no other one can have come
nearer, and a vector whose centroid moved with all of them. Vectors that change hands are then read back, each task adds
them to the new cluster and takes them from the old one, and the sum of these signed transfers brings the clusters' sums up to
date. Vectors never cross the network; tables of earlier rounds are deleted.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.int_vectors import kept_vectors, matrix, products
from recollect.session import release, stored

STATE = "vec_id long, v array<int>, owner int, distance long, was int"


def nearest(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest row of `centers`; of equally near ones the first."""
    d = (v.astype(np.int64) ** 2).sum(1)[:, None] - 2 * products(v, centers) + (centers.astype(np.int64) ** 2).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at]


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centers: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centers marked in `moved` have moved; owner -1: none so far."""
    owner, distance = owner.copy(), distance.copy()
    lost = owner < 0
    lost[~lost] = moved[owner[~lost]]
    if lost.any():
        owner[lost], distance[lost] = nearest(v[lost], centers)
    stay, which = np.flatnonzero(~lost), np.flatnonzero(moved)
    if len(stay) and len(which):
        at, d = nearest(v[stay], centers[which])
        at = which[at]
        won = (d < distance[stay]) | ((d == distance[stay]) & (at < owner[stay]))
        owner[stay[won]], distance[stay[won]] = at[won], d[won]
    return owner, distance


def _assigned(state: DataFrame, centers: np.ndarray, moved: np.ndarray) -> DataFrame:
    dims = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = b.column("owner").to_numpy()
            owner, distance = reassigned(matrix(b.column("v"), dims), was, b.column("distance").to_numpy(), centers, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(was)], names=["vec_id", "v", "owner", "distance", "was"])

    return state.mapInArrow(run, STATE)


def _transfers(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """What each cluster has gained: a row of component sums and the number of vectors, less what it has lost. One row per cluster comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            v = np.column_stack([matrix(b.column("v"), dims), np.ones(b.num_rows, np.int64)])
            owner, was = b.column("owner").to_numpy(), b.column("was").to_numpy()
            sign = np.zeros((k, len(v)), np.int64)
            sign[owner, np.arange(len(v))] = 1
            had = np.flatnonzero(was >= 0)
            sign[was[had], had] = -1
            gain += products(sign, v.T)
        some = np.flatnonzero(gain.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(gain[some]), pa.list_(pa.int64()))], names=["cluster", "gain"])

    parts = state.where("owner <> was").select("v", "owner", "was").mapInArrow(run, "cluster int, gain array<long>")
    total = np.zeros((k, dims + 1), np.int64)
    for cluster, *gain in parts.groupBy("cluster").agg(*[F.sum(F.col("gain")[i]) for i in range(dims + 1)]).collect():
        total[cluster] = gain
    return total


def first_centers(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the smallest sha256 of salt and id, in its order; of equal ids the smaller vector first. k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").orderBy(key, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def delta_lloyd(rows: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2:", dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept row: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 after `rounds` rounds.

    Kept are rows whose vector has exactly `dims` components, none null, not finite or beyond int_vectors.MOST once scaled; x becomes
    floor(scale * x). The first centroids are k kept vectors by the order of sha256(salt + id), fewer if there are fewer;
    rows without an id are assigned, but none of them is a first centroid (if no row has an id, there is no centroid and no
    row in the result). Each round assigns all vectors to the nearest centroid (ties: the smaller number) and replaces those that
    own a vector by the floor of their vectors' mean; then vectors are assigned once more. Repeated rows are vectors of their own, also as
    first centroids. Sums that don't fit a long are null. No rows give none. Other columns are dropped, so their names can't clash.
    The rounds run while the query is defined.
    """
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    vectors = kept_vectors(named, "v", dims, scale)
    centers = first_centers(vectors, k, salt).reshape(-1, dims)
    k = len(centers)
    if not k:
        vectors = vectors.limit(0)
    begin = vectors.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was"))
    moved = np.ones(k, bool)
    state = stored(_assigned(begin, centers, moved), "owners")
    sums = np.zeros((k, dims + 1), np.int64)
    for _ in range(rounds):
        sums += _transfers(state, k, dims)
        some = sums[:, -1] > 0
        now = centers.copy()
        now[some] = sums[some, :-1] // sums[some, -1:]
        moved = (now != centers).any(1)
        centers = now
        if not moved.any():
            break
        last, state = state, stored(_assigned(state, centers, moved), "owners")
        release(last)
    inertia = {r["owner"]: r["s"] for r in state.groupBy("owner").agg(F.try_sum("distance").alias("s")).collect()}
    about = [{"s": inertia.get(i), "sha": hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()} for i, c in enumerate(centers.tolist())]
    every = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    of = F.get(F.from_json(F.lit(json.dumps(about)), "array<struct<s:long,sha:string>>"), F.col("owner"))
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance", of["s"].alias("cluster_inertia"), F.lit(every).cast("long").alias("inertia"), of["sha"].alias("centroid_sha256"))
