"""Operator 11: exact k-means in integers with ns-bounds.

A vector keeps, for each centroid, the last distance that was computed and the
round of it.  The centroids of all rounds are kept (rounds x k x components
integers), so a stored distance is a bound now, loosened by how far the
centroid lies from where it was in that round: the norm of the total
displacement, which is never more than the sum of the steps in between.  A
centroid whose lower bound is above the upper bound of a vector's own centroid
cannot be nearest, nor tie.  Where that fails, the own distance is computed
anew, and then those of the centroids that still fail; these are exact integer
distances, so ties go to the smaller number.  Bounds are floating point and
widened by a share that covers their rounding.

A round is one narrow pass over the vectors beside their bounds, written as
Parquet in the shared folder (a lost executor costs its tasks of one round).  No
vector is shuffled: a task adds up by how much its moved vectors change the
centroids' sums, one row a centroid, and the driver divides k sums.  If no
vector moved, the rounds that are left change nothing and are not run.

Cases: vectors with another number of components, or with a null or non-finite
one, and null vectors are left out; rows of one id, and equal vectors, are
vectors of their own; a null id is kept, and comes last when the first
centroids are chosen (equal hashes: the smaller vector first); fewer vectors
than k give as many centroids; an empty table, or one without such a vector,
gives an empty one; other columns are ignored.  A component must lie within
2^26 after scaling, so that squared distances are longs: a larger one is an
error, not a wrong distance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import binary_array, column, text_view, tidy
from mercato.llm._store import Stored

#: Largest magnitude of a component; 64 squares of twice that fit a long.
_MOST = 1 << 26
#: Share by which bounds are widened for rounding.
_SLACK = 1e-9


@dataclass(frozen=True)
class Plan:
    components: int = 64
    k: int = 8
    rounds: int = 10
    #: The first centroids are the vectors of the smallest sha256 of ``seed:id``.
    seed: int = 3
    scale: int = 1024


def prepared(df: DataFrame, key: str, vector: str, plan: Plan) -> DataFrame:
    """id, v: the vectors that are kept, as arrays of whole numbers."""
    x = column(df, vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where((F.size(x) == plan.components) & finite)
    return kept.select(column(df, key).alias("id"), F.transform(
        x, lambda c: F.floor(c.cast("double") * float(plan.scale))).alias("v"))


def first_centroids(vectors: DataFrame, plan: Plan) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(plan.k).collect()
    return np.array([row.v for row in first], np.int64).reshape(len(first), plan.components)


def reassign(v: np.ndarray, history: np.ndarray, at: np.ndarray | None, seen: np.ndarray, when: np.ndarray):
    """(nearest centroid, distances computed) of the vectors ``v`` among the
    last centroids of ``history`` [round, centroid, component].  ``at``: the
    centroids so far, None in the first round; ``seen``, ``when``: the last
    computed distances [vector, centroid] and their rounds, brought up to date
    in place."""
    now, k = len(history) - 1, history.shape[1]
    centres = history[now]
    exact = np.full((len(v), k), np.iinfo(np.int64).max)

    def compute(rows: np.ndarray, j: int) -> None:
        gap = v[rows] - centres[j]
        exact[rows, j] = np.einsum("ij,ij->i", gap, gap)
        seen[rows, j] = np.sqrt(exact[rows, j])
        when[rows, j] = now

    everyone = np.arange(len(v))
    if at is None:
        for j in range(k):
            compute(everyone, j)
        return exact.argmin(axis=1), exact.size
    moved = np.sqrt(((history - centres) ** 2).sum(axis=2).astype(float)) * (1 + _SLACK)
    low = seen * (1 - _SLACK) - moved[when, np.arange(k)]
    low[everyone, at] = np.inf
    high = seen[everyone, at] * (1 + _SLACK) + moved[when[everyone, at], at]
    rows = np.flatnonzero((low <= high[:, None]).any(axis=1))
    for j in range(k):
        compute(rows[at[rows] == j], j)
    high[rows] = seen[rows, at[rows]] * (1 + _SLACK)
    failed = low[rows] <= high[rows][:, None]
    for j in range(k):
        compute(rows[failed[:, j]], j)
    nearest = at.copy()
    nearest[rows] = exact[rows].argmin(axis=1)
    return nearest, len(rows) + int(failed.sum())


def _matrix(array: pa.Array, dtype: str, width: int) -> np.ndarray:
    return text_view(array)[0].view(dtype).reshape(len(array), width)


def _rows(a: np.ndarray) -> pa.Array:
    return binary_array([row.tobytes() for row in a])


def _components(array: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch, from lists of longs or packed."""
    if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type):
        return _matrix(array, "<i4", width).astype(np.int64)
    v = array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), width)
    if len(v) and (v.max() > _MOST or v.min() < -_MOST):
        raise ValueError(f"a component is beyond {_MOST} after scaling")
    return v


def assigned(rows: DataFrame, history: np.ndarray, first: bool) -> DataFrame:
    """id, v, at, seen, when of the vectors for the last centroids of
    ``history``; beside them rows without v, of a task's centroid each: by how
    much its count and sums change."""
    k, width = history.shape[1:]
    schema = T.StructType([rows.schema["id"]] + [T.StructField(*f) for f in (
        ("v", T.BinaryType()), ("at", T.IntegerType()), ("seen", T.BinaryType()), ("when", T.BinaryType()),
        ("n", T.LongType()), ("sums", T.ArrayType(T.LongType())))])
    names = schema.names

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        types = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            types = batch.schema.field(0).type
            v = _components(batch.column(1), width)
            if first:
                at, seen, when = None, np.zeros((n, k)), np.zeros((n, k), np.uint8)
            else:
                at = batch.column(2).to_numpy().astype(np.int64)
                seen = _matrix(batch.column(3), "<f8", k).copy()
                when = _matrix(batch.column(4), "u1", k).copy()
            nearest, _ = reassign(v, history, at, seen, when)
            went = np.arange(n) if first else np.flatnonzero(nearest != at)
            np.add.at(count, nearest[went], 1)
            np.add.at(sums, nearest[went], v[went])
            if not first:
                np.subtract.at(count, at[went], 1)
                np.subtract.at(sums, at[went], v[went])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), _rows(v.astype("<i4")), pa.array(nearest.astype(np.int32)),
                _rows(seen), _rows(when), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        some = np.flatnonzero(count.astype(bool) | sums.any(axis=1))
        if len(some):
            none = pa.nulls(len(some), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(some), types), none, pa.array(some.astype(np.int32)), none, none,
                pa.array(count[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(tidy(run), schema)


def _changes(rows: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(counts, sums) added up over all tasks; None if no vector moved."""
    deltas = rows.where("n is not null")
    found = (deltas.select("at", "n", F.posexplode("sums").alias("i", "x"))
             .groupBy("at", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())
    count, sums = np.zeros(k, object), np.zeros((k, width), object)
    for row in found:  # at most k x components
        count[row["at"]] = row["n"]
        sums[row["at"], row["i"]] = row["x"]
    return (count, sums) if found else None


@dataclass(frozen=True)
class Clusters:
    """``rows``: id, cluster, distance of each vector; ``centroids``: those of
    every round."""

    rows: DataFrame
    centroids: np.ndarray


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", plan: Plan = Plan()) -> Clusters | None:
    """None if no vector is kept."""
    if plan.rounds > 255:
        raise ValueError("a round is stored in a byte")
    vectors = prepared(df, key, vector, plan)
    first = first_centroids(vectors, plan)
    k = len(first)
    if not k:
        return None
    history = first[None]
    table = Stored(assigned(vectors, history, True), "centroids")
    count, sums = np.zeros(k, object), np.zeros((k, plan.components), object)
    for _ in range(plan.rounds):
        changes = _changes(table.rows, k, plan.components)
        if changes is None:
            break
        count, sums = count + changes[0], sums + changes[1]
        after = [[int(x) // int(n) for x in row] if n else old.tolist()
                 for row, n, old in zip(sums, count, history[-1])]
        history = np.concatenate([history, np.array(after, np.int64)[None]])
        before, table = table, Stored(assigned(table.rows.where("n is null"), history, False), "centroids")
        before.drop()
    last = history[-1]
    schema = T.StructType([table.rows.schema["id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])

    def distances(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            gap = _components(batch.column(1), last.shape[1]) - last[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(
                np.einsum("ij,ij->i", gap, gap))], names=schema.names)

    rows = Stored(table.rows.where("n is null").select("id", "v", "at").mapInArrow(tidy(distances), schema), "clusters")
    table.drop()
    return Clusters(rows.rows, history)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", plan: Plan = Plan()) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256 of each kept vector of ``df``."""
    found = fit(df, key, vector, plan)
    if found is None:
        spark = df.sparkSession
        return spark.createDataFrame([], T.StructType([df.schema[key]])).selectExpr(
            "*", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    total = {row["cluster"]: row["s"] for row in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    centres = found.centroids[-1].tolist()
    inertia = F.array(*[F.lit(int(total.get(j, 0))).cast("long") for j in range(len(centres))])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centres])
    return found.rows.select(
        F.col("id").alias(key), "cluster", "distance", F.get(inertia, "cluster").alias("cluster_inertia"),
        F.lit(int(sum(total.values()))).cast("long").alias("inertia"), F.get(digest, "cluster").alias("centroid_sha256"))
