"""K-means with ns-bounds: equal to SQL and to plain rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from mercato.llm import nsbounds
from mercato.llm.queries import ORACLE_SQL, op11_nsbounds

from oracle_compare import compare, duck
from .helpers import SF


def brute(rows, k, rounds, seed=3, scale=1024):
    """[(id, cluster, distance)] and the centroids, by plain Lloyd rounds."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    order = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v)
                   for i, v in kept)
    centres = [v for _, _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[0]].append(v)
        centres = [tuple(sum(x) // len(g) for x in zip(*g)) if g else c for g, c in zip(groups, centres)]
    return [(i, *nearest(v)) for i, v in kept], centres


def test_query_against_sql(spark):
    con = duck(SF)
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    ok, message = compare(op11_nsbounds(spark, SF), con, ORACLE_SQL["op11_nsbounds"])
    assert ok, message


@pytest.mark.parametrize("k,rounds", [(1, 3), (5, 10), (9, 4)])
def test_rounds_equal_plain_rounds(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 4) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(200)]  # a vector a third of the rows have
    rows += [(None, [0.1, 0.2, 0.3, 0.4])] * 2
    plan = nsbounds.Plan(components=4, k=k, rounds=rounds)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in nsbounds.cluster(df, plan=plan).collect()),
                 key=str)
    expected, centres = brute(rows, k, rounds)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert got == sorted(((i, j, d, digests[j]) for i, j, d in expected), key=str)


def test_bounds_save_work_and_use_total_displacement():
    rng = np.random.default_rng(1)
    centres = rng.integers(-40_000, 40_000, (8, 16))
    v = (centres[rng.integers(0, 8, 3000)] + rng.integers(-900, 900, (3000, 16))).astype(np.int64)
    there, back = centres + 15_000, centres  # away and back again: no displacement in total
    history, at, work = centres[None], None, []
    seen, when = np.zeros((3000, 8)), np.zeros((3000, 8), np.uint8)
    for after in (None, there, back):
        history = history if after is None else np.concatenate([history, after[None]])
        at, n = nsbounds.reassign(v, history, at, seen, when)
        gap = v[:, None] - history[-1][None]
        assert (at == (gap ** 2).sum(axis=2).argmin(axis=1)).all()
        work.append(n)
    assert work[0] == 24_000
    # one round's step does not add up with the other's
    assert work[2] < work[0] / 2
    before = seen.copy()
    history = np.concatenate([history, back[None]])
    _, n = nsbounds.reassign(v, history, at, seen, when)
    assert n == 0 and (seen == before).all()


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2 * 2), 0.0]) for i in range(6)] + [(9, [1.0, 0.0])]
    plan = nsbounds.Plan(components=2, k=3, rounds=3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.cluster, r.distance) for r in nsbounds.cluster(df, plan=plan).collect())
    assert got == sorted(brute(rows, 3, 3)[0])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "x", 1), (1, [1.0, 2.0], "x", 1), (2, None, None, 2), (3, [1.0], "y", 3), (4, [nan, 1.0], None, 4),
            (5, [1.0, inf], None, 5), (6, [None, 1.0], None, 6), (None, [-1.0, -0.0001], None, None), (7, [], None, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    plan = nsbounds.Plan(components=2, rounds=2)
    got = sorted(((r.vec_id, r.cluster, r.distance, r.inertia) for r in nsbounds.cluster(df, plan=plan).collect()), key=str)
    assert got == [(1, 0, 0, 0), (1, 0, 0, 0), (None, 2, 0, 0)]
    for none in (df.limit(0), df.where("vec_id = 3")):
        found = nsbounds.cluster(none, plan=plan)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert found.count() == 0
    with pytest.raises(Exception, match="beyond"):
        nsbounds.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<float>"), plan=plan)
    strings = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "name string, `v.x` array<double>")
    assert nsbounds.cluster(strings, "name", "v.x", plan).count() == 2
