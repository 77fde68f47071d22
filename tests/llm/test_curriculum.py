"""Curriculum mixing against brute force."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mercato.llm import curriculum
from mercato.llm.queries import op4_curriculum

from .helpers import EDGE_ROWS, documents, edge, empty, space_words

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """By sharing again and again; ``sizes``: source to size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    held = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        open_ = sum(weight[s] for s in names if s not in held)
        level = rest / open_ if open_ else 0
        more = {s for s in names if s not in held and level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in held else level * weight[s] for s in names}
        held |= more


@pytest.mark.parametrize("sizes", [
    {"a": 100}, {"a": 1, "b": 1000, "c": 10, "d": 5}, {"a": 0, "b": 7}, {"z": 3, "Z": 4, "é": 900, None: 50, "": 2},
    {f"s{i}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in curriculum.targets(df).collect()}
    expected = brute_targets(sizes)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


@pytest.mark.parametrize("schedule", curriculum.SCHEDULES)
def test_position_inverts_the_integral(spark, schedule):
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(
        curriculum.position(F.col("s"), schedule).alias("t")).collect()

    def integral(t):
        area = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return area

    for s, r in zip(shares, got):
        assert abs(integral(r.t) / integral(1.0) - s) < 1e-9


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op4_curriculum(spark, SF).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(by_id)
    total, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        r = by_id[d.doc_id]
        assert r["size"] == len(space_words(d.text)) and 0 <= r.taken <= 3 * r["size"]
        total[d.source] += r["size"]
        taken[d.source] += r.taken
        largest[d.source] = max(largest[d.source], r["size"])
    expected = brute_targets(total)
    for d in docs:
        assert by_id[d.doc_id].source_size == total[d.source]
        assert abs(by_id[d.doc_id].target - expected[d.source]) < 1e-6
    for s in total:
        assert abs(taken[s] - expected[s]) <= largest[s] / 2 + 1e-6
    again = {r.doc_id: (r.taken, r.position) for r in op4_curriculum(spark, SF).collect()}
    assert again == {i: (r.taken, r.position) for i, r in by_id.items()}


def test_mix_repeats_rows_in_the_order_of_positions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r.doc_id: r.copies for r in curriculum.plan(docs).collect()}
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns
    found = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        found[r.doc_id] += 1
    assert {i: n for i, n in copies.items() if n} == found
    plan = curriculum.plan(docs).where("copies > 0").collect()
    assert all(list(r.positions) == sorted(r.positions) and 0 <= r.positions[0] <= r.positions[-1] <= 1 for r in plan)
    first = [r.positions[0] for r in plan]
    assert first == sorted(first)


def test_the_curriculum_shifts_sources(spark):
    plan = curriculum.plan(spark.read.parquet(f"{SF}/documents.parquet")).where("copies > 0")
    early = {r.source: r.p for r in plan.select("source", F.explode("positions").alias("p"))
             .groupBy("source").agg(F.avg("p").alias("p")).collect()}
    names = sorted(early)
    heavy, light = ([early[s] for k, s in enumerate(names) if k % 3 == turn] for turn in (0, 2))
    assert sum(heavy) / len(heavy) < 0.46 and sum(light) / len(light) > 0.6


def test_no_python_in_the_plan(spark):
    plan = curriculum.plan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_cases(spark):
    rows = curriculum.plan(edge(spark)).collect()
    assert len(rows) == len(EDGE_ROWS)
    sizes = defaultdict(int)
    for row in EDGE_ROWS:
        sizes[row[3]] += len(space_words(row[1]))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - brute_targets(sizes)[r.source]) < 1e-6
    mixed = curriculum.mix(edge(spark))
    assert mixed.columns == edge(spark).columns
    assert mixed.where("doc_id IS NULL").count() == 0
    assert curriculum.plan(empty(spark)).count() == 0 and curriculum.mix(empty(spark)).count() == 0


def test_rows_of_repeated_and_null_ids_are_copied_by_themselves(spark):
    rows = [(i, f"a{i} b c d", "s") for i in range(20)]
    rows += [(100, "one two three four", "s")] * 5 + [(None, f"null {i} x y", "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = Counter(r.doc_id for r in curriculum.mix(docs, nulls=True).collect())
    # one source, whose target is its size: each row once
    assert found == Counter(r[0] for r in rows)
    assert Counter(r.doc_id for r in curriculum.mix(docs).collect()) == Counter(r[0] for r in rows if r[0] is not None)
