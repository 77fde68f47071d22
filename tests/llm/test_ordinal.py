"""The ordinal classifier: features, thresholds, held-out accuracy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mercato.llm import ordinal
from mercato.llm.queries import op9_ordinal

from .helpers import EDGE_ROWS, SF, documents, edge, empty, plain_words


def test_word_features_are_presence():
    texts = ["Ab ab, cd", None, "", "###", "é É x"]
    text, place, value = ordinal.features(pa.array(texts))
    for i, t in enumerate(texts):
        words = (text == i) & (place < ordinal._WORDS)
        # only ASCII letters are put into lower case
        expected = {"".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()}
        expected = {w.strip(",#") for w in expected} - {""}
        assert words.sum() == len(expected) and (value[words] == 1).all()
        shapes = value[(text == i) & (place >= ordinal._WORDS)]
        assert np.isclose(shapes.sum(), ordinal._SHARE if (t or "").split() else 0)


def test_grades_are_ordered_and_learned(spark):
    rows = [(i, " ".join(["base"] * 3 + ["bad"] * (i % 3 == 0) + ["good"] * (i % 3 == 2) + [f"noise{i % 50}"]), i % 3)
            for i in range(600)]
    rated = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = ordinal.fit(rated, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.predict(rated, model, 2).groupBy("grade").agg(
        F.avg("expected_grade").alias("e"), F.avg("p_tail").alias("p")).orderBy("grade").collect()
    assert got[0].e < 0.5 < got[1].e < 1.5 < got[2].e
    assert got[0].p < 0.2 and got[2].p > 0.7
    again = ordinal.fit(rated.repartition(5), 3)
    assert np.allclose(model.thresholds, again.thresholds, atol=0.3)


def test_fit_sends_the_driver_the_chosen_features_alone(spark, monkeypatch):
    rows = [(i, " ".join(["base", "bad" if i % 3 == 0 else "good" if i % 3 == 2 else "so", f"noise{i % 50}"]), i % 3)
            for i in range(600)]
    rated = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    sent, collect = [], type(rated).collect

    def counted(self):
        out = collect(self)
        sent.append(sum(len(v) for r in out for v in r if isinstance(v, (bytes, bytearray))))
        return out

    monkeypatch.setattr(type(rated), "collect", counted)
    model = ordinal.fit(rated, 3)
    # 8 vectors of 2^18 numbers are 17 MB, the counts by grade 25 MB
    assert max(sent) < 100_000
    word = ordinal.features(pa.array(["bad"]))[1]
    assert model.weights.shape == (ordinal._DIM,) and model.weights[word[word < ordinal._WORDS]].item() < 0
    assert np.isfinite(model.weights).all() and 0 < np.count_nonzero(model.weights) < 100


def test_features_are_chosen_alike_in_ranges():
    rng = np.random.default_rng(3)
    rows, have = np.array([40, 60, 20]), np.zeros((3, ordinal._DIM))
    some = rng.choice(ordinal._DIM, 3000, replace=False)
    have[:, some] = rng.integers(0, rows[:, None] + 1, (3, 3000))
    edges = np.linspace(0, ordinal._DIM, 9).astype(int)
    parts = [ordinal._telling(have[:, a:b], rows, 20.0, int(a)) for a, b in zip(edges, edges[1:])]
    whole = ordinal._telling(have, rows, 20.0, 0)
    assert np.array_equal(np.concatenate(parts), whole)
    shapes = whole[whole >= ordinal._WORDS]
    assert set(shapes) == {p for p in some if p >= ordinal._WORDS and have[:, p].any()}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").select(
        "doc_id", "text", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = ordinal.fit(rated.where(~held), 3)
    got = {r.grade: r.kept for r in ordinal.predict(rated.where(held), model, 2).groupBy("grade").agg(
        F.avg((F.col("p_tail") >= 0.5).cast("double")).alias("kept")).collect()}
    assert got[2] > 0.98 and got[0] < 0.05 and got[1] < 0.45  # a fifth of the toxic labels mark plain texts


def test_query_keeps_every_row(spark):
    rows = op9_ordinal(spark, SF).collect()
    assert len(rows) == documents(spark).count()
    assert all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.p_tail >= 0.5) for r in rows)


def test_edge_cases(spark):
    model = ordinal.fit(edge(spark).withColumn("grade", F.when(F.col("doc_id") > 5, 1).when(F.col("doc_id") == 1, 0)), 2)
    rows = ordinal.predict(edge(spark).withColumnRenamed("Text_", "P_TAIL"), model, 1).collect()
    assert len(rows) == len(EDGE_ROWS)
    plain = [r.p_tail for r in rows if not plain_words(r.text) and not (r.text or "").strip()]
    assert len(set(plain)) == 1  # without features the thresholds alone decide
    assert ordinal.predict(empty(spark), model, 1).count() == 0
    nothing = ordinal.fit(edge(spark).withColumn("grade", F.lit(None).cast("int")), 3)
    assert (nothing.weights == 0).all() and nothing.thresholds.tolist() == [-1, 1]
