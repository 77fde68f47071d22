"""Decision lists: statistics by brute force, and what is learned."""

import re
from collections import Counter

from pyspark.sql import functions as F

from mercato.llm import decisions
from mercato.llm.decisions import Condition
from mercato.llm.queries import op3_decisions

from .helpers import EDGE_ROWS, SF, documents, edge, empty, space_words


def brute(text):
    text = text or ""
    words = space_words(text)
    lines = [x for x in text.split("\n") if space_words(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_query_statistics(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = op3_decisions(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, _, _, _, repeated = expected = brute(texts[r.doc_id])
        assert tuple(r[c] for c in NAMES) == expected
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (r.base_failed and r.kept)


def test_repeats_and_overlaps(spark):
    texts = ["a " * 30, "a b c d e f g h " * 3, "a b c d e f g h x a b c d e f g h", "1 2 3 4 5 6 7",
             "1 2 3 4 5 6 7 8", "p q r s t u v w z p q r s t u v w p", "é 😀 ü\né 😀 ü\n \n \n", "l\nl\r\nl\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in decisions.statistics(df).collect():
        assert tuple(r[c] for c in NAMES) == brute(texts[r.doc_id])


def test_learned_list_separates(spark):
    rows = [(float(i % 100) / 100, float(i // 100) / 50, i % 100 >= 80 or (i // 100 >= 45 and i % 100 < 40))
            for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, bad boolean")
    rules = decisions.learn(df, features=["a", "b"])
    assert 1 <= len(rules) <= 8
    judged = df.withColumn("kept", decisions.verdict(rules))
    wrong = judged.where("kept = bad").count()
    assert wrong < 150
    assert judged.where("NOT bad AND NOT kept").count() < 60


def test_verdict_is_an_ordered_expression(spark):
    rules = [(Condition("a", True, 2.0), Condition("a", False, 3.0)), (Condition("a", True, 9.0),)]
    got = spark.range(12).select(F.col("id").cast("double").alias("a")).select("a", decisions.verdict(rules).alias("k"))
    assert [r.a for r in got.collect() if not r.k] == [2.0, 9.0, 10.0, 11.0]
    assert str(rules[1][0]) == "a >= 9"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") == 0).alias("bad"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    judged, rules = decisions.judge(docs, labels.where(~held))
    got = {r.bad: r.kept for r in judged.where("NOT base_failed").join(labels.where(held), "doc_id").groupBy("bad").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rules and got[False] > 0.99 and got[True] < 0.2


def test_no_python_in_the_plan(spark):
    plan = decisions.statistics(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, True), (1, True), (6, False), (2, None), (None, True)], "doc_id long, bad boolean")
    judged, rules = decisions.judge(edge(spark), labels)
    rows = judged.collect()
    assert len(rows) == len(EDGE_ROWS) and rules == []
    assert {r.doc_id for r in rows if r.kept} == {6} - {r.doc_id for r in rows if r.base_failed}
    judged, rules = decisions.judge(empty(spark), labels)
    assert judged.count() == 0 and rules == []
