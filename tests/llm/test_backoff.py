"""Stupid backoff against brute force and SQL."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from mercato.llm import backoff
from mercato.llm.queries import ORACLE_SQL, op7_backoff

from oracle_compare import compare, duck
from .helpers import EDGE_ROWS, SF, edge, empty, plain_words


def brute(rows, alpha=0.4, least=2):
    words, pairs, starts = Counter(), Counter(), 0
    for _, text in rows:
        w = plain_words(text)
        words.update(w)
        pairs.update(zip(["<s>"] + w, w))
        starts += bool(w)
    total = sum(words.values())
    words["<s>"] = starts
    n, score = defaultdict(int), defaultdict(float)
    for key, text in rows:
        w = plain_words(text)
        n[key] += len(w)
        for a, b in zip(["<s>"] + w, w):
            score[key] += math.log(pairs[a, b] / words[a] if pairs[a, b] >= least else alpha * words[b] / total)
    return {k: (n[k], score[k]) for k in n}


def same(got, expected):
    assert set(got) == set(expected)
    for key, (n, score) in expected.items():
        assert got[key][0] == n and math.isclose(got[key][1], score, rel_tol=1e-9, abs_tol=1e-9)


def test_packed_columns():
    for a in (np.array([], np.int64), np.array([1, -5, 1 << 60]), np.array([7, 0], np.int32)):
        assert (backoff.unpack(backoff.pack(a), a.dtype) == a).all()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_skewed_words(spark, least):
    rows = [(i, f"hot hot word{i % 7} hot x{i} Tail{i % 3}!") for i in range(200)] + [(999, "hot"), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.log_score) for r in backoff.score(df, least=least).collect()}
    same(got, brute(rows, least=least))


def test_query_against_sql(spark):
    con = duck(SF)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ok, message = compare(op7_backoff(spark, SF), con, ORACLE_SQL["op7_backoff"])
    assert ok, message


def test_edge_cases(spark):
    rows = backoff.score(edge(spark)).collect()
    same({r.doc_id: (r.n_words, r.log_score) for r in rows}, brute([(r[0], r[1]) for r in EDGE_ROWS]))
    assert all((r.score is None) == (r.n_words == 0) for r in rows)
    assert backoff.score(empty(spark)).count() == 0
