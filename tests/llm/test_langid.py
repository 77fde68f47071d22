"""Language identification: counts by brute force, held-out accuracy."""

from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercato.llm import langid
from mercato.llm.bpe import LETTER, character_classes
from mercato.llm.queries import op6_langid

from .helpers import EDGE_ROWS, documents, edge, empty


@pytest.fixture(scope="module")
def letters():
    return character_classes() == LETTER


def brute(text, letters):
    counts = Counter()
    for word in "".join(c if letters[ord(c)] else " " for c in (text or "").lower()).split():
        counts.update(word)
        edged = f"_{word}_"
        for n in (2, 3):
            counts.update(edged[i:i + n] for i in range(len(edged) - n + 1))
    return counts


def packed(gram):
    number = 0
    for c in gram:
        number = number << 21 | (0x110000 if c == "_" else ord(c))
    return number


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_counts(letters, monkeypatch, piece):
    monkeypatch.setattr(langid, "_PIECE", piece)
    texts = ["Hello, wörld! a", "", None, "123", "x", " Élan é é  ", "ab cd " * 30, "漢字 kana", "tail"]
    got = defaultdict(dict)
    for text, gram, n in langid.gram_counts(pa.array(texts), letters):
        for i, g, k in zip(text.tolist(), gram.tolist(), n.tolist()):
            assert g not in got[i]
            got[i][g] = k
    for i, text in enumerate(texts):
        assert got[i] == {packed(g): k for g, k in brute(text, letters).items()}


def test_distance_is_the_sum_of_rank_differences(letters):
    profiles = langid.Profiles(["xx", "yy"], *_table([["a", "_a", "a_"], ["b", "_b", "b_"]], 3), 3)
    names, score = profiles.predict(pa.array(["a", "b b", "a b b", "?"]), letters)
    assert names == ["xx", "yy", "yy", "und"]
    # "a": its n-grams a, _a, a_ tie at one and rank by code points: a_ comes
    # after a, _a (the blank is the greatest code) after both
    assert score[3] == 0 and 0 < score[0] <= 1


def _table(profiles, size):
    import numpy as np
    grams = np.array(sorted({packed(g) for p in profiles for g in p}))
    ranks = np.full((len(profiles), len(grams)), size)
    for k, p in enumerate(profiles):
        for r, g in enumerate(p):
            ranks[k, np.searchsorted(grams, packed(g))] = r
    return grams, ranks


def test_held_out_accuracy(spark):
    rows = op6_langid(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[1] > 100 and held[0] > 0.98
    assert rows.where("score < 0 OR score > 1").count() == 0


def test_profiles_equal_brute_force(spark, letters):
    rows = documents(spark).limit(30).collect()
    docs = spark.createDataFrame(rows)
    got = {(r["lang"], r["gram"]): r["rank"] for r in langid.learn(docs, size=20).collect()}
    for lang in {r.lang for r in rows}:
        total = Counter()
        for r in rows:
            if r.lang == lang:
                total.update({packed(g): n for g, n in brute(r.text, letters).items()})
        best = sorted(total, key=lambda g: (-total[g], g))[:20]
        assert [got[lang, g] for g in best] == list(range(20))


def test_edge_cases(spark):
    learned = langid.Profiles.collect(langid.learn(edge(spark)))
    assert learned.languages == ["en", "fr"]  # a text without a letter teaches no language
    rows = langid.predict(edge(spark), learned, score="Score").collect()
    assert len(rows) == len(EDGE_ROWS)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.predict(empty(spark), learned).count() == 0
    nothing = langid.Profiles.collect(langid.learn(empty(spark)))
    assert {r.lang_pred for r in langid.predict(edge(spark), nothing).collect()} == {"und"}


def test_profiles_are_limited_before_the_shuffle(spark):
    plan = langid.learn(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
