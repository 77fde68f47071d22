"""SpotSigs against brute force."""

import hashlib
from bisect import bisect

import pytest

from mercato.llm import spotsigs
from mercato.llm.queries import op5_spotsigs

from .helpers import EDGE_ROWS, SF, documents, edge, empty, plain_words


def brute(text):
    words = plain_words(text)
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    if not words:
        return frozenset()
    found = {("^", *(words[i] for i in content[:2]))} if content else {("^", words[0], "bare")}
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            k = bisect(content, i)
            if k + 2 <= len(content):
                found.add((w, words[content[k]], words[content[k + 1]]))
    return frozenset(found)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(len(a) == len(b))


def check(rows, ordered):
    """``rows``: of the query; ``ordered``: (id, text) in the order of ids."""
    following = {i: t or "" for (i, _), (_, t) in zip(ordered, ordered[1:] + ordered[:1])}
    texts = {i: t or "" for i, t in ordered}
    assert len(rows) == len(ordered)
    for r in rows:
        text, after = texts[r.doc_id], following[r.doc_id]
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert len(spotsigs.unpacked(r.fingerprint)) == len(brute(text))
        assert len(spotsigs.unpacked(r.edited_fingerprint)) == len(brute(changed))
        assert abs(r.near_edited - jaccard(brute(text), brute(changed))) < 1e-9
        assert abs(r.near_next - jaccard(brute(text), brute(after))) < 1e-9


def test_query_equals_brute_force(spark):
    ordered = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    rows = op5_spotsigs(spark, SF).collect()
    check(rows, ordered)
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(ordered)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_tables_with_nulls(spark, n):
    texts = ["the cat sat on the mat", None, "", "the the the", "🙂 the été and more words", "!!!"]
    ordered = [(i * 7, texts[i % 6]) for i in range(n)]
    df = spark.createDataFrame(ordered, "doc_id long, text string").repartition(3)
    check(spotsigs.edits(df).collect(), ordered)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs_equal_all_pairs(spark, least):
    texts = {r.doc_id: r.text for r in documents(spark).limit(120).collect()}
    for i, t in list(texts.items())[:40]:
        w = t.split(" ")
        texts[1000 + i] = " ".join(w[:-(len(w) // (i % 7 + 2))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = spotsigs.fingerprints(df).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.fingerprint, r.doc_id)
    ids = sorted(first.values())
    sets = {i: brute(texts[i]) for i in ids}
    expected = {(a, b) for k, b in enumerate(ids) for a in ids[:k] if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= least}
    got = {(r.a, r.b): r.likeness for r in spotsigs.similar_pairs(spark.createDataFrame(rows), least).collect()}
    assert set(got) == expected
    assert all(abs(v - jaccard(sets[a], sets[b])) < 1e-9 for (a, b), v in got.items())


def test_edge_cases(spark):
    rows = spotsigs.edits(edge(spark)).collect()
    assert len(rows) == len(EDGE_ROWS)
    assert {r.near_next for r in rows if r.doc_id == 2} == {1.0}  # null before empty: both without a word
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {""}
    assert spotsigs.edits(empty(spark)).count() == 0
    df = spotsigs.fingerprints(edge(spark).withColumnRenamed("Text_", "FINGERPRINT"))
    assert df.count() == len(EDGE_ROWS) and [c.lower() for c in df.columns].count("fingerprint") == 1
    assert spotsigs.similar_pairs(spotsigs.fingerprints(empty(spark))).count() == 0
