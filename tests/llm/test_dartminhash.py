"""DartMinHash: unbiased estimates, and classes equal to brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mercato.llm import dartminhash as dm
from mercato.llm.queries import op2_dartminhash

from .helpers import EDGE_ROWS, SF, documents, edge, empty, plain_words


def shingles(text, n=5):
    w = plain_words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset([("text", text or "")])


def brute_classes(texts, least=0.8):
    """{id: smallest id of its class} by all pairs and union-find."""
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("weights", [(1, 1), (3, 1), (0.25, 5.5)])
def test_signature_estimates_weighted_jaccard(weights):
    a = {i: weights[i % 2] for i in range(200)}
    b = {i: weights[(i // 2) % 2] for i in range(100, 260)}
    keys = [(0, i, w) for i, w in a.items()] + [(1, i, w) for i, w in b.items()]
    text, element, weight = (np.array(x) for x in zip(*keys))
    found = dm.signatures(2, text, element.astype(np.uint64) * np.uint64(977), weight.astype(float), 6000)
    assert (found != 0).all()
    low = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(260))
    high = sum(max(a.get(i, 0), b.get(i, 0)) for i in range(260))
    assert abs((found[0] == found[1]).mean() - low / high) < 0.03


def test_counted_sets_hold_counts():
    text, _, weight = dm.weighted_sets(pa.array(["a a a a a a a", "b", None]), dm.Plan(counted=True))
    assert text.tolist() == [0, 1] and weight.tolist() == [3.0, 1.0]


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = op2_dartminhash(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)
    assert len(rows) == len(texts) and all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_near_copies_and_a_chain(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(300)]
    texts = {100: " ".join(base)}
    for i in range(60):  # near copies of one text, of different similarity
        w = list(base)
        for _ in range(random.randint(1, 6)):
            w[random.randrange(300)] = f"new{i}"
        texts[i] = " ".join(w)
    w = list(base)
    for step in range(12):  # each like the one before
        for k in range(3):
            w[(step * 24 + k * 5) % 300] = f"step{step}"
        texts[200 + step] = " ".join(w)
    for i in range(300, 340):
        texts[i] = " ".join(random.choice(words) for _ in range(random.randint(1, 80)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in dm.near_duplicates(df).collect()}
    assert got == brute_classes(texts)


def test_a_family_over_one_passage(spark):
    """Pairs that are similar, among 1,200 texts that nearly are: all share a
    passage, and their common keys are those of the whole family."""
    passage = " ".join(f"p{i}" for i in range(194))
    texts = {}
    for i in range(1200):
        pair = " ".join(f"pair{i // 2}x{k}" for k in range(9))
        texts[i] = f"{passage} {pair} " + " ".join(f"own{i}x{k}" for k in range(24))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    expected = brute_classes(texts)
    assert len(set(expected.values())) == 600
    assert {r.doc_id: r.class_id for r in dm.near_duplicates(df).collect()} == expected


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200)], "a long, b long")
    assert {r.id: r.label for r in dm.components(links).collect()} == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100}


def test_edge_cases(spark):
    rows = dm.near_duplicates(edge(spark)).collect()
    assert len(rows) == len(EDGE_ROWS)
    got = {r.doc_id: (r.class_id, r.kept) for r in rows}
    assert got == {1: (1, True), 2: (2, True), 3: (2, False), 4: (4, True), 5: (5, True), 6: (6, True),
                   7: (7, True), 8: (7, False), None: (None, True), 9: (9, True)}
    assert dm.near_duplicates(empty(spark)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "u v w x y z"), (3, "u v w x y z"), (9, "a b c d e f")],
                               "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in dm.near_duplicates(df).collect()) == [(3, 3), (5, 3), (5, 3), (9, 3)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_texts_of_one_id_link_what_stands_for_them(spark, rounds):
    """An id that stands for none of its own texts, and a chain of such ids."""
    x, y = "a b c d e f", "u v w x y z"
    texts = [f"chain {i} of some words that repeat nowhere else{i}" for i in range(8)]
    rows = [(3, x), (5, x), (5, y), (2, y)]
    rows += [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i in range(7) for t in texts[i:i + 2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dm.near_duplicates(df, plan=dm.Plan(rounds=rounds)).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, 2 if i < 100 else 100) for i, _ in rows}
    assert {r.doc_id for r in got if r.kept} == {2, 100}


def test_the_exact_finish_alone_links_what_shares_a_band(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = dm.near_duplicates(documents(spark), plan=dm.Plan(rounds=0)).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)
