"""N-gram Jaccard join against all pairs and union-find."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mercato.llm import ngramjoin as nj
from mercato.llm._links import components, links_of_one_id
from mercato.llm.queries import op13_ngramjoin

from .helpers import EDGE_ROWS, SF, documents, edge, empty, space_words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=3):
    w = space_words(lower(text))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=3, percent=90):
    """Sorted [(id, size, component)] of (id, text) rows by all pairs."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = sorted({(i, shingles(t, n)) for i, t in rows if i is not None}, key=lambda x: x[0])
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(shingles(t, n)), None if i is None else find(i)) for i, t in rows), key=str)


def found(df, plan=nj.Plan()):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, plan=plan).collect()), key=str)


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op13_ngramjoin(spark, SF).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("percent,n", [(90, 3), (60, 2)])
def test_families(spark, percent, n):
    """Copies with different numbers of edits, chains, and texts over one
    passage, some of them above the threshold and some below."""
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(250)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(250)] = f"new{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    w = list(base)
    for step in range(15):
        for k in range(2):
            w[(step * 24 + k * 5) % 250] = f"step{step}"
        rows.append((200 + step, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(80):
        rows.append((300 + i, passage + " " + " ".join(f"own{i // 2}x{k}" for k in range(rng.randint(1, 12)))))
    for i in range(100):
        rows.append((400 + i, " ".join(rng.choice(words[:4]) for _ in range(rng.randint(1, 9)))))
    plan = nj.Plan(words=n, percent=percent)
    assert found(frame(spark, rows), plan) == brute(rows, n, percent)


def test_many_texts_below_the_threshold_over_one_passage(spark):
    passage = " ".join(f"p{i}" for i in range(160))
    rows = []
    for i in range(900):
        pair = " ".join(f"pair{i // 2}x{k}" for k in range(9))
        rows.append((i, f"{passage} {pair} " + " ".join(f"own{i}x{k}" for k in range(8))))
    expected = brute(rows)
    assert len({c for _, _, c in expected}) == 450
    assert found(frame(spark, rows)) == expected


def test_screen_keeps_every_set_with_a_partner(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        w = [f"t{rng.randrange(10 ** 6)}" for _ in range(rng.randint(3, 300))]
        rows.append((2 * i, " ".join(w)))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
            rows.append((2 * i + 1, " ".join(w)))
    df = frame(spark, rows)
    kept = {r.id for r in nj.screened(nj.sketch(df, nj.Plan(), "text", "doc_id"), nj.Plan()).collect()}
    linked = {i for i, _, c in brute(rows) for j, _, d in brute(rows) if i != j and c == d}
    assert linked <= kept and len(kept) <= 100  # 100 of 200 have a copy with a change


def test_suffix_parts_never_lose_a_pair():
    a = pa.array([" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(6, 206))])
    ngrams, offsets = nj.ngram_sets(a, nj.Plan())
    x, y = (ngrams[p:q] for p, q in zip(offsets, offsets[1:]))
    parts = [np.bincount((s >> np.uint64(59)).astype(int), minlength=32) for s in (x, y)]
    assert np.abs(parts[0] - parts[1]).sum() <= len(np.setxor1d(x, y))


def test_rows_of_one_id_and_the_exact_threshold(spark):
    """Rows of one id are one document.  Of 21 words, 19 n-grams: 18 of 20 in
    common is 90 percent, 17 of 21 is not."""
    x, y, z = ("a b c d e f g", "t u v w x y z", "one two three")
    base = [f"a{i}" for i in range(21)]
    rows = [(3, x), (5, x), (5, y), (2, y), (9, z), (9, None), (4, None), (4, z), (None, x), (8, "Q"), (7, "q"),
            (21, " ".join(base)), (22, " ".join(base[:20] + ["x"])), (23, " ".join(base[:19] + ["y", "z"]))]
    got = found(frame(spark, rows))
    assert got == brute(rows)
    of = {i: c for i, _, c in got}
    assert of[2] == of[3] == of[5] == 2 and of[4] == of[9] == 4
    assert (of[21], of[22], of[23]) == (21, 21, 23)


def test_links_of_one_id(spark):
    rows = spark.createDataFrame([(5, 3), (5, 2), (5, 4), (6, 6), (7, 1), (7, 1), (None, 1)], "id long, rep long")
    assert sorted((r.a, r.b) for r in links_of_one_id(rows.where("id is not null")).collect()) == [(2, 3), (2, 4)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(200, 100)], "a long, b long")
    got = {r.id: r.label for r in components(links).rows.collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100}


def test_edge_cases(spark):
    assert found(edge(spark)) == brute([(r[0], r[1]) for r in EDGE_ROWS])
    assert nj.join(empty(spark)).columns == ["doc_id", "n_shingles", "component_id"]
    assert nj.join(empty(spark)).count() == 0
