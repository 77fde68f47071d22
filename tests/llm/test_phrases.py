"""Collocations against SQL and brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mercato.llm import phrases
from mercato.llm._store import Stored
from mercato.llm.queries import ORACLE_SQL, op12_phrases, phrases_sql

from oracle_compare import compare, duck
from .helpers import EDGE_ROWS, SF, documents, edge, empty


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, least, top=2000, most=5):
    """Sorted result rows of (text, lang) rows; a candidate is compared with
    every longer one."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    inside = {(lang, p[i:i + k], a) for (lang, p), a in candidates.items()
              for k in range(2, len(p)) for i in range(len(p) - k + 1)}
    out = []
    for lang in n:
        scored = []
        for (l2, p), a in candidates.items():
            if l2 == lang and not any((lang, p, b) in inside for b in [a]):
                score, _, left, right = min(
                    (1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                    for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(df, plan):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mine(df, plan=plan).collect())


def texts(seed=1, n=300):
    rng = random.Random(seed)
    words = ["New", "york", "city", "is", "of", "THE", "a", "état", "x1", "(y)"]
    out = []
    for i in range(n):
        w = [rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randint(0, 40))]
        w += ["once upon a time there"] * (i % 3 == 0) + ["a a a a a a"] * (i % 10 == 0)
        out.append((i, " ".join(w), rng.choice(["en", "en", "de", None, "und"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_query_against_sql(spark):
    con = duck(SF)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ok, message = compare(op12_phrases(spark, SF), con, ORACLE_SQL["op12_phrases"])
    assert ok, message


def test_more_phrases_against_sql(spark):
    con = duck(SF)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = phrases.mine(documents(spark), plan=phrases.Plan(least=7, top=900))
    ok, message = compare(got, con, phrases_sql(7, 900))
    assert ok, message
    assert got.count() > 400


@pytest.mark.parametrize("plan", [
    phrases.Plan(least=9, top=20), phrases.Plan(least=5, share=10 ** 9), phrases.Plan(least=5, share=40, slack=1, filter_words=64)])
def test_any_sample_gives_the_same(spark, plan):
    """None, all, and little of the documents; a filter too small to hold the phrases."""
    rows = texts()
    assert found(frame(spark, rows), plan) == brute([r[1:] for r in rows], plan.least, plan.top)


def test_border_failures_are_expanded(spark):
    rows = [(i, "Aa bb cc dd ee. aa zz", "en") for i in range(30)] + [(100 + i, f"u{i} v{i}", "en") for i in range(50)]
    docs = frame(spark, rows).select("text", "lang")
    plan = phrases.Plan(least=20, share=1, slack=1)
    nothing, rare = docs.limit(0), docs.where("text like 'u%'")
    for sample, passes in ((docs, 1), (rare, 5), (nothing, 5)):
        got = phrases.frequent(docs, Stored(sample).rows, plan)
        assert got.passes == passes
        # 6 words, 5 pairs, 3 + 2 + 1 longer phrases, 1 language
        assert got.counts.count() == 6 + 5 + 3 + 2 + 1 + 1
        assert sorted(r.n for r in got.counts.collect()) == sorted([60] + [30] * 16 + [30 * 7 + 100])


def test_phrases_end_at_pieces():
    grams = phrases.Grams(pa.array(["a b, c d", "A  b\tc\x0bd", None]), pa.array(["en", "en", None]), 3)
    assert [int(x.sum()) for x in grams.whole[1:]] == [8, 4, 1]
    first, second = grams.keys[2][[0, 4]]
    assert first == second and set((grams.keys[2] & np.uint64(7)).tolist()) == {2}


def test_filter_holds_what_was_added(spark):
    keys = [2 ** 62 + 9, 5, -7, 12345678901]
    f = phrases.Filter.none(phrases.Plan()).plus(spark.createDataFrame([(k,) for k in keys], "h long"))
    assert f.has(np.array(keys, np.int64).view(np.uint64)).all()
    rng = np.random.default_rng(1)
    assert f.has(rng.integers(0, 2 ** 63, 10_000).astype(np.uint64)).sum() <= 1


def test_edge_cases(spark):
    rows = [(r[1], r[2]) for r in EDGE_ROWS]
    for least in (1, 2):
        assert found(edge(spark), phrases.Plan(least=least)) == brute(rows, least)
    assert phrases.mine(empty(spark)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.mine(empty(spark)).count() == 0
