"""Small inputs that the tests of the corpus operators share."""

import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text_ string, score double"

LONG = " ".join(f"word{i % 997} the" for i in range(30_000))

#: Nulls in every column, empty and very long texts, ties, repeated rows.
EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5, "x", 0.5),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5, "x", 0.5),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "", 0.0),
    (4, " \t\n ", "de", "b", 3, None, 1.0),
    (5, "!!! ### 12 34", "fr", None, 3, None, None),
    (6, LONG, "en", "a", len(LONG), None, None),
    (7, "Élan vital où ça, naïveté", "fr", "é", 3, None, None),
    (8, "Élan vital où ça, naïveté", None, "é", 3, None, None),
    (None, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1, None, None),
    (9, "x" * 50_000, "en", "b", 50_000, None, None),
]


def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_words(text):
    """Runs of letters and digits in lower case; other than ASCII counts."""
    return [w for w in re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", (text or "").lower()).split(" ") if w]


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
