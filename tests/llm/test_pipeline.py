"""The pipeline's stages and its run."""

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from mercato.llm import bpe
from mercato.llm.queries import VOCABULARY

from .helpers import SF, documents, edge, empty
from .test_dartminhash import brute_classes


def test_stages_in_order(spark):
    docs = documents(spark)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "encoding":
            assert docs.columns == columns
        if name == "near_dedup":
            assert sorted(kept[name]) == sorted(set(brute_classes(texts).values()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "mixing", "encoding"]
    assert set(kept["quality"]) < set(kept["language"]) and set(kept["near_dedup"]) <= set(kept["quality"])
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.limit(20).collect():
        assert r.token_ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids)


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = documents(spark).join(labels.where("quality = 1 AND toxic = 0"), "doc_id").select(documents(spark).columns)
    n = clean.count()
    for _, stage in corpus_pipeline.STAGES[:2]:
        clean = stage(spark, clean, SF)
    assert clean.count() >= 0.97 * n


def test_run_equals_its_stages_and_reruns_agree(spark):
    first = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(first) == sorted(corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect())
    assert first


def test_every_stage_takes_edge_cases_and_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (edge(spark), empty(spark)):
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns)
            rows = out.collect()
            assert len(rows) <= 3 * docs.count()


def test_near_dedup_and_mixing_count_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", "s")] * 4 + [(2, "g h i j k l", "s"), (3, "m n o p q r", "s"), (3, "s t u v w x", "s")]
    rows += [(None, "a b c d e f", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    once = corpus_pipeline.near_dedup(spark, docs, SF)
    expected = {1: 1, 2: 1, 3: 1, None: 2}
    assert Counter(r.doc_id for r in once.collect()) == expected
    assert Counter(r.doc_id for r in corpus_pipeline.mixing(spark, once, SF).collect()) == expected


def test_run_passes_stages_on_as_parquet(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.where("doc_id % 2 = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    n = corpus_pipeline.run(spark, SF).count()
    assert n == documents(spark).where("doc_id % 2 = 0").count()
    assert all(f.endswith(".parquet") for files in seen for f in files) and all(seen)
    assert not set(seen[0]) & set(seen[1]) and not set(seen[1]) & set(seen[2])
