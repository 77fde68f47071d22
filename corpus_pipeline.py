"""The training-data pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  Models (language profiles, quality weights) are learned from the tables
under ``sf_dir``; everything else from ``docs``.  All stages but the last
return the columns of the documents.

Defined cases, besides those of the operators: a document whose id is null
passes the filters by its text alone, is never a near-duplicate, and is mixed
as any other.  Rows of one id are one document, of which near_dedup keeps the
row of the smallest hash.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import bpe, curriculum, dartminhash, langid, ordinal
from mercato.llm._arrow import column
from mercato.llm._store import checkpointed, new_path
from mercato.llm.queries import (GRADES, LEAST_P, VOCABULARY, learned_profiles, quality_model, table)

#: A text less in place than this in its best language has none.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a recognised language."""
    names = docs.columns
    found = langid.predict(docs, learned_profiles(spark, sf_dir), lang_pred="__lang", score="__score")
    return found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(
        *[column(found, c) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are likelier than not of the best grade."""
    names = docs.columns
    graded = ordinal.predict(docs, quality_model(spark, sf_dir), GRADES - 1,
                             expected="__expected", tail="__tail")
    return graded.where(F.col("__tail") >= LEAST_P).select(*[column(graded, c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, and one row of it."""
    judged = dartminhash.near_duplicates(docs).where("doc_id IS NOT NULL")
    marks = checkpointed(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1 OR NOT kept").select(F.col("doc_id").alias("__id"), "kept"))
    same = column(docs, "doc_id") == F.col("__id")
    names = [column(docs, c) for c in docs.columns]
    once = docs.join(marks, same, "left_anti").select(*names)
    again = docs.join(marks.where("kept"), same, "left_semi").select(*names)
    row = F.struct(*[column(again, c) for c in docs.columns])
    first = (again.groupBy(column(again, "doc_id").alias("__id"))
             .agg(F.min_by(row, F.xxhash64(row)).alias("__row")).select("__row.*"))
    return once.unionByName(first)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to meet the sources' targets, in the
    order of training."""
    return curriculum.mix(docs, nulls=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and their number."""
    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode(docs, vocabulary).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("quality", quality), ("near_dedup", near_dedup),
    ("mixing", mixing), ("encoding", encoding),
]

#: None: SQL cannot express a stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
