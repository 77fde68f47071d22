"""Operator 13: documents linked by the Jaccard similarity of their n-grams.

A document's set holds its distinct runs of ``words`` words, as 64-bit hashes.
Equal sets are one node.  Two nodes link when 100 x intersection is at least
``percent`` x union; what a pair must share follows from its sizes, in whole
numbers.  The links are found by these steps, of which none loses a pair:

* Screen.  Under one order of all n-grams (that of the hash), the first
  x - ceil(p x) + m n-grams of two linked sets, their heads, have at least m in
  common, with the m of the smaller set.  A set whose head has fewer than m
  n-grams that other heads have, too, has no partner.  This leaves the near
  copies and the sets that mostly hold common passages; of the others, only the
  heads (a fifth of the n-grams at 90 percent) are ever shuffled.
* Prefixes.  The n-grams of the sets that are left are ordered from rare to
  frequent by their number of sets, counted over all of these; those in one
  set come first of all.  The first x - ceil(p x) + 1 are a set's prefix, and
  linked sets have a prefix n-gram in common.
* Hubs.  Sets of one prefix n-gram first meet the one that meets most others
  (the original among its copies), which joins most of a large family without
  its pairs.
* Join.  Then the prefixes meet, n-gram by n-gram, salted where one has many
  sets, for the pairs that are not in one component yet.  Pairs must pass the
  length filter (sizes), the positional filter (what can follow the common
  n-gram) and the suffix filter: the order of the hash is cut at fixed pivots
  into ``PARTS`` parts, and the differences of the parts' sizes add up to no
  more than the pair may differ by.
* Verification.  A pair found by several n-grams is one row; pairs the hubs
  have tested are taken out; the rest is tested exactly on whole sets, once.

Components are the links' connected components, by joins.

Cases: null and empty texts and texts without words have an empty set and link
with nothing; fewer words than ``words`` make one n-gram of them all; rows of
one id are one document, whose texts are joined; a row of a null id is in no
component (null) and links nothing; other columns are ignored; an empty table
gives an empty one; texts are read whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import binary_array, column, list_array, slices, tidy
from mercato.llm._links import components, links_of_one_id
from mercato.llm._store import Stored
from mercato.llm._words import SPACE, Words, chain

#: Parts of the suffix filter, a power of two.
PARTS = 32
#: Sets of an n-gram that one task joins with all others of it, and the most
#: tasks of an n-gram.
_SALT_ROWS, _SALTS = 512, 256


@dataclass(frozen=True)
class Plan:
    words: int = 3
    percent: int = 90


def _ceil_div(a, b: int):
    return -(-a // b)


def least_shared(size, plan: Plan):
    """What a set shares at least with any partner."""
    return _ceil_div(size * plan.percent, 100)


def margin(size, plan: Plan):
    """The screen's m: as many n-grams as a set may differ by."""
    return _ceil_div(size * (100 - plan.percent), 100)


def ngram_sets(texts: pa.Array, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, offsets) of all texts, ascending and distinct in each."""
    words = Words(pc.ascii_lower(texts.fill_null("")), SPACE)
    n = plan.words
    runs = chain(words.hash, n)
    whole = words.doc[:len(runs)] == words.doc[n - 1:] if len(runs) else np.zeros(0, bool)
    text, run = words.doc[:len(runs)][whole].astype(np.int64), runs[whole]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        text = np.concatenate([text, short])
        run = np.concatenate([run, [chain(words.hash[words.first[i]:words.first[i + 1]], count[i])[0] for i in short]])
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    if len(run):
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (run[1:] != run[:-1])])
        text, run = text[new], run[new]
    return run, np.searchsorted(text, np.arange(len(texts) + 1))


def _digests(run: np.ndarray, edge: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(run[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(edge.tolist(), edge[1:].tolist())]


def sketch(df: DataFrame, plan: Plan, text: str, key: str) -> DataFrame:
    """id, same (digest of the set, null if empty), size and, for the screen,
    its head, the first n-grams by hash, of each row."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("same", T.BinaryType()),
                           T.StructField("size", T.LongType()), T.StructField("head", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                ngrams, edge = ngram_sets(part, plan)
                size = np.diff(edge)
                head = np.minimum(size, size - least_shared(size, plan) + margin(size, plan))
                offsets = np.concatenate([[0], np.cumsum(head)])
                rows = np.repeat(edge[:-1] - offsets[:-1], head) + np.arange(offsets[-1])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), pa.array(_digests(ngrams, edge), pa.binary()),
                    pa.array(size.astype(np.int64)), list_array(offsets, pa.array(ngrams[rows].view(np.int64)))],
                    names=schema.names)
                at += len(part)

    return df.select(column(df, key), column(df, text)).mapInArrow(tidy(run), schema)


def screened(rows: DataFrame, plan: Plan) -> DataFrame:
    """Ids of the sets that may have a partner."""
    sets = (rows.where("size > 0 and id is not null").groupBy("same")
            .agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("head").alias("head")))
    least = F.ceil(F.col("size") * plan.percent / F.lit(100))
    m = F.ceil(least * (100 - plan.percent) / F.lit(100))
    heads = sets.select("id", m.alias("m"), F.explode("head").alias("ngram"))
    shared = heads.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ngram")
    met = heads.join(shared, "ngram").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m"))
    return met.where("n >= m").select("id")


def packed_sets(df: DataFrame, plan: Plan, text: str, key: str) -> DataFrame:
    """id, same, size, ngrams (binary) and the parts' sizes of each row with a set."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("same", T.BinaryType()),
                           T.StructField("size", T.LongType()), T.StructField("ngrams", T.BinaryType()),
                           T.StructField("parts", T.ArrayType(T.IntegerType()))])
    shift = np.uint64(64 - (PARTS.bit_length() - 1))

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                n = len(part)
                ngrams, edge = ngram_sets(part, plan)
                cell = np.repeat(np.arange(n), np.diff(edge)) * PARTS + (ngrams >> shift).astype(np.int64)
                parts = np.bincount(cell, minlength=n * PARTS).astype(np.int32)
                made = pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array(_digests(ngrams, edge), pa.binary()),
                    pa.array(np.diff(edge).astype(np.int64)),
                    binary_array([ngrams[a:b].tobytes() for a, b in zip(edge.tolist(), edge[1:].tolist())]),
                    list_array(np.arange(n + 1) * PARTS, pa.array(parts))], names=schema.names)
                yield made.filter(pc.is_valid(made.column(1)))
                at += n

    return df.select(column(df, key), column(df, text)).mapInArrow(tidy(run), schema)


def _exploded(sets: DataFrame) -> DataFrame:
    """node, size, ngram, one row each."""
    schema = "node long, size long, ngram long"

    def run(batches):
        for batch in batches:
            for node, size, ngrams in zip(*batch.columns):
                ngram = np.frombuffer(ngrams.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ngram), node.as_py())), pa.array(np.full(len(ngram), size.as_py())),
                    pa.array(ngram)], names=["node", "size", "ngram"])

    return sets.select("node", "size", "ngrams").mapInArrow(tidy(run), schema)


def prefixes(sets: DataFrame, plan: Plan) -> DataFrame:
    """ngram, node, size, place: the n-grams of each set's prefix that other
    sets have too; place: how many of the set come before, in the order from
    rare to frequent."""
    ngrams = _exploded(sets)
    counts = ngrams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = ngrams.join(counts, "ngram")
    ordered = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("ngram"))
    # places are counted from the end: those in one set, which come first, are not here
    behind = shared.withColumn("behind", F.row_number().over(ordered))
    place = (F.col("size") - F.col("behind")).alias("place")
    least = F.ceil(F.col("size") * plan.percent / F.lit(100))
    return behind.select("ngram", "node", "size", place).where(F.col("place") <= F.col("size") - least)


def _least_overlap(plan: Plan) -> Column:
    return F.ceil((F.col("size") + F.col("size_y")) * plan.percent / F.lit(100 + plan.percent))


def _may_link(plan: Plan) -> Column:
    """Length and positional filters of two postings of one n-gram."""
    least = _least_overlap(plan)
    return ((F.least("size", "size_y") >= F.ceil(F.greatest("size", "size_y") * plan.percent / F.lit(100)))
            & (F.col("size") - F.col("place") >= least) & (F.col("size_y") - F.col("place_y") >= least))


def hub_pairs(postings: DataFrame, plan: Plan) -> DataFrame:
    """Distinct pairs (a < b) of a node with the hub of one of its n-grams."""
    lists = postings.groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = postings.join(lists, "ngram")
    met = listed.groupBy("node").agg(F.sum("n").alias("met"))
    hub = F.max_by(F.struct("node", "size", "place"), F.struct("met", F.xxhash64("node")))
    hubs = (postings.join(met, "node").groupBy("ngram").agg(hub.alias("h"))
            .select("ngram", F.col("h.node").alias("node_y"), F.col("h.size").alias("size_y"),
                    F.col("h.place").alias("place_y")))
    return (postings.join(hubs, "ngram").where((F.col("node") != F.col("node_y")) & _may_link(plan))
            .select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct())


def open_pairs(postings: DataFrame, labels: DataFrame, parts: DataFrame, plan: Plan) -> DataFrame:
    """Distinct pairs (a < b) of nodes of different labels that have a prefix
    n-gram in common and pass the filters."""
    known = (postings.join(labels.toDF("node", "label"), "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    lists = (known.groupBy("ngram").agg(F.min("label").alias("l"), F.max("label").alias("h"),
                                        F.count(F.lit(1)).alias("n")).where("l <> h"))
    salts = F.least(F.floor(F.col("n") / _SALT_ROWS) + 1, F.lit(_SALTS)).cast("int")
    rows = known.join(lists.select("ngram", salts.alias("salts")), "ngram").join(parts, "node")
    columns = ["node", "label", "size", "place", "parts"]
    left = rows.select("ngram", *columns, F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    right = rows.select("ngram", *[F.col(c).alias(f"{c}_y") for c in columns],
                        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    differ = reduce(add, [F.abs(F.get("parts", F.lit(i)) - F.get("parts_y", F.lit(i))) for i in range(PARTS)])
    once = (F.col("size") < F.col("size_y")) | ((F.col("size") == F.col("size_y")) & (F.col("node") < F.col("node_y")))
    same = (F.col("l.ngram") == F.col("r.ngram")) & (F.col("l.salt") == F.col("r.salt"))
    return (left.alias("l").join(right.alias("r"), same & (F.col("label") != F.col("label_y")) & once & _may_link(plan)
                                 & (differ <= F.col("size") + F.col("size_y") - 2 * _least_overlap(plan)))
            .select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    packed = sets.select("node", "ngrams")
    both = pairs.join(packed.toDF("a", "x"), "a").join(packed.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(s.as_py(), "<u8") for s in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= plan.percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def join(df: DataFrame, text: str = "text", key: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """key, n_shingles and component_id for each row of ``df``."""
    rows = Stored(sketch(df, plan, text, key), "sketch")
    # of stored rows Spark knows the size, and does not shuffle the texts where they are few
    ids = Stored(screened(rows.rows, plan), "ids")
    reps = (rows.rows.where("size > 0 and id is not null").select("same", "id")
            .groupBy("same").agg(F.min("id").alias("rep")))
    known = Stored(rows.rows.select("id", "same", "size").join(reps, "same", "left")
                   .select("id", "size", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "rows")
    rows.drop()
    texts = df.select(column(df, key).alias("id"), column(df, text).alias("text"))
    found = packed_sets(texts.join(ids.rows, "id", "left_semi"), plan, "text", "id")
    sets = Stored(found.groupBy("same").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in (
        "size", "ngrams", "parts")]).drop("same").withColumn("node", F.monotonically_increasing_id()), "sets")
    postings = Stored(prefixes(sets.rows, plan), "postings")
    tried = Stored(hub_pairs(postings.rows, plan), "pairs")
    links = Stored(verified(tried.rows, sets.rows, plan), "links")
    labels = components(links.rows)
    rest = open_pairs(postings.rows, labels.rows, sets.rows.select("node", "parts"), plan)
    more = Stored(verified(rest.join(tried.rows, ["a", "b"], "left_anti"), sets.rows, plan), "links")
    # from nodes to the smallest ids of their sets
    named = sets.rows.select("node", "id")
    between = (links.rows.union(more.rows).join(named.toDF("a", "id_a"), "a").join(named.toDF("b", "id_b"), "b")
               .where("id_a <> id_b").select("id_a", "id_b").toDF("a", "b"))
    one_id = links_of_one_id(known.rows.where("id is not null").select("id", "rep"))
    final = components(between.union(one_id))
    for table in (ids, sets, postings, tried, links, labels, more):
        table.drop()
    return (known.rows.join(final.rows.toDF("rep", "label"), "rep", "left")
            .select(F.col("id").alias(key), F.col("size").alias("n_shingles"),
                    F.coalesce("label", "rep").alias("component_id")))
