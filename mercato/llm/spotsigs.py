"""Operator 5: document fingerprints by SpotSigs.

A spot is an occurrence of an anchor, a very common word; its signature is the
anchor with the chain of the content words that follow it (two, next to each
other).  The text's beginning is an anchor too, so a text with a word has a
signature.  The fingerprint is the set of signatures, as 32-bit hashes in
ascending order, base64-coded: equal texts have equal fingerprints, and edits
change the signatures near them only.  The likeness of two fingerprints is the
Jaccard similarity of their sets.

``similar_pairs`` finds all pairs above a likeness: fingerprints are put into
partitions by set length, such that a pair lies in one or in neighbours, and
meet there by their rarest signatures only, as many as the likeness leaves
room for; what meets is compared if its lengths allow the likeness.

Words are runs of letters and digits, lower-cased.  Cases: a null or empty
text, or one without a word, has the empty fingerprint; two empty ones have
likeness 1, an empty and another 0; texts are read whole; rows of equal keys
follow each other in the order of their texts, rows of a null key come first;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mercato.llm._arrow import SLICE_BYTES, append_columns, column, slices, tidy
from mercato.llm._words import NOT_ALNUM, Words, mix

#: Content words in a chain.
CHAIN = 2

#: Very common words of English, German, French and Spanish.
ANCHORS = """
    a an and are as at be by for from had has have he her his in is it its not of on or she that the
    their there they this to was were which with you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es
    für im in ist mit nach nicht oder sich sie sind um und von vor war wie wird zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas
    plus pour qui que se son sur un une vous
    al como con de del el ella en es esta este la las lo los más no o para pero por que se ser sin
    su sus un una y
""".split()

_START = np.uint64(0x5BD1E9955BD1E995)


def _anchor_hashes() -> np.ndarray:
    return np.unique(Words(pa.array([" ".join(ANCHORS)]), NOT_ALNUM).hash)


def spots(texts: pa.Array, anchors: np.ndarray) -> list[np.ndarray]:
    """The distinct signatures of each text, ascending 32-bit numbers."""
    words = Words(pc.utf8_lower(texts.fill_null("")), NOT_ALNUM)
    n = len(texts)
    if not len(words.hash):
        return [np.zeros(0, np.uint32)] * n
    at = np.minimum(np.searchsorted(anchors, words.hash), len(anchors) - 1)
    is_anchor = anchors[at] == words.hash
    content = np.flatnonzero(~is_anchor)
    anchor = np.flatnonzero(is_anchor)
    begin = words.first[:-1][np.diff(words.first) > 0]
    out_text, out = [], []
    # the chain behind each anchor, within its text
    follow = np.searchsorted(content, anchor)
    whole = follow + CHAIN <= len(content)
    anchor, follow = anchor[whole], follow[whole]
    if len(anchor):
        same = words.doc[content[follow + CHAIN - 1]] == words.doc[anchor]
        anchor, follow = anchor[same], follow[same]
        h = words.hash[anchor]
        for k in range(CHAIN):
            h = mix(h + words.hash[content[follow + k]] * _START)
        out_text.append(words.doc[anchor])
        out.append(h)
    # the chain at the text's beginning, as long as there are words for it
    text = words.doc[begin]
    h = np.full(len(begin), _START)
    follow = np.searchsorted(content, begin)
    padded = np.append(content, np.full(CHAIN, len(words.hash)))
    docs = np.append(words.doc, -1)
    hashes = np.append(words.hash, np.uint64(0))
    for k in range(CHAIN):
        place = padded[follow + k]
        h = np.where(docs[place] == text, mix(h + hashes[place] * _START), h)
    bare = docs[padded[follow]] != text  # no content word: the first word
    h[bare] = mix(h[bare] + words.hash[begin[bare]])
    out_text.append(text)
    out.append(h)
    keys = np.unique((np.concatenate(out_text).astype(np.uint64) << np.uint64(32))
                     | (np.concatenate(out) >> np.uint64(32)))
    edge = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = keys.astype(np.uint32)
    return [low[a:b] for a, b in zip(edge, edge[1:])]


def packed(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text."""
    def compute(arrays):
        anchors = _anchor_hashes()
        return [pa.array([packed(s) for part in slices(arrays[0]) for s in spots(part, anchors)], pa.string())]
    return append_columns(df, [text], [T.StructField(out, T.StringType())], compute)


# --- a text, its edit and its successor ------------------------------------------

def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, of the
    first of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (block, extra, id, text), partitioned and sorted, in which each
    block of ascending ids is followed by the first row of the next block, as
    an extra row; the last block by the first of all.  Texts are moved once."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = 4 * partitions
    rows = df.select(column(df, key).alias("id"), F.coalesce(column(df, text), F.lit("")).alias("text"))
    # a null id comes before all others
    place = F.struct(F.col("id").isNotNull().alias("has"), F.col("id"))
    cuts = rows.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
    cuts = sorted(set(cuts or []))
    if cuts:
        rows = rows.withColumn("block", F.when(F.col("id").isNull(), 0).otherwise(
            F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("id")))))
    else:
        rows = rows.withColumn("block", F.lit(0))
    # the first place of each block that has rows: one row a block
    firsts = sorted(rows.groupBy("block").agg(F.min(place).alias("place")).collect(), key=lambda r: r["block"])
    follows = [r["place"]["id"] for r in firsts]
    before = {r["block"]: firsts[k - 1]["block"] for k, r in enumerate(firsts)}
    is_first = F.col("id").isin([i for i in follows if i is not None])
    if None in follows:
        is_first = F.coalesce(is_first, F.lit(True))
    targets = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("extra")))
    if before:
        previous = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("block"))
        targets = F.when(is_first, F.array_append(targets, F.struct(
            previous.alias("block"), F.lit(True).alias("extra")))).otherwise(targets)
    return (rows.select("id", "text", F.inline(targets)).select("block", "extra", "id", "text")
            .repartition(partitions, "block")
            .sortWithinPartitions("block", "extra", F.asc_nulls_first("id"), F.xxhash64("text"), "text"))


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, next text) of the rows of ``in_blocks``."""
    held = None
    for batch in batches:
        for block, extra, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held[0] == block:
                yield held[1], held[2], text
            held = None if extra else (block, key, text)


def edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of each row, whose successor is the row of the
    next key (after the last: the first)."""
    schema = T.StructType([
        df.schema[key], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches):
        anchors = _anchor_hashes()
        rows, size = [], 0
        for row in with_next(batches):
            rows.append(row)
            size += len(row[1])
            if size >= SLICE_BYTES // 2:
                yield _described(rows, anchors, schema)
                rows, size = [], 0
        if rows:
            yield _described(rows, anchors, schema)

    return in_blocks(df, key, text).mapInArrow(tidy(run), schema)


def _described(rows: list[tuple], anchors: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    n = len(rows)
    changed = [edited(text, following) for _, text, following in rows]
    # a row's successor is mostly the row after it
    apart = [i for i in range(n) if i + 1 == n or rows[i + 1][1] is not rows[i][2]]
    texts = [text for _, text, _ in rows] + changed + [rows[i][2] for i in apart]
    found = spots(pa.array(texts, pa.large_string()), anchors)
    following = found[1:n] + [found[0]]
    for k, i in enumerate(apart):
        following[i] = found[2 * n + k]
    return pa.RecordBatch.from_arrays([
        pa.array([key for key, _, _ in rows], to_arrow_type(schema.fields[0].dataType)),
        pa.array([len(text) for _, text, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
        pa.array([packed(s) for s in found[:n]], pa.string()),
        pa.array([packed(s) for s in found[n:2 * n]], pa.string()),
        pa.array([likeness(found[i], found[n + i]) for i in range(n)], pa.float64()),
        pa.array([likeness(found[i], following[i]) for i in range(n)], pa.float64()),
    ], names=schema.fieldNames())


# --- all similar pairs ----------------------------------------------------------

def similar_pairs(df: DataFrame, least: float = 0.8, key: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b, likeness) of the distinct fingerprints, each named by its
    smallest key, that are alike by ``least`` (over 0) or more, a < b.  Equal
    fingerprints are one; empty ones are like no other."""
    sets = (df.where(column(df, key).isNotNull()).groupBy(column(df, fingerprint).alias("fingerprint"))
            .agg(F.min(column(df, key)).alias("id")))

    def signatures(arrays):
        found = [unpacked(f.as_py() or "").astype(np.int64) for f in arrays[0]]
        return [pa.array(found, pa.list_(pa.int64()))]

    sets = (append_columns(sets, ["fingerprint"], [T.StructField("set", T.ArrayType(T.LongType()))], signatures)
            .drop("fingerprint").withColumn("size", F.size("set")).where("size > 0"))
    each = sets.select("id", "size", F.explode("set").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    # rarest first: a pair that is alike shares one of so many
    ranked = each.join(often, "sig").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("s"))
    room = (F.col("size") - F.ceil(F.col("size") * least) + 1).cast("int")
    # a partition's lengths differ by the factor 1 / least
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(-np.log(least)) + 1e-9) if least < 1 else F.col("size").cast("long")
    index = ranked.select("id", "size", band.alias("band"), F.explode(F.slice("s", 1, room)).alias("s"))
    index = index.select("id", "size", "band", F.col("s.sig").alias("sig"))
    other = index.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    met = (index.alias("x").join(other.alias("y"), ["band", "sig"])
           .where("x.id <> y.id AND (x.size > y.size OR (x.size = y.size AND x.id < y.id))")
           .where(F.col("y.size") >= F.col("x.size") * least)
           .select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct())
    both = (met.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
            .join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v"))
    shared = F.size(F.array_intersect("su", "sv"))
    return (both.withColumn("likeness", shared / (F.size("su") + F.size("sv") - shared))
            .where(F.col("likeness") >= least)
            .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "likeness"))
