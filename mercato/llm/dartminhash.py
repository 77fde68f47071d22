"""Operator 2: near-duplicates by DartMinHash, banding and exact checks.

A text is a weighted set: its distinct runs of five words (lower case, words
of letters and digits; all words, if fewer than five), of weight 1, or of
their counts with ``counted``.  An element's weights [0, w) are cut at powers
of two; into each such strip falls a random sequence of darts, hashed from the
element and the strip alone, that come at ranks (times) with the strip's width
as rate, each at a hashed weight.  A text sees the darts below its weights up
to a rank that about ``t`` of them reach, and each of k coordinates keeps its
earliest dart.  Two texts keep the same dart in a coordinate with probability
their (weighted) Jaccard similarity.  A text with an empty coordinate looks
twice as far, until none is left, so the work follows elements plus darts.

Signatures are cut into bands; texts that share a band's key are candidates.
Within a key no pairs are enumerated: each text is paired with the key's
centre, the text that meets most others over all its keys (the original among
its copies), and the pairs are checked exactly on their sets.  Classes are the
connected components of the confirmed links; labels spread over joins.  Steps
are stored in the shared folder, and deleted once no later one reads them.  Where a key still holds several classes, its texts are dealt
into lots, and paired with the centres of all lots that are of another class:
nearly all pairs of a small key, a linear number of a large one's.  Centres
only merge classes early.  The texts of keys that then still hold several
classes are finished exactly, by a prefix-filtered join on their rarest
elements (see ``rest_pairs``), so every similar pair with a common key is
linked, whichever texts are centres.
Texts of equal sets have been merged before, so copies make no pairs.

Cases: rows of a null id are in no class and are kept; rows of one id are one
document; null and empty texts, and other texts without a word, are alike only
if equal as texts (a null is an empty text); the class id is the smallest id
of the class, whose rows are kept; other columns are ignored; an empty table
gives an empty one; texts are read whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm import _links
from mercato.llm._arrow import binary_array, column, list_array, slices, tidy
from mercato.llm._store import Stored
from mercato.llm._words import NOT_ALNUM, Words, chain, mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _offset(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLD) % (1 << 64))


_ELEMENT_BITS = 48
#: Parts of an element's ids, where their number is not yet known.
_SALTS = 16
#: Bounds are lowered by this share, so that rounding loses no pair.
_SLACK = 1 - 1e-9


@dataclass(frozen=True)
class Plan:
    """Five words, similarity 0.8; 24 bands of 5 rows miss a pair of that
    similarity with probability (1 - 0.8^5)^24 = 7e-5."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    counted: bool = False
    rounds: int = 2

    @property
    def k(self) -> int:
        return self.bands * self.rows


def weighted_sets(texts: pa.Array, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of all texts, ascending."""
    words = Words(pc.utf8_lower(texts.fill_null("")), NOT_ALNUM)
    n = plan.words
    runs = chain(words.hash, n)
    whole = words.doc[:len(runs)] == words.doc[n - 1:] if len(runs) else np.zeros(0, bool)
    text, run = words.doc[:len(runs)][whole].astype(np.uint64), runs[whole]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        text = np.concatenate([text, short.astype(np.uint64)])
        run = np.concatenate([run, [chain(words.hash[words.first[i]:words.first[i + 1]], count[i])[0]
                                    for i in short]])
    keys = np.sort((text << np.uint64(_ELEMENT_BITS)) | (run >> np.uint64(64 - _ELEMENT_BITS)))
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.append(edge, len(keys))).astype(float) if plan.counted else np.ones(len(edge))
    keys = keys[edge]
    return ((keys >> np.uint64(_ELEMENT_BITS)).astype(np.int64),
            keys & np.uint64((1 << _ELEMENT_BITS) - 1), weight)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def _strips(text: np.ndarray, element: np.ndarray, weight: np.ndarray):
    """(text, seed, low, width, weight) of the strips below each weight."""
    out, strip, rows = [], 0, np.arange(len(text))
    while len(rows):
        low = 0.0 if strip == 0 else 2.0 ** (strip - 1)
        rows = rows[weight[rows] > low]
        width = 1.0 if strip == 0 else low
        out.append((text[rows], mix(element[rows] + _offset(strip)), np.full(len(rows), low),
                    np.full(len(rows), width), weight[rows]))
        strip += 1
    return [np.concatenate(x) for x in zip(*out)] if out else None


def signatures(n: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, [n, k]; 0 for a text without
    elements."""
    earliest = np.zeros((n, k), np.uint64)
    total = np.bincount(text, weight, minlength=n)
    reach = np.zeros(n)
    open_ = total > 0
    reach[open_] = k * (np.log(k) + 2) / total[open_]
    while open_.any():
        some = open_[text]
        darts = _darts(text[some], element[some], weight[some], reach)
        if darts is not None:
            place, key, dart = darts
            coordinate = ((dart >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            slot = place.astype(np.uint64) * np.uint64(k) + coordinate
            order = np.argsort((slot << np.uint64(32)) | key)
            slot = slot[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            earliest.reshape(-1)[slot[first]] = dart[order][first]
            filled = np.bincount(slot[first] // k, minlength=n)
            open_ &= filled < k
        reach *= 2
    return earliest


def _darts(text, element, weight, reach):
    """(text, rank as a 32-bit share of the text's reach, dart)."""
    strips = _strips(text, element, weight)
    if strips is None:
        return None
    text, seed, low, width, weight = strips
    rank, limit = np.zeros(len(text)), reach[text]
    found = []
    step = 0
    while len(text):
        step += 1
        dart = mix(seed + _offset(step))
        rank = rank - np.log(_uniform(dart)) / width
        live = np.flatnonzero(rank < limit)
        text, seed, low, width, weight, rank, limit, dart = (
            x[live] for x in (text, seed, low, width, weight, rank, limit, dart))
        dart = mix(dart + _GOLD)
        hit = low + _uniform(mix(dart + _GOLD)) * width < weight
        found.append((text[hit], (rank[hit] / limit[hit] * (2.0 ** 32 - 1)).astype(np.uint64), dart[hit]))
    return [np.concatenate(x) for x in zip(*found)]


def sketch(df: DataFrame, plan: Plan, text: str, key: str) -> DataFrame:
    """key, same (digest of the set), size, bands (keys) of each row."""
    schema = T.StructType([df.schema[key], T.StructField("same", T.BinaryType()),
                           T.StructField("size", T.DoubleType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                n = len(part)
                of, element, weight = weighted_sets(part, plan)
                darts = signatures(n, of, element, weight, plan.k).reshape(n, plan.bands, plan.rows)
                keys = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=np.uint64) * _GOLD, (n, plan.bands))
                for r in range(plan.rows):
                    keys = mix(keys + darts[:, :, r])
                edge = np.searchsorted(of, np.arange(n + 1))
                has = edge[1:] > edge[:-1]
                texts = part.fill_null("") if part.null_count else part
                same = [hashlib.blake2b(
                    element[a:b].tobytes() + weight[a:b].tobytes() if b > a
                    else b"text" + texts[i].as_py().encode(), digest_size=16).digest()
                    for i, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist()))]
                offsets = np.concatenate([[0], np.cumsum(has * plan.bands)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), binary_array(same),
                    pa.array(np.bincount(of, weight, minlength=n)),
                    list_array(offsets, pa.array(keys[has].reshape(-1).view(np.int64)))], names=schema.names)
                at += n

    return df.select(column(df, key), column(df, text)).mapInArrow(tidy(run), schema)


def _sets(df: DataFrame, plan: Plan, text: str, key: str) -> DataFrame:
    """key, elements (binary), weights (binary) of each row."""
    schema = T.StructType([df.schema[key], T.StructField("elements", T.BinaryType()),
                           T.StructField("weights", T.BinaryType())])

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                of, element, weight = weighted_sets(part, plan)
                edge = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
                pairs = list(zip(edge, edge[1:]))
                # element hashes of 48 bits take six bytes each
                six = element.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)),
                    binary_array([six[a:b].tobytes() for a, b in pairs]),
                    binary_array([weight[a:b].astype(np.float32).tobytes() if plan.counted else b""
                                  for a, b in pairs])], names=schema.names)
                at += len(part)

    return df.select(column(df, key), column(df, text)).mapInArrow(tidy(run), schema)


def similarity(a: bytes, b: bytes, wa: bytes = b"", wb: bytes = b"") -> float:
    """(Weighted) Jaccard similarity of two packed sets."""
    x, y = (np.frombuffer(s, np.uint8).reshape(-1, 6) for s in (a, b))
    x, y = (np.pad(s, ((0, 0), (0, 2))).view("<u8")[:, 0] for s in (x, y))
    p = np.frombuffer(wa, np.float32) if wa else np.ones(len(x))
    q = np.frombuffer(wb, np.float32) if wb else np.ones(len(y))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = float(np.minimum(p[i], q[j]).sum())
    high = float(p.sum() + q.sum()) - low
    return low / high if high else 0.0


def buckets(sets: DataFrame) -> Stored:
    """key, id, met of the bands' keys that several of ``sets`` have; met:
    how many sets the id meets in all its keys."""
    banded = sets.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = Stored(banded.join(shared, "key"), "keys")
    met = rows.rows.groupBy("id").agg(F.sum("n").alias("met"))
    found = Stored(rows.rows.select("key", "id").join(met, "id"), "keys")
    rows.drop()
    return found


def candidates(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Distinct pairs (a < b) of ids that share a key: every id with its keys'
    centre, the id that meets most others.  With ``labels``, only ids of
    different labels are paired, in keys that hold several; a key's ids are
    dealt into lots, of which each has a centre: 16 lots in a key of up to 16
    ids, fewer in a larger one, 2 at least, so a key of n ids makes at most
    256 or 2 n pairs."""
    if labels is None:
        rows = rows.withColumn("label", F.col("id")).withColumn("lots", F.lit(1))
    else:
        rows = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        split = (rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"),
                                         F.count(F.lit(1)).alias("n")).where("l <> h"))
        lots = F.greatest(F.lit(2), F.least(F.lit(16), F.floor(F.lit(256) / F.col("n"))))
        rows = rows.join(split.select("key", lots.cast("int").alias("lots")), "key")
    lot = F.pmod(F.xxhash64("id", "key"), F.col("lots"))
    best = F.max_by(F.struct("id", "label"), F.struct("met", F.xxhash64("id")))
    hubs = (rows.groupBy("key", lot.alias("lot")).agg(best.alias("c"))
            .select("key", F.col("c.id").alias("centre"), F.col("c.label").alias("centre_label")))
    return (rows.join(hubs, "key").where("label <> centre_label")
            .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())


def postings(rows: DataFrame, labels: DataFrame, sizes: DataFrame, packed: DataFrame, plan: Plan) -> Stored:
    """element, n, id, label, size, rest: for the ids of keys that hold several
    labels, the elements by which they may be similar to ids of another label.
    Elements that only one label has come first in every set, then the others
    from rare to frequent (n: their ids); rest is the weight from an element
    on to the end.  The first element that a similar pair shares has a rest of
    at least ``similarity`` of the size in both sets."""
    rows = rows.select("id", "key").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = (rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"))
             .where("l <> h").select("key"))
    open_ = rows.join(split, "key").select("id", "label").distinct()
    sets = open_.join(packed, "id")
    schema = T.StructType([sets.schema["id"], sets.schema["label"], T.StructField("element", T.LongType()),
                           T.StructField("w", T.FloatType())])

    def explode(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for i, (e, w) in enumerate(zip(columns["elements"], columns["weights"])):
                six = np.frombuffer(e.as_py(), np.uint8).reshape(-1, 6)
                element = np.pad(six, ((0, 0), (0, 2))).view("<i8")[:, 0]
                weight = np.frombuffer(w.as_py(), np.float32) if plan.counted else np.ones(len(element), np.float32)
                at = pa.array(np.full(len(element), i))
                yield pa.RecordBatch.from_arrays([columns["id"].take(at), columns["label"].take(at),
                                                  pa.array(element), pa.array(weight)], names=schema.names)

    # read twice, which costs less than to store an element a row
    sets = Stored(sets.select("id", "label", "elements", "weights"), "open")
    elements = sets.rows.mapInArrow(tidy(explode), schema)
    shared = (elements.groupBy("element").agg(F.min("label").alias("l"), F.max("label").alias("h"),
                                              F.count(F.lit(1)).alias("n")).where("l <> h"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    found = (elements.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
             .join(shared.select("element", "n", salts), ["element", "salt"]).drop("salt"))
    behind = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("element")).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("rest", F.sum("w").over(behind)).join(sizes, "id")
    kept = Stored(found.where(F.col("rest") >= plan.similarity * _SLACK * F.col("size"))
                  .select("element", "n", "id", "label", "size", "rest"), "postings")
    sets.drop()
    return kept


def rest_pairs(found: DataFrame, plan: Plan) -> DataFrame:
    """Distinct pairs (a < b) of ids of different labels that may be similar.
    A similar pair of sizes x <= y shares a weight of at least
    t / (1 + t) (x + y), so the rests at its first common element are no less;
    the smaller set's is at least 2 t / (1 + t) of its size, which a passage
    common to sets that are not similar does not reach.  Elements of many ids
    are salted."""
    share = plan.similarity / (1 + plan.similarity) * _SLACK
    salts = F.least(F.floor(F.col("n") / 512) + 1, F.lit(64)).cast("int")
    small = (found.where(F.col("rest") >= 2 * share * F.col("size"))
             .select("element", "id", "label", "size", "rest",
                     F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    large = found.select("element", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"),
                         *[F.col(c).alias(f"{c}_y") for c in ("id", "label", "size", "rest")])
    return (small.join(large, ["element", "salt"])
            .where((F.col("label") != F.col("label_y"))
                   & ((F.col("size") < F.col("size_y")) | ((F.col("size") == F.col("size_y")) & (F.col("id") < F.col("id_y"))))
                   & (F.col("size") >= plan.similarity * _SLACK * F.col("size_y"))
                   & (F.least("rest", "rest_y") >= share * (F.col("size") + F.col("size_y"))))
            .select(F.least("id", "id_y").alias("a"), F.greatest("id", "id_y").alias("b")).distinct())


def confirmed(pairs: DataFrame, sizes: DataFrame, packed: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose sets are as similar as the plan asks; ``sizes``: id,
    size; ``packed``: id, elements, weights."""
    close = (pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
             .where(F.least("size_a", "size_b") >= plan.similarity * F.greatest("size_a", "size_b"))
             .select("a", "b"))
    both = close.join(packed.toDF("b", "eb", "wb"), "b").join(packed.toDF("a", "ea", "wa"), "a")
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def check(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            keep = [similarity(ea.as_py(), eb.as_py(), wa.as_py(), wb.as_py()) >= plan.similarity
                    for ea, eb, wa, wb in zip(*(columns[c] for c in ("ea", "eb", "wa", "wb")))]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return both.select("a", "b", "ea", "eb", "wa", "wb").mapInArrow(tidy(check), schema)


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): the smallest id of its
    connected component."""
    return _links.components(links).rows


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """key, class_id and kept for each row of ``df``."""
    rows = Stored(sketch(df, plan, text, key).withColumnRenamed(key, "id"), "sketch")
    known = rows.rows.where("id is not null")
    sets = Stored(known.groupBy("same").agg(
        F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "sets")
    shared = buckets(sets.rows.where("size > 0"))
    # of stored rows Spark knows the size, and does not shuffle the texts where they are few
    used = Stored(shared.rows.select("id").distinct(), "ids")
    texts = df.select(column(df, key).alias("id"), column(df, text).alias("text")).join(used.rows, "id", "left_semi")
    packed = Stored(_sets(texts, plan, "text", "id"), "packed")
    sizes = sets.rows.select("id", "size")
    reps = sets.rows.select("same", F.col("id").alias("rep"))
    # rows of one id are one document: all the ids that stand for its texts are linked
    one_id = _links.links_of_one_id(known.select("id", "same").join(reps, "same").select("id", "rep"))
    links = [Stored(one_id, "links")]
    labels = _links.components(links[0].rows)

    def link(pairs: DataFrame) -> None:
        nonlocal labels
        links.append(Stored(confirmed(pairs, sizes, packed.rows, plan), "links"))
        before, labels = labels, _links.components(reduce(DataFrame.union, [x.rows for x in links]))
        before.drop()

    for step in range(plan.rounds):
        link(candidates(shared.rows, labels.rows if step else None))
    open_ = postings(shared.rows, labels.rows, sizes, packed.rows, plan)
    link(rest_pairs(open_.rows, plan))
    for table in (shared, used, packed, open_, *links):
        table.drop()
    classes = (sets.rows.select("same", "id").join(labels.rows, "id", "left")
               .select("same", F.coalesce("label", "id").alias("class_id")))
    found = rows.rows.select("id", "same").join(classes, "same", "left").select(
        F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))
    return found.withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("class_id")))
