"""Operator 7: language-model scores by stupid backoff, relationally.

The model is counted over all texts: words, and pairs of a word and the word
before it (the first word follows a start sign).  A word scores
c(pair) / c(word before) if its pair occurs ``least`` times or more, else
``alpha`` c(word) / N, and a text the sum of the logarithms.

Three joins by hash, each one shuffle in which the rows of a batch that go to
one part travel as one row of packed columns:

1. words with their counts in the batch, summed into the word table;
2. pairs with the documents they occur in, by the hash of the word before, so
   that counts of pairs and of the words before them are met where the pairs
   are scored;
3. the words of the pairs that back off, by their own hash, to the word table.

What a document gets in a part is summed there, and then per document.  A
hot word (one in 4 x parts or more of all, so there are at most 4 x parts,
which are broadcast with their counts) neither gathers its pairs in one part
nor travels in the third join: its pairs are dealt out by both words.  A pair
counts once per document, with its number, before anything is moved.

Words are runs of letters and digits, lower-cased, known by 48 bits of their
hash.  Cases: a null or empty text, or one without a word, has 0 words, a
log_score of 0 and a null score; rows of one key are one document, rows of a
null key are scored with key null together; copies count each time; other
columns are ignored; an empty table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import binary_array, column, slices, tidy
from mercato.llm._store import checkpointed
from mercato.llm._words import NOT_ALNUM, Words, mix

ALPHA, LEAST = 0.4, 2

_BITS = np.uint64((1 << 48) - 1)
_START, _END = np.uint64(1), np.uint64(2)
_BATCH_BYTES = 8 << 20
#: Stands for a null key in the packed columns.
_NULL = -1 << 63


# --- packed columns ----------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """The numbers' bytes, place by place: equal bytes stand together, which
    the shuffle's compression takes away."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype)[:, 0] if data else np.zeros(0, dtype)


def _deal(part: np.ndarray, parts: int, columns: list[np.ndarray], schema: T.StructType):
    """One row for each part that has any: the part, and its packed columns.
    ``part`` is ascending."""
    edge = np.searchsorted(part, np.arange(parts + 1))
    has = np.flatnonzero(np.diff(edge))
    return pa.RecordBatch.from_arrays(
        [pa.array(has, pa.int32())] + [binary_array([pack(c[edge[p]:edge[p + 1]]) for p in has]) for c in columns],
        names=schema.fieldNames())


def _packed_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField("part", T.IntegerType())]
                        + [T.StructField(n, T.BinaryType()) for n in names])


#: Results that a task holds before it deals them out.
_HELD = 4_000_000


def _met(packed: DataFrame, partitions: int, work: Callable, emit: Callable, schema: T.StructType) -> DataFrame:
    """``work`` on all rows of each part, one part after the other, gives a
    tuple of arrays; ``emit`` makes batches of what a task's parts gave."""
    def run(batches: Iterator[pa.RecordBatch]):
        results: list[tuple] = []

        def done():
            columns = [np.concatenate(x) for x in zip(*results)]
            results.clear()
            return emit(*columns)

        for columns in _parts(batches):
            results.append(work(*columns))
            if sum(len(x) for r in results for x in r) > _HELD:
                yield from done()
        if results:
            yield from done()
    return packed.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(tidy(run), schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each part's rows, which are sorted by part."""
    part, columns = None, []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if parts[a] != part:
                if columns:
                    yield columns
                part, columns = parts[a], [[] for _ in batch.columns[1:]]
            for held, values in zip(columns, batch.columns[1:]):
                held.extend(values.slice(a, b - a).to_pylist())
    if columns:
        yield columns


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(values, edge) if len(edge) else values[:0]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix(h) % np.uint64(parts)).astype(np.int64)


# --- the texts -----------------------------------------------------------------------

def _words(texts: pa.Array) -> Words:
    words = Words(pc.utf8_lower(texts.fill_null("")), NOT_ALNUM)
    words.hash &= _BITS
    words.hash[words.hash <= _END] += np.uint64(3)
    return words


def _pairs(words: Words, doc_ids: np.ndarray):
    """(before, word, document, count), by before, word and document; a
    document's last word is also followed by the end sign."""
    first, n = words.first[:-1], np.diff(words.first)
    some = first[n > 0]
    before = np.empty(len(words.hash), np.uint64)
    before[1:] = words.hash[:-1]
    before[some] = _START
    last = words.first[1:][n > 0] - 1
    before = np.concatenate([before, words.hash[last]])
    word = np.concatenate([words.hash, np.full(len(last), _END)])
    doc = np.concatenate([words.doc, words.doc[last]])
    order = np.lexsort((doc, mix(before * np.uint64(31) + word)))
    before, word, doc = before[order], word[order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
                                          | (before[1:] != before[:-1])])) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(doc)))
    return before[edge], word[edge], doc_ids[doc[edge]], count


def _count_words(parts: int, schema: T.StructType):
    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(0), _BATCH_BYTES):
                words = _words(texts)
                begun = np.count_nonzero(np.diff(words.first))
                h, n = np.unique(words.hash, return_counts=True)
                h, n = np.append(h, _START), np.append(n, begun)
                part = _part_of(h, parts)
                order = np.argsort(part, kind="stable")
                yield _deal(part[order], parts, [h[order], n[order].astype(np.int64)], schema)
    return run


def _sum_words(hashes, counts):
    return _sums(_all(hashes, np.uint64), _all(counts, np.int64))


def _rows(*names: str) -> Callable:
    """Batches of plain rows from arrays."""
    def emit(*columns):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=list(names))
    return emit


def word_table(texts: DataFrame, partitions: int) -> DataFrame:
    """word (hash), n: the count of each word; the start sign's is that of the
    documents with a word."""
    packed = _packed_schema("words", "counts")
    return _met(texts.select("text").mapInArrow(tidy(_count_words(4 * partitions, packed)), packed), partitions,
                _sum_words, _rows("word", "n"), T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())]))


class _Hot:
    """The hot words and their counts, and the number of all words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(words)
        self.words, self.counts, self.total = words[order], counts[order], total

    def count(self, words: np.ndarray) -> np.ndarray:
        """The count of each hot word, 0 of the others."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _deal_pairs(parts: int, hot, schema: T.StructType):
    def run(batches):
        for batch in batches:
            at, ids = 0, batch.column(1).fill_null(_NULL).to_numpy()
            for texts in slices(batch.column(0), _BATCH_BYTES):
                words = _words(texts)
                before, word, doc, count = _pairs(words, ids[at:at + len(texts)])
                at += len(texts)
                is_hot = hot.value.count(before) > 0
                part = _part_of(np.where(is_hot, before * np.uint64(31) + word, before), parts)
                order = np.lexsort((doc, word, before, part))
                part, before, word, doc, count = (x[order] for x in (part, before, word, doc, count))
                yield _deal_runs(part, parts, before, word, doc, count, schema)
    return run


def _deal_runs(part, parts, before, word, doc, count, schema):
    """As ``_deal``, with each word before and each pair written once and the
    number of rows that follow it."""
    new_before = np.concatenate([[True], (before[1:] != before[:-1]) | (part[1:] != part[:-1])]) if len(part) else np.zeros(0, bool)
    new_pair = new_before.copy()
    new_pair[1:] |= word[1:] != word[:-1]
    heads, pairs = np.flatnonzero(new_before), np.flatnonzero(new_pair)
    documents = np.diff(np.append(pairs, len(part)))
    follow = np.diff(np.append(np.searchsorted(pairs, heads), len(pairs)))
    has = np.unique(part)
    columns = []
    for rows, values in ((heads, before[heads]), (heads, follow.astype(np.int32)), (pairs, word[pairs]),
                         (pairs, documents.astype(np.int32)), (None, doc), (None, count.astype(np.int32))):
        of = part if rows is None else part[rows]
        columns.append(binary_array([pack(values[a:b]) for a, b in zip(
            np.searchsorted(of, has), np.searchsorted(of, has, "right"))]))
    return pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), *columns], names=schema.fieldNames())


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each row in that order) by equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


_SUMS = _packed_schema("documents", "scores", "events")
_JOINED = _packed_schema("documents", "scores", "events", "words", "owners", "counts", "table", "n")


def _per_document(doc: np.ndarray, score: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct documents, ascending, with the sums of scores and events."""
    order = np.argsort(doc, kind="stable")
    doc, score, events = doc[order], score[order].astype(np.float64), events[order].astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    if len(edge):
        doc, score, events = doc[edge], np.add.reduceat(score, edge), np.add.reduceat(events, edge)
    return doc, score, events


def _deal_documents(doc: np.ndarray, score: np.ndarray, events: np.ndarray, parts: int) -> pa.RecordBatch:
    """The sums per document, by the hash of the document."""
    doc, score, events = _per_document(doc, score, events)
    part = _part_of(doc.view(np.uint64), parts)
    order = np.argsort(part, kind="stable")
    return _deal(part[order], parts, [doc[order], score[order], events[order]], _SUMS)


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with the columns of ``_JOINED``, null where it lacks them."""
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(n)) if n in batch.schema.names
         else pa.nulls(batch.num_rows, pa.binary()) for n in _JOINED.fieldNames()], names=_JOINED.fieldNames())


def _all(packed: list[bytes | None], dtype) -> np.ndarray:
    return np.concatenate([unpack(x or b"", dtype) for x in packed])


def _score_pairs(parts: int, hot, alpha: float, least: int):
    def work(befores, follows, words, documents, docs, counts):
        head = np.concatenate([unpack(x, np.uint64) for x in befores])
        follow = np.concatenate([unpack(x, np.int32) for x in follows])
        word = np.concatenate([unpack(x, np.uint64) for x in words])
        n = np.concatenate([unpack(x, np.int32) for x in documents])
        doc = np.concatenate([unpack(x, np.int64) for x in docs])
        count = np.concatenate([unpack(x, np.int32) for x in counts]).astype(np.int64)
        before = np.repeat(head, follow)
        # pairs of the batches, then of the whole: counts of pairs and of words before
        begin = np.cumsum(n) - n
        own = np.add.reduceat(count, begin)
        order, group = _groups(before, word)
        total = np.bincount(group, own[order])
        pair_count = np.empty(len(word))
        pair_count[order] = total[group]
        heads, which = np.unique(before, return_inverse=True)
        context = np.bincount(which, own)[which]
        known = hot.value.count(before)
        context = np.where(known > 0, known, context)
        seen = pair_count >= least
        word_count = hot.value.count(word)
        value = np.where(seen, np.log(pair_count) - np.log(context),
                         np.log(alpha) - np.log(hot.value.total) + np.log(np.maximum(word_count, 1)))
        scored = word != _END
        row = np.repeat(np.arange(len(word)), n)
        use = scored[row]
        away = (scored & ~seen & (word_count == 0))[row]
        return (*_per_document(doc[use], (value[row] * count)[use], count[use]),
                word[row][away], doc[away], count[away].astype(np.int32))

    def emit(doc, score, events, word, owner, number):
        yield _joined(_deal_documents(doc, score, events, parts))
        part = _part_of(word, parts)
        order = np.lexsort((word, part))
        yield _joined(_deal(part[order], parts, [word[order], owner[order], number[order]],
                            _packed_schema("words", "owners", "counts")))
    return work, emit


def _pack_table(parts: int):
    def run(batches):
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            part = _part_of(h, parts)
            order = np.argsort(part, kind="stable")
            yield _joined(_deal(part[order], parts, [h[order], n[order]], _packed_schema("table", "n")))
    return run


def _score_words(parts: int):
    """The words that back off meet the word table; sums pass through."""
    def work(documents, scores, events, words, owners, counts, tables, numbers):
        table, number = _all(tables, np.uint64), _all(numbers, np.int64)
        order = np.argsort(table)
        table, number = table[order], number[order]
        word, owner, count = _all(words, np.uint64), _all(owners, np.int64), _all(counts, np.int32)
        value = np.log(number[np.searchsorted(table, word)]) * count if len(word) else np.zeros(0)
        return _per_document(np.concatenate([_all(documents, np.int64), owner]),
                             np.concatenate([_all(scores, np.float64), value]),
                             np.concatenate([_all(events, np.int64), np.zeros(len(owner), np.int64)]))

    def emit(doc, score, events):
        yield _deal_documents(doc, score, events, parts)
    return work, emit


def _sum_documents(documents, scores, events):
    doc, score, n = _per_document(_all(documents, np.int64), _all(scores, np.float64), _all(events, np.int64))
    return doc, n, score


def score(df: DataFrame, text: str = "text", key: str = "doc_id", alpha: float = ALPHA,
          least: int = LEAST) -> DataFrame:
    """key (long), n_words, log_score (natural logarithm) and score (its mean
    over the words) of each document, by the counts over all of ``df``."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * partitions
    texts = df.select(column(df, text).alias("text"), column(df, key).cast("long").alias("id"))
    table = checkpointed(word_table(texts, partitions))
    total = table.where(F.col("word") != int(_START)).agg(F.sum("n")).first()[0] or 1
    top = table.where(F.col("n") >= total / (4 * partitions)).collect()
    hot = spark.sparkContext.broadcast(_Hot(np.array([r["word"] for r in top], np.uint64),
                                            np.array([r["n"] for r in top], np.int64), total))
    dealt = _packed_schema("befores", "follows", "words", "documents", "docs", "counts")
    pairs = texts.mapInArrow(tidy(_deal_pairs(parts, hot, dealt)), dealt)
    # what a task found goes on by part, one row for each that it has any for
    scored = _met(pairs, partitions, *_score_pairs(partitions, hot, alpha, least), _JOINED)
    counted = table.mapInArrow(_pack_table(partitions), _JOINED)
    backed = _met(scored.union(counted), partitions, *_score_words(partitions), _SUMS)
    sums = _met(backed, partitions, _sum_documents, _rows("id", "n_words", "log_score"), T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("log_score", T.DoubleType())]))
    sums = sums.withColumn("id", F.expr(f"nullif(id, {_NULL})"))
    # documents without a word are in no sum
    without = texts.select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"))
    return (sums.union(without).groupBy("id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
            .withColumnRenamed("id", key)
            .withColumn("score", F.col("log_score") / F.when(F.col("n_words") > 0, F.col("n_words"))))
