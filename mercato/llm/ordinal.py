"""Operator 9: a quality classifier for graded ratings, as a cumulative-link
(proportional-odds) regression.

A text has a score, a weighted sum of hashed features; ordered thresholds turn
it into P(grade > k) = sigmoid(score - threshold k), so one set of weights
serves all grades.  Expected grade and the tail probability of a chosen grade
follow.  Features: which words occur (lower case, hashed), and the shares of
words of each shape (case, digits, the last byte when it is a symbol, equal to
the word before).

Fitting: on at most ``bound`` rated rows, those with the smallest hash of id
and text.  Their features are hashed by Spark into a checkpointed table;
the features that tell grades apart are chosen in tasks, a range of features
each.  ``rounds`` times, each of ``parts`` tasks runs one epoch of Adagrad from
the common parameters over its part, and the parameters are averaged.  What
reaches the driver is the chosen features' places, and ``parts`` vectors with a
number for each of them, not for all 2^18.

Cases: a null or empty text has no features, so its score is 0 and its grade
follows from the thresholds; rated rows with a null grade teach nothing;
without rated rows the weights are 0 and the thresholds even; a rating of a
document that repeats counts each time; a column with an output's name is
replaced; an empty table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import append_columns, binary_array, column, slices, tidy
from mercato.llm._store import checkpointed
from mercato.llm._words import NOT_ALNUM, SPACE, Words

BITS = 18
_WORDS = 1 << BITS
#: a shape: the symbol at the end, two cases, digit, repeated
_DIM = _WORDS + (256 << 4)
#: weight of a shape's share against the presence of a word
_SHARE = 8.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the non-zero features, ascending by text."""
    words = Words(texts, SPACE)
    data = words.data
    n, m = len(texts), len(words.start)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # words as they are, by what they hold
    last = data[words.end - 1]
    symbol = np.where(NOT_ALNUM[last], last, 0).astype(np.int64)
    upper = _UPPER[data[words.start]]
    second = _UPPER[data[np.minimum(words.start + 1, words.end - 1)]]
    digit = _DIGIT[data[words.start]]
    again = np.zeros(m, bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = (((symbol * 2 + upper) * 2 + second) * 2 + digit) * 2 + again
    text, place, value = _grouped(words.doc, _WORDS + shape)
    value = _SHARE * value / np.bincount(words.doc, minlength=n)[text]
    # plain words, once each
    plain = Words(pa.Array.from_buffers(pa.large_binary(), n, [
        None, pa.py_buffer(words.offsets.astype(np.int64)), pa.py_buffer(_LOWER[data])]), NOT_ALNUM)
    word_text, word_place, _ = _grouped(
        plain.doc, (plain.hash >> np.uint64(64 - BITS)).astype(np.int64))
    text, place = np.concatenate([text, word_text]), np.concatenate([place, word_place])
    value = np.concatenate([value, np.ones(len(word_text))])
    order = np.argsort(text, kind="stable")
    return text[order], place[order], value[order]


def _grouped(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the distinct features of each text."""
    keys = np.sort((text.astype(np.int64) << 32) | place)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    return keys[edge] >> 32, keys[edge] & 0xFFFFFFFF, np.diff(np.append(edge, len(keys)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and each threshold k."""
        out = []
        for part in slices(texts):
            text, place, value = features(part)
            score = np.bincount(text, self.weights[place] * value, minlength=len(part))
            out.append(_sigmoid(score[:, None] - self.thresholds[None, :]))
        return np.concatenate(out) if out else np.zeros((0, len(self.thresholds)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _epoch(rows: list[tuple], weights: np.ndarray, thresholds: np.ndarray, rate: float,
           decay: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One epoch of Adagrad over (features, values, grade) rows."""
    weights, thresholds = weights.copy(), thresholds.copy()
    squares, moved = np.full(len(weights), 1e-2), np.full(len(thresholds), 1e-2)
    order = np.random.default_rng(seed).permutation(len(rows))
    levels = np.arange(len(thresholds))
    for i in order:
        place, value, grade, importance = rows[i]
        score = float(weights[place] @ value)
        above = _sigmoid(score - thresholds)
        # dL/dscore of the grade's probability P(>grade-1) - P(>grade)
        low = above[grade - 1] if grade > 0 else 1.0
        high = above[grade] if grade < len(thresholds) else 0.0
        gap = max(low - high, 1e-6)
        d_low, d_high = low * (1 - low), high * (1 - high)
        slope = importance * -(d_low - d_high) / gap
        step = slope * value + decay * weights[place]
        squares[place] += step * step
        weights[place] -= rate * step / np.sqrt(squares[place])
        g = importance * (np.where(levels == grade - 1, d_low, 0)
                          - np.where(levels == grade, d_high, 0)) / gap
        moved += g * g
        thresholds -= rate * g / np.sqrt(moved)
        np.maximum.accumulate(thresholds, out=thresholds)
        thresholds += levels * 1e-6
    return weights, thresholds


def _telling(have: np.ndarray, rows: np.ndarray, least: float, first: int) -> np.ndarray:
    """The features to use, from have[grade, feature] of rows[grade], of which
    the first is feature ``first``: all shapes that occur, and the words of a
    chi-square of ``least`` or more."""
    total, with_it = rows.sum(), have.sum(0)
    expected = with_it[None, :] * rows[:, None] / total
    spread = expected * (1 - with_it[None, :] / total) * (1 - rows[:, None] / total)
    chi = ((have - expected) ** 2 / np.maximum(spread, 1e-9)).max(0)
    use = (chi >= least) & (with_it >= 3)
    shapes = max(_WORDS - first, 0)
    use[shapes:] = with_it[shapes:] > 0
    return first + np.flatnonzero(use)


def fit(rated: DataFrame, grades: int, text: str = "text", grade: str = "grade",
        key: str = "doc_id", bound: int = 20_000, least: float = 20.0,
        rounds: int = 8, parts: int = 8, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """The model of ``rated``, whose ``grade`` runs from 0 to ``grades - 1``.
    A word gets a weight only if its presence goes with some grade: if a
    chi-square over the fitted rows is ``least`` or more."""
    spark = rated.sparkSession
    some = (rated.where(column(rated, grade).isNotNull())
            .select(column(rated, text).alias("text"), column(rated, grade).cast("int").alias("grade"),
                    F.xxhash64(column(rated, key)).alias("order")))
    # the smallest hashes: a threshold from the count, not a sort of texts
    n = some.count()
    if n > bound:
        some = some.where(F.col("order") < int(-2**63 + 2**64 * (bound / n)))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("grade", T.IntegerType()),
                           T.StructField("place", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def hashed(batches):
        for batch in batches:
            grade_of, order = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            at = 0
            for part in slices(batch.column(0)):
                which, place, value = features(part)
                edge = np.searchsorted(which, np.arange(len(part) + 1))
                rows = range(at, at + len(part))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(order[i]) % parts for i in rows], pa.int32()),
                    pa.array([grade_of[i] for i in rows], pa.int32()),
                    binary_array([place[a:b].astype(np.int32).tobytes() for a, b in zip(edge, edge[1:])]),
                    binary_array([value[a:b].astype(np.float32).tobytes() for a, b in zip(edge, edge[1:])]),
                ], names=schema.names)
                at += len(part)

    table = checkpointed(some.mapInArrow(tidy(hashed), schema))
    share = {r["grade"]: r["count"] for r in table.groupBy("grade").count().collect()}
    total = sum(share.values())
    above = np.array([sum(c for g, c in share.items() if g > k) for k in range(grades - 1)])
    odds = (above + 1) / (total + 2)
    model = Model(np.zeros(_DIM), -np.log(odds / (1 - odds)) + np.arange(grades - 1) * 1e-6)
    if not total:
        return Model(np.zeros(_DIM), np.linspace(-1, 1, grades - 1))
    importance = {g: (total / (len(share) * c)) ** 0.5 for g, c in share.items()}
    answer = T.StructType([T.StructField("found", T.BinaryType()), T.StructField("n", T.LongType())])

    def found(vectors: list[np.ndarray], numbers: list[int]) -> pa.Table:
        return pa.Table.from_arrays([binary_array([v.tobytes() for v in vectors]), pa.array(numbers, pa.int64())],
                                    names=answer.names)

    # n is the number of a range of features, then the rows of a part
    edges = np.linspace(0, _DIM, parts + 1).astype(int)
    rows_of = np.array([share.get(g, 0) for g in range(grades)])

    def count(part):
        have = [np.frombuffer(p, np.int32) + g * _DIM for g, p in zip(
            part.column("grade").to_pylist(), part.column("place").to_pylist())]
        have = np.bincount(np.concatenate(have), minlength=grades * _DIM).astype(np.int32).reshape(grades, _DIM)
        return found([have[:, a:b] for a, b in zip(edges, edges[1:])], list(range(parts)))

    def choose(counts):
        k = counts.column("n")[0].as_py()
        have = sum(np.frombuffer(c, np.int32).astype(float) for c in counts.column("found").to_pylist())
        return found([_telling(have.reshape(grades, -1), rows_of, least, int(edges[k])).astype(np.int32)], [k])

    chosen = (table.groupBy("part").applyInArrow(count, answer)
              .groupBy("n").applyInArrow(choose, answer).collect())
    places = np.sort(np.concatenate([np.frombuffer(r["found"], np.int32) for r in chosen]))
    common = spark.sparkContext.broadcast(places)
    weights, thresholds = np.zeros(len(places)), model.thresholds
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((weights, thresholds))

        def train(part):
            number = np.full(_DIM, -1)
            number[common.value] = np.arange(len(common.value))
            rows = []
            for g, p, v in zip(*(part.column(c).to_pylist() for c in ("grade", "place", "value"))):
                place, value = number[np.frombuffer(p, np.int32)], np.frombuffer(v, np.float32)
                use = place >= 0
                rows.append((place[use], value[use].astype(float), g, importance[g]))
            return found([np.concatenate(_epoch(rows, *shared.value, rate / (1 + k), decay, k))], [len(rows)])

        got = table.groupBy("part").applyInArrow(train, answer).collect()
        size = np.array([r["n"] for r in got], float)
        mean = sum(np.frombuffer(r["found"]) * (s / size.sum()) for r, s in zip(got, size))
        weights, thresholds = mean[:len(places)].copy(), np.maximum.accumulate(mean[len(places):])
    model = Model(np.zeros(_DIM), thresholds)
    model.weights[places] = weights
    return model


def predict(df: DataFrame, model: Model, grade: int, text: str = "text",
            expected: str = "expected_grade", tail: str = "p_tail") -> DataFrame:
    """``df`` with the expected grade and P(grade >= ``grade``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(arrays):
        tails = shared.value.tails(arrays[0])
        return [pa.array(tails.sum(1)), pa.array(tails[:, grade - 1])]

    return append_columns(df, [text], [T.StructField(expected, T.DoubleType()),
                                       T.StructField(tail, T.DoubleType())], compute)
