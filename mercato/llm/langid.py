"""Operator 6: language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 letters,
lower case, words edged by blanks), most frequent first.  One is learned for
each language from the counts over all training texts; a text gets the
language whose profile is least out of place with its own: the sum, over the
text's n-grams, of the difference of ranks, and the profile's size for an
n-gram that the language's profile lacks.  The n-grams of a batch are counted
at once in numpy by sorting packed keys; counts per language are summed by
Spark, and only the profiles (300 n-grams a language) reach the driver.

Cases: a null text and one without a letter are ``und`` with score 0; equal
distances go to the language first in code-point order; equal counts rank by
code points; with no training text every text is ``und``; rows with a null
language teach nothing; repeated rows count each time; a column with an
output's name is replaced; an empty table gives an empty one.  A text is
never cut: a long one is counted in pieces whose counts are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import append_columns, column, doc_rank, text_view, tidy
from mercato.llm._words import SPACE, pieces
from mercato.llm.bpe import LETTER, _code_points, character_classes

#: n-grams in a profile
PROFILE = 300
UNKNOWN = "und"
_BLANK = 0x110000  # one above the last code point
_BITS = 21         # of a code point in a packed n-gram
_PIECE = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _piece_counts(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
    """(text, packed n-gram, count) of each distinct n-gram of each text."""
    lead, point = _code_points(data)
    text = doc_rank(offsets, lead)
    blank = ~letters[point]
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    keep = ~blank
    # one blank for each run of other characters, and one before each text
    keep |= blank & ~np.concatenate([[False], blank[:-1]]) & ~first
    point, blank, text, first = (np.where(blank, _BLANK, point)[keep], blank[keep],
                                 text[keep], first[keep])
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(text))
    point, text = (np.insert(x, np.concatenate([ends, starts]), np.concatenate([y, y]))
                   for x, y in ((point, np.full(len(starts), _BLANK)), (text, text[starts])))
    alphabet, code = np.unique(point, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    if 3 * bits + int(text.max(initial=0)).bit_length() > 64:
        return _by_text(data, offsets, letters)
    code = code.astype(np.uint64) + np.uint64(1)
    is_blank, shift = point == _BLANK, np.uint64(bits)
    place = text.astype(np.uint64) << np.uint64(3 * bits)
    two = (code[:-1] << shift) | code[1:]
    same = text[:-1] == text[1:]
    inner = same[:-1] & same[1:] & ~is_blank[1:-1]
    pair = same & ~(is_blank[:-1] & is_blank[1:])
    keys = np.concatenate([
        (place | code)[~is_blank], (place[:-1] | two)[pair],
        (place[:-2] | (two[:-1] << shift) | code[2:])[inner]])
    keys.sort()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys.astype(np.int64)
    count = np.diff(np.append(edge, len(keys)))
    keys = keys[edge]
    low = np.uint64((1 << bits) - 1)
    wide = np.concatenate([[0], alphabet]).astype(np.int64)
    gram = np.zeros(len(keys), np.int64)
    for k in (2, 1, 0):
        gram = (gram << _BITS) | wide[((keys >> np.uint64(k * bits)) & low).astype(np.int64)]
    return (keys >> np.uint64(3 * bits)).astype(np.int64), gram, count


def _by_text(data, offsets, letters):
    """For a piece with too many texts and characters for one packed key."""
    found = []
    for i in np.flatnonzero(np.diff(offsets)):
        a, b = offsets[i], offsets[i + 1]
        text, gram, count = _piece_counts(data[a:b], np.array([0, b - a]), letters)
        found.append((text + i, gram, count))
    return tuple(np.concatenate(x) for x in zip(*found))


def gram_counts(texts: pa.Array, letters: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (rank of the text, n-gram, count), ascending by text and
    n-gram; a text's n-grams are all in one batch."""
    data, offsets = text_view(pc.utf8_lower(texts))
    held: list[tuple] = []

    def joined():
        text, gram, count = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((gram, text))
        text, gram, count = text[order], gram[order], count[order]
        edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]))
        return text[edge], gram[edge], np.add.reduceat(count, edge)

    for a, b in pieces(data, offsets, SPACE, _PIECE):
        low = int(np.searchsorted(offsets, a, "right")) - 1
        high = int(np.searchsorted(offsets, b))
        part = _piece_counts(data[a:b], np.clip(offsets[low:high + 1] - a, 0, b - a), letters)
        part = (part[0] + low, *part[1:])
        if offsets[high] > b or held:  # a long text goes on, or ends here
            held.append(part)
            if offsets[high] > b:
                continue
            part, held = joined() if any(len(x[0]) for x in held) else held[0], []
        if len(part[0]):
            yield part


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """The profiles: lang, gram (packed), rank from 0; ``size`` n-grams for
    each language in ``docs``."""
    letters = docs.sparkSession.sparkContext.broadcast(character_classes() == LETTER)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()),
                           T.StructField("n", T.LongType())])

    def count(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes, names = langs.indices.to_numpy(), langs.dictionary
            total: dict[int, list] = {}
            for texts, gram, n in gram_counts(batch.column(0), letters.value):
                of = codes[texts]
                for code in np.unique(of):
                    total.setdefault(int(code), []).append((gram[of == code], n[of == code]))
            for code, found in total.items():
                gram, which = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(which, np.concatenate([y for _, y in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[code].as_py()] * len(gram), pa.string()), pa.array(gram), pa.array(n)],
                    names=schema.names)

    rows = docs.select(column(docs, text).alias("text"), column(docs, lang).alias("lang"))
    counts = (rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
              .mapInArrow(tidy(count), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a limit on the row number itself: each task passes on no more than ``size`` rows of a language
    return (counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
            .select("lang", "gram", (F.col("place") - 1).alias("rank")))


@dataclass
class Profiles:
    """The profiles as arrays: ranks[language, n-gram], ``size`` if absent."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def collect(cls, profiles: DataFrame, size: int = PROFILE) -> Profiles:
        """``size`` rows for each language: a bounded table."""
        rows = profiles.collect()
        languages = sorted({r["lang"] for r in rows})
        grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        ranks = np.full((len(languages), len(grams)), size, np.int64)
        for r in rows:
            ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"]
        return cls(languages, grams, ranks, size)

    def predict(self, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        best, score = np.full(n, -1), np.zeros(n)
        if not self.languages:
            return [UNKNOWN] * n, score
        for text, gram, count in gram_counts(texts, letters):
            order = np.lexsort((gram, -count, text))
            text, gram = text[order], gram[order]
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            rank = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
            top = rank < self.size
            text, gram, rank = text[top], gram[top], rank[top]
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            known = self.grams[at] == gram
            which, place = np.unique(text, return_inverse=True)
            away = np.empty((len(self.languages), len(which)))
            for k, ranks in enumerate(self.ranks):
                r = np.where(known, ranks[at], self.size)
                out = np.where(r < self.size, np.abs(r - rank), self.size)
                away[k] = np.bincount(place, out)
            best[which] = away.argmin(0)
            score[which] = 1 - away.min(0) / (self.size * np.bincount(place))
        names = [*self.languages, UNKNOWN]
        return [names[k] for k in best], np.clip(score, 0, 1)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", lang_pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score: one less the share of
    the greatest distance possible."""
    shared = df.sparkSession.sparkContext.broadcast((profiles, character_classes() == LETTER))

    def compute(arrays):
        learned, letters = shared.value
        names, scores = learned.predict(arrays[0], letters)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(df, [text], [T.StructField(lang_pred, T.StringType()),
                                       T.StructField(score, T.DoubleType())], compute)
