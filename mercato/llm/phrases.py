"""Operator 12: collocations of two to five words, mined as by Toivonen.

Per language, phrases that occur ``least`` times or more are found like this:

* Sample.  A share of the documents proposes phrases, level by level, at a
  lower count than their share of ``least``.  The proposed set holds, with a
  phrase, the two phrases that lack its last and its first word.
* Full pass.  Counted over all documents, exactly, are the proposed phrases and
  their negative border: the phrases that are not proposed while the two that
  are shorter by a word are; of one word, every phrase.  Both are known by
  one test, that the two shorter phrases were proposed, so the border is never
  written down.
* Expansion.  A phrase of the border that occurs ``least`` times is a failure
  of the sample: it is added, and another pass counts what it opens, until
  none is found.  The result is exact whatever the sample held; the sample
  only decides how many passes there are.

Texts are cut into words in numpy.  A phrase is a 61-bit hash of language and
words beside its number of words; a task adds equal ones up before the shuffle,
so no phrase, however common, is a hot key.  (Two phrases of one hash would be
counted as one: at 10^13 distinct phrases some of the rare ones meet a frequent
one, and raise it by their few occurrences.)  What was proposed reaches the tasks
as a Bloom filter of ``filter_words`` longs at most, whatever the number of
phrases; what it lets through by mistake is counted exactly, too, and does no harm.
The texts of the frequent phrases, with the hashes of their parts, are fetched
from the sample, and by a last pass where it lacks one; all that follows are
joins on hashes.  Scores are computed
in decimals of 38 digits: counts may reach 10^15.

Cases: null and empty texts have no words; a null language is ``und``; rows are
documents of their own, also if repeated or of a null id; empty tables, and
those without a phrase that is frequent, give an empty result; ties in rank go
by occurrences and then by the bytes of the phrase; other columns are ignored;
texts are read whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm._arrow import column, slices, tidy
from mercato.llm._store import Stored
from mercato.llm._words import SPACE, Words, mix

#: The language of texts without one.
NO_LANG = "und"
#: Ends of a piece, which no phrase crosses: ``[.,;:!?\x0A-\x0D]``.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH_BITS = np.uint64(7)  # the low bits of a phrase's key: its number of words
_SLICE_BYTES = 4 << 20
#: Names that a task remembers as sent.
_SENT = 1 << 20


@dataclass(frozen=True)
class Plan:
    words: int = 5
    least: int = 100
    top: int = 2000
    #: One document of so many is in the sample, where a phrase is proposed at
    #: its share of ``least``, divided by ``slack``.
    share: int = 8
    slack: int = 3
    filter_words: int = 1 << 20


# --- phrases of a batch --------------------------------------------------------------

def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Grams:
    """``keys[k][i]``: the phrase of k words from word i on; ``whole[k][i]``:
    whether one piece holds it.  ``langs``: key without words of each text."""

    def __init__(self, texts: pa.Array, langs: pa.Array, most: int):
        self.words = w = Words(pc.ascii_lower(texts.fill_null("")), SPACE | ENDS)
        names = langs.fill_null(NO_LANG).dictionary_encode()
        seeds = np.array([_seed(s) for s in names.dictionary.to_pylist()], np.uint64)
        of = seeds[names.indices.to_numpy()]
        self.langs = mix(of) & ~_LENGTH_BITS
        n = len(w.hash)
        ends = np.concatenate([[0], np.cumsum(ENDS[w.data], dtype=np.int32)])
        joined = np.zeros(n, bool)
        if n:
            joined[1:] = (w.doc[1:] == w.doc[:-1]) & (ends[w.start[1:]] == ends[w.end[:-1]])
        seed, total, whole = of[w.doc], np.zeros(n, np.uint64), np.ones(n, bool)
        self.keys, self.whole = [None], [None]
        for k in range(1, most + 1):
            size = max(n - k + 1, 0)
            total = total[:size] * _BASE + w.hash[k - 1:]
            whole = whole[:size] & joined[k - 1:] if k > 1 else whole
            self.keys.append((mix(total + seed[:size]) & ~_LENGTH_BITS) | np.uint64(k))
            self.whole.append(whole)

    def opened(self, proposed: "Filter") -> list:
        """``[k][i]``: whether the phrase is proposed or of the border."""
        out, known = [None], None
        for k in range(1, len(self.keys)):
            ok = self.whole[k] if k == 1 else self.whole[k] & known[:-1] & known[1:]
            out.append(ok)
            known = np.zeros(len(ok), bool)
            at = np.flatnonzero(ok)
            known[at] = proposed.has(self.keys[k][at])
        return out


class Filter:
    """A Bloom filter of keys: one long for a key, of which three bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def none(cls, plan: Plan) -> "Filter":
        return cls(np.zeros(plan.filter_words, np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        need = (one << ((keys >> np.uint64(40)) & low)) | (one << ((keys >> np.uint64(46)) & low)) \
            | (one << ((keys >> np.uint64(52)) & low))
        slot = (keys >> np.uint64(3)) & np.uint64(len(self.bits) - 1)
        return (self.bits[slot] & need) == need

    def plus(self, keys: DataFrame) -> "Filter":
        """With the keys of ``keys`` (h); the bits are put together by Spark,
        at most one row a long."""
        def bit(s: int) -> str:
            return f"shiftleft(1L, CAST(shiftrightunsigned(h, {s}) & 63 AS INT))"
        rows = (keys.selectExpr(f"shiftrightunsigned(h, 3) & {len(self.bits) - 1} AS slot",
                                f"{bit(40)} | {bit(46)} | {bit(52)} AS bits")
                .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow())
        bits = self.bits.copy()
        bits[rows["slot"].to_numpy()] |= rows["bits"].to_numpy().view(np.uint64)
        return Filter(bits)


# --- passes --------------------------------------------------------------------------

def counted(docs: DataFrame, proposed: Filter, low: int, high: int, before: Filter | None = None) -> DataFrame:
    """h, n: how often the phrases of ``low`` to ``high`` words that
    ``proposed`` opens, and ``before`` did not, occur in ``docs`` (text, lang);
    of no word: the number of words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast((proposed.bits, None if before is None else before.bits))

    def run(batches):
        now, then = (None if b is None else Filter(b) for b in shared.value)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0), _SLICE_BYTES):
                grams = Grams(texts, batch.column(1).slice(at, len(texts)), high)
                at += len(texts)
                opened = grams.opened(now)
                if then is not None:
                    opened = [None] + [a & ~b for a, b in zip(opened[1:], grams.opened(then)[1:])]
                parts = [grams.keys[k][opened[k]] for k in range(max(low, 1), high + 1)]
                if low == 0:
                    parts.append(grams.langs[grams.words.doc])
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def named(docs: DataFrame, wanted: Filter, plan: Plan) -> DataFrame:
    """h, lang, phrase, left, right of phrases among which are those of
    ``wanted``, some several times; left, right: the keys of the first words
    and of the rest, for each cut.  A language is a phrase without words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted.bits)
    schema = "h long, lang string, phrase string, left array<long>, right array<long>"

    def run(batches):
        filter_, sent = Filter(shared.value), np.zeros(0, np.uint64)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0), _SLICE_BYTES):
                langs = batch.column(1).slice(at, len(texts)).fill_null(NO_LANG)
                grams = Grams(texts, langs, plan.words)
                at += len(texts)
                w, rows = grams.words, []
                found = [np.unique(grams.langs, return_index=True)]
                for k in range(2, plan.words + 1):
                    here = np.flatnonzero(grams.whole[k])
                    here = here[filter_.has(grams.keys[k][here])]
                    keys, first = np.unique(grams.keys[k][here], return_index=True)
                    found.append((keys, here[first]))
                for k, (keys, where) in zip([0, *range(2, plan.words + 1)], found):
                    new = ~np.isin(keys, sent)
                    for h, i in zip(keys[new].view(np.int64).tolist(), where[new].tolist()):
                        if k == 0:
                            rows.append((h, langs[i].as_py(), "", [], []))
                            continue
                        phrase = b" ".join(w.data[w.start[j]:w.end[j]].tobytes() for j in range(i, i + k))
                        cuts = [(int(grams.keys[c].view(np.int64)[i]), int(grams.keys[k - c].view(np.int64)[i + c]))
                                for c in range(1, k)]
                        rows.append((h, langs[w.doc[i]].as_py(), phrase.decode(), *map(list, zip(*cuts))))
                    sent = np.concatenate([sent if len(sent) < _SENT else sent[:0], keys[new]])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                        names=["h", "lang", "phrase", "left", "right"])

    return docs.mapInArrow(tidy(run), schema)


def _length(h: str = "h"):
    return F.col(h).bitwiseAND(7)


def proposals(sample: DataFrame, plan: Plan) -> tuple[DataFrame, Filter]:
    """The keys (h) of the phrases that the sample proposes, and their filter."""
    least = max(1, plan.least // (plan.share * plan.slack))
    proposed, parts = Filter.none(plan), []
    for k in range(1, plan.words):  # what has all words opens nothing
        found = Stored(counted(sample, proposed, k, k).where(F.col("n") >= least).select("h"), "proposed")
        parts.append(found.rows)
        proposed = proposed.plus(found.rows)
    keys = parts[0]
    for part in parts[1:]:
        keys = keys.union(part)
    return keys, proposed


@dataclass(frozen=True)
class Frequent:
    """``counts``: h, n of the frequent phrases of 1 to ``words`` words and of
    the languages; ``passes``: full passes that were needed."""

    counts: DataFrame
    passes: int


def frequent(docs: DataFrame, sample: DataFrame, plan: Plan) -> Frequent:
    keys, proposed = proposals(sample, plan)
    enough = (F.col("n") >= plan.least) | (_length() == 0)
    table = Stored(counted(docs, proposed, 0, plan.words).where(enough), "counts")
    counts, passes = table.rows, 1
    opens = (_length() > 0) & (_length() < plan.words)
    failed = Stored(table.rows.where(opens).join(keys, "h", "left_anti").select("h"), "border").rows
    while not failed.isEmpty():
        wider = proposed.plus(failed)
        more = Stored(counted(docs, wider, 2, plan.words, before=proposed).where(enough), "counts").rows
        counts, passes, proposed = counts.union(more), passes + 1, wider
        failed = more.where(opens).select("h")
    return Frequent(counts, passes)


def _texts_of(docs: DataFrame, sample: DataFrame, counts: DataFrame, plan: Plan) -> DataFrame:
    """h, lang, phrase, left, right of the phrases of two words or more and of
    the languages in ``counts``."""
    def one_each(df: DataFrame, wanted: DataFrame) -> DataFrame:
        rows = named(df, Filter.none(plan).plus(wanted), plan)
        return rows.groupBy("h").agg(F.min(F.struct("lang", "phrase", "left", "right")).alias("s")).select("h", "s.*")

    wanted = counts.where(_length() != 1).select("h")
    names = Stored(one_each(sample, wanted), "names").rows
    missing = Stored(wanted.join(names, "h", "left_anti"), "names").rows
    if missing.isEmpty():
        return names
    return names.union(one_each(docs, missing).join(names, "h", "left_anti"))


def mine(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``
    collocations."""
    docs = df.select(column(df, text).alias("text"), column(df, lang).alias("lang"))
    chosen = F.pmod(F.xxhash64(column(df, key), column(df, text)), F.lit(plan.share)) == 0
    sample = Stored(df.where(chosen).select(column(df, text).alias("text"), column(df, lang).alias("lang")), "sample")
    counts = frequent(docs, sample.rows, plan).counts
    found = _texts_of(docs, sample.rows, counts, plan)
    sample.drop()
    names = Stored(found.join(counts, "h"), "phrases").rows
    totals = names.where(_length() == 0).select(F.col("lang").alias("total_lang"), F.col("n").alias("total"))
    candidates = names.where(_length() >= 2).select("h", "lang", "phrase", "left", "right", F.col("n").alias("a"))
    # a phrase lies inside a longer one of the same count exactly if it lies
    # inside one that is longer by a word
    inside = candidates.where("size(left) >= 2").select(
        F.explode(F.array(F.element_at("left", -1), F.element_at("right", 1))).alias("h"), "a").distinct()
    kept = candidates.join(inside, ["h", "a"], "left_anti")
    cuts = kept.select("h", "lang", "phrase", "a", F.posexplode(F.arrays_zip("left", "right")).alias("cut", "parts"))
    cuts = (cuts.join(counts.toDF("h_l", "l"), F.col("parts.left") == F.col("h_l"))
            .join(counts.toDF("h_r", "r"), F.col("parts.right") == F.col("h_r"))
            .join(totals, F.col("lang") == F.col("total_lang")))
    score = F.expr("(CAST(1000 * a AS DECIMAL(18, 0)) * CAST(total AS DECIMAL(19, 0)))"
                   " div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    scored = (cuts.groupBy("h", "lang", "phrase", "a", "total").agg(lowest.alias("s"))
              .select("lang", "phrase", "a", "s.l", "s.r", F.col("total").alias("n"), "s.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
