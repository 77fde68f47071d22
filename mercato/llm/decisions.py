"""Operator 3: quality rules as learned decision lists, in DataFrame
expressions alone.

Each text gets statistics; rows with a 0/1 label train an ordered list of
rules, each a conjunction of thresholds on statistics, of which the first that
holds rejects a text.  Sequential covering: a rule grows on two thirds of the
rows, condition by condition, by information gain over the counts of good and
bad rows per bin; it is pruned on the last third, to the beginning of the best
precision; if that is high enough and it still catches bad rows, it joins the
list and the rows it holds for are set aside.  Spark counts each step (at most
features x bins rows reach the driver) over a checkpointed table of
statistics.  The list is emitted as one conditional expression.

Cases: a null text has no words; shares of nothing are 0; rows with a null
label, or that the base rules fail, teach nothing; without labelled rows, or
with one kind only, the list is empty and keeps all that the base keeps; equal
gains go to the feature and bin that come first; repeated labels of a document
count each time; columns other than the key pass by; an empty table gives an
empty one; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm._arrow import column
from mercato.llm._store import checkpointed

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_VISIBLE = r"[^\x20\x09-\x0D]"

#: What conditions are about: shares and means, which do not grow with a text.
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "upper_share", "shout_share", "words_per_line"]


def _occurrences(text: Column, characters: str) -> Column:
    """How often ASCII ``characters`` occur in ``text``."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def statistics(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    the features of each text.  Each step is a projection of its own, so that
    an array is made once and not within the functions over it."""
    df = df.select(column(df, key).alias("id"), F.coalesce(column(df, text), F.lit("")).alias("t"))
    df = df.select("id", "t", F.regexp_extract_all("t", F.lit(_VISIBLE + "+"), F.lit(0)).alias("words"),
                   F.filter(F.split("t", "\n"), lambda x: x.rlike(_VISIBLE)).alias("lines"))
    df = df.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        _occurrences(F.col("t"), SYMBOLS).alias("n_symbols"), _occurrences(F.col("t"), "!").alias("shouts"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("uppers"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    windows = F.when(F.size("h") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW))))
    df = df.withColumn("distinct", F.size(F.array_distinct("h"))).withColumn("w", windows).drop("h")
    # only texts with a repeated window sort theirs
    sorted_ = F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(
        F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    df = df.withColumn("s", sorted_).drop("w")
    again = F.filter("s", lambda x, k: (F.get("s", k - 1)["w"] == x["w"]) | (F.get("s", k + 1)["w"] == x["w"]))
    df = df.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    # a position covers its window up to the next position
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")

    def share(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)

    return df.select(
        F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(F.col("word_chars"), "n_words").alias("mean_word"),
        share(F.col("n_symbols"), "n_words").alias("symbol_share"),
        share(F.col("n_dup_lines"), "n_lines").alias("dup_line_share"),
        share(F.col("n_repeat_words"), "n_words").alias("repeat_share"),
        share(F.col("distinct"), "n_words").alias("distinct_share"),
        share(F.col("uppers"), "word_chars").alias("upper_share"),
        share(F.col("shouts"), "n_words").alias("shout_share"),
        share(F.col("n_words"), "n_lines").alias("words_per_line"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: whether a text is kept."""
    found = F
    for rule in rules:
        found = found.when(holds(rule), False)
    return found.otherwise(True) if rules else F.lit(True)


def learn(rows: DataFrame, label: str = "bad", features: list[str] = FEATURES, bound: int = 50_000,
          bins: int = 24, most_rules: int = 8, most_conditions: int = 4, precision: float = 0.9,
          least_caught: int = 5) -> list[Rule]:
    """The rules that reject rows whose boolean ``label`` is true.  At most
    about ``bound`` rows are used, those of the smallest hashes."""
    rows = rows.where(F.col(label).isNotNull()).select(
        *features, F.col(label).cast("boolean").alias("bad"), F.xxhash64(*features, F.lit(17)).alias("h"))
    n = rows.count()
    if n > bound:
        rows = rows.where(F.col("h") < int(-2**63 + 2**64 * (bound / n)))
    cuts = _cuts(rows, features, bins)
    binned = [_bin(F.col(f), cuts[f]).alias(f"bin_{f}") for f in features]
    rows = checkpointed(rows.select("bad", (F.pmod(F.xxhash64("h", F.lit(3)), F.lit(3)) < 2).alias("grows"),
                                    *features, *binned))
    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        rule = _prune(left.where("NOT grows"), _grow(left.where("grows"), features, cuts, most_conditions),
                      precision, least_caught)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def _bin(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda cut: cut <= value)) if cuts else F.lit(0)


def _cuts(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of the good rows and of the bad."""
    share = [i / bins for i in range(1, bins)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, share).alias(f) for f in features]).collect()
    return {f: sorted({float(x) for r in found for x in (r[f] or [])}) for f in features}


def _grow(rows: DataFrame, features: list[str], cuts: dict[str, list[float]], most: int) -> Rule:
    """Conditions one at a time, each of the greatest information gain."""
    rule: Rule = ()
    while len(rule) < most:
        inside = rows.where(holds(rule))
        counts = (inside.select("bad", F.explode(F.array(*[
            F.struct(F.lit(k).alias("f"), F.col(f"bin_{f}").alias("bin")) for k, f in enumerate(features)])).alias("x"))
            .groupBy("x.f", "x.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect())
        best, best_gain = None, 1e-9
        for k, f in enumerate(features):
            table = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["f"] == k}
            bad, good = (sum(x[i] for x in table.values()) for i in (0, 1))
            if not bad or not good:
                continue
            below_bad = below_good = 0
            for j, cut in enumerate(cuts[f]):
                b, g = table.get(j, (0, 0))
                below_bad, below_good = below_bad + b, below_good + g
                for above, p, q in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    gain = p * (log2(p / (p + q)) - log2(bad / (bad + good))) if p else 0.0
                    if gain > best_gain + 1e-12 and q < good:
                        best, best_gain = Condition(f, above, cut), gain
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(rows: DataFrame, rule: Rule, precision: float, least_caught: int) -> Rule:
    """The shortest beginning of ``rule`` of the best precision, smoothed, on
    rows it was not grown on; none if that is not ``precision``."""
    if not rule:
        return ()
    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    found = rows.agg(*[F.count_if(holds(p) & (F.col("bad") == b)).alias(f"n{k}{int(b)}")
                       for k, p in enumerate(parts) for b in (True, False)]).first()
    scored = [((found[f"n{k}1"] + 1) / (found[f"n{k}1"] + found[f"n{k}0"] + 2), -k) for k in range(len(parts))]
    best = -max(scored)[1]
    bad, good = found[f"n{best}1"], found[f"n{best}0"]
    return parts[best] if bad >= least_caught and bad >= precision * (bad + good) else ()


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, list[Rule]]:
    """The statistics of ``docs`` with base_failed and kept, and the rules
    learned from ``labels`` (key, bad)."""
    stats = checkpointed(statistics(docs, text, key).withColumn("base_failed", base_failed()))
    labelled = stats.where(~F.col("base_failed")).join(labels.select(key, "bad"), key)
    rules = learn(labelled)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
