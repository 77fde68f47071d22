"""Operator 8: URL filters by a sort-merge range join.

A host is turned round, label by label, and each label ended by ``/``
(``com/example/www/``), so that a rule's host covers an interval of keys: its
own and all its subdomains'.  Those intervals are nested or apart.  Keys are
cut into ranges at sampled points; each rule goes to every range that its
interval meets, and each url to its own.  Within a range, rules and urls are
sorted together and swept once: a stack holds the rules whose interval is
open, and a url takes from it the longest rule whose path its own begins with.
A hot host is cut at its paths, since the key ends with the path, and a url
that many rows share at their hashes, which end the sort key.

Cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; without a fitting rule the verdict is ``default`` (allow) and the rule
null; the longest rule is the one of the longest host, then path, then the one
that comes first; a rule listed twice counts once; null rows and repeated rows
get a row each; no rules give the default for all; a column with an output's
name is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import column, keep_other_columns

#: Bound of the sample of keys from which the cut points are taken.
SAMPLE = 4096


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    place = F.regexp_extract(rest, r"\A([^?#]*)", 1)
    host = F.regexp_extract(place, r"\A([^/]*)", 1)
    return (F.translate(host, _UPPER, _LOWER), F.substring(place, F.length(host) + 1, F.length(place)))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com/example/www/``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _turned(host: str) -> str:
    return "".join(label + "/" for label in reversed(host.split(".")))


def cut_points(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` ascending keys between which rows are about
    even, from about ``SAMPLE`` rows: those of the smallest hashes."""
    n = keys.count()
    if n > SAMPLE:
        keys = keys.where(F.xxhash64("key", "salt") < int(-2**63 + 2**64 * (SAMPLE / n)))
    sample = sorted(r["key"] for r in keys.select("key").limit(4 * SAMPLE).collect())
    step = max(1.0, len(sample) / ranges)
    return sorted({sample[int(step * i)] for i in range(1, ranges) if int(step * i) < len(sample)})


_SEP = "\x00"


def _sort_key(url_key: Column, path: Column, salt: Column) -> Column:
    """Reversed host, path and a hash: one binary key, ordered as its bytes."""
    return F.concat(url_key, F.lit(_SEP), path, F.lit(_SEP), F.lpad(F.hex(salt), 16, "0"))


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
          ranges: int | None = None) -> DataFrame:
    """``df`` with host, path, rule and verdict."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = keep_other_columns(df, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.coalesce(column(df, url), F.lit("")))
    rows = df.select(*[column(df, c).alias(f"__{i}") for i, c in enumerate(kept)],
                     host.alias("host"), path.alias("path"),
                     F.xxhash64(*[column(df, c) for c in kept if c.lower() != url.lower()] or [F.lit(0)]).alias("salt"))
    rows = rows.withColumn("key", _sort_key(reversed_host(F.col("host")), F.col("path"), F.col("salt")))
    cuts = [c.encode() for c in cut_points(rows.select("key", "salt"), ranges)]
    order = sorted({(_turned(r.host), i) for i, r in enumerate(dict.fromkeys(rules)) if r.host})
    ruled = list(dict.fromkeys(rules))
    starts = [(turned.encode(), ruled[i]) for turned, i in order]

    # which range a row lies in, by the same bytes the sweep compares
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1)
            found = [bisect_right(cuts, k.as_py().encode()) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])
    names = schema.fieldNames()
    placed = rows.mapInArrow(place, schema)
    # each rule in every range its interval of keys meets
    meets = [(k, i) for i, (low, _) in enumerate(starts)
             for k in range(bisect_right(cuts, low), bisect_left(cuts, low + b"\xff") + 1)]
    opened = (spark.createDataFrame(meets, "range int, number int")
              if meets else spark.createDataFrame([], "range int, number int"))
    out = T.StructType([T.StructField(f"__{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
                       + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    low_keys = spark.createDataFrame([(i, low.decode()) for i, (low, _) in enumerate(starts)] or [],
                                     "number int, key string")
    events = placed.withColumn("number", F.lit(-1)).unionByName(
        opened.join(low_keys, "number"), allowMissingColumns=True)
    swept = (events.repartition(ranges, "range").sortWithinPartitions("range", F.col("key").cast("binary"), F.desc("number")))
    return (swept.mapInArrow(lambda it: _sweep(it, starts, default, len(kept), out.fieldNames()), out)
            .toDF(*kept, "host", "path", "rule", "verdict"))


def _sweep(batches: Iterator[pa.RecordBatch], starts: list[tuple[bytes, Rule]], default: str,
           n_kept: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and key, a rule before the urls of its key."""
    stack: list[tuple[bytes, Rule]] = []
    here = None
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        number, keys, paths, ranges = (columns[c].to_pylist() for c in ("number", "key", "path", "range"))
        keep, found, verdicts = [], [], []
        for row, (n, key, path, at) in enumerate(zip(number, keys, paths, ranges)):
            if at != here:
                stack, here = [], at
            key = key.encode()
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if n >= 0:
                stack.append(starts[n])
                continue
            fit = None
            for low, rule in reversed(stack):
                if fit and len(low) < len(fit[0]):
                    break
                if path.startswith(rule.path) and (fit is None or len(rule.path) > len(fit[1].path)):
                    fit = low, rule
            keep.append(row)
            found.append(fit[1].name if fit else None)
            verdicts.append(fit[1].action if fit else default)
        if keep:
            rows = batch.take(pa.array(keep, pa.int64()))
            kept = [rows.column(i) for i in range(n_kept)]
            host, path = (rows.column(rows.schema.names.index(c)) for c in ("host", "path"))
            yield pa.RecordBatch.from_arrays(
                [*kept, host, path, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=names)
