"""Operator 4: mixing sources to target weights, as a time-varying curriculum,
in DataFrame expressions alone.

Targets: the sources share the total of all sizes by weight, none above
``most`` times its own size; what is above is shared again.  That is the least
of the cap and a level times the weight, and the level is the greatest of
those that follow if the first k sources, in the order of cap per weight, are
held at their caps.

Positions: each source's documents stand one behind the other in the order of
a hash of their ids, and start again when they have passed.  A copy's middle
falls at some share of the source's target; the source's schedule, a piecewise
linear weight over the training time 0 to 1, is integrated, and its inverse
turns that share of the demand into the time at which it is met, the copy's
position.  Rows are range-sorted by position.

Offsets come in two levels, so that no source meets in one task: documents are
dealt into buckets by their hash (the root of their number, at most), bucket
sizes are summed along each source, and only within a bucket documents are
summed one by one.

Cases: null texts have size 0, and take nothing; a null source is a source,
the last; a source of size 0 has target 0; a null id is ordered as any other;
rows with equal ids and sizes may change places, which changes nothing; clashing
names among the documents' columns are replaced in what is returned; an empty
table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm._arrow import column, word_count
from mercato.llm._store import checkpointed, new_path

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's words are used at most so many times.
MOST = 3
#: Schedules of the sources, repeating likewise: (time, weight) points from
#: time 0 to 1.  The heaviest sources fade, the lightest come in late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
SEED = 11


def position(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which ``share`` of the schedule's integral is reached."""
    steps, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        steps.append((area, t0, t1, w0, w1))
        area += (t1 - t0) * (w0 + w1) / 2
    demand = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * area
    found = F.lit(schedule[-1][0])
    for begin, t0, t1, w0, w1 in reversed(steps):
        rest = demand - begin
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that holds for slope 0 too
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        x = F.when(rest <= 0, 0.0).otherwise(2 * rest / (root + w0))
        found = F.when(demand < begin + (t1 - t0) * (w0 + w1) / 2, F.least(x + t0, F.lit(t1))).otherwise(found)
    return found


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size; one row each) with the number of the
    source's weight and its target.  The windows see a row for each source."""
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("turn") + 1)
    ranked = (sources.withColumn("number", number).withColumn("turn", (F.col("number") % len(WEIGHTS)).cast("int"))
              .withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double")))
    # level if the sources before this one are at their caps
    before = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    held = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - held) / open_)
    return (levels.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight")))
            .select("source", "source_size", "turn", "target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
         row: str | None = None) -> DataFrame:
    """key, source, size, source_size, target, taken, copies, positions (one
    for each copy, ascending), sorted by the first position.  With ``row``, a
    column that numbers the rows, that column too; rows of a null id are then
    ordered by the hash of their text."""
    h = F.xxhash64(column(docs, key), F.lit(SEED))
    if row:
        h = F.when(column(docs, key).isNull(), F.xxhash64(column(docs, text), F.lit(SEED))).otherwise(h)
    number = [column(docs, row).alias("__row")] if row else []
    sized = docs.select(column(docs, key).alias("id"), column(docs, source).cast("string").alias("source"),
                        word_count(column(docs, text)).alias("size"), h.alias("h"), *number)
    sized = checkpointed(sized)
    buckets = max(1, ceil(sized.count() ** 0.5))
    # a source's name that is never null, so that joins and windows agree
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    bucket = F.least(F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")
    rows = sized.withColumn("name", name).withColumn("bucket", bucket)
    sums = checkpointed(rows.groupBy("name", "source", "bucket").agg(F.sum("size").alias("n")))
    sources = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    sources = sources.withColumn("name", name).select("name", "source_size", "turn", "target")
    along = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = (sums.withColumn("begin", F.coalesce(F.sum("n").over(along), F.lit(0)))
              .select("name", "bucket", "begin").join(sources, "name"))
    order = ["h", "id", "size", *(["__row"] if row else [])]
    inside = Window.partitionBy("name", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(begins, ["name", "bucket"]).withColumn(
        "middle", F.col("begin") + F.sum("size").over(inside) - F.col("size") / 2)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    last = F.col("middle") <= F.col("target") - F.col("whole") * F.col("source_size")
    placed = (placed.withColumn("whole", F.least(whole, F.lit(MOST)).cast("int"))
              .withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(
                  F.least(F.col("whole") + F.when(last, 1).otherwise(0), F.lit(MOST)))))
    share = F.expr("transform(IF(copies > 0, sequence(0, copies - 1), array()), k -> (middle + k * source_size) / target)")
    placed = placed.withColumn("shares", share)
    # a position for each schedule's turn
    at = F.array()
    for k in reversed(range(len(WEIGHTS))):
        schedule = SCHEDULES[k]
        times = F.transform("shares", lambda x: position(x, schedule))
        at = times if k == len(WEIGHTS) - 1 else F.when(F.col("turn") == k, times).otherwise(at)
    found = placed.withColumn("positions", at).select(
        F.col("id").alias(key), "source", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "positions",
        *([F.col("__row").alias(row)] if row else []))
    first = F.get("positions", F.lit(0))
    return found.repartitionByRange(first, F.col(key)).sortWithinPartitions(first, key)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        nulls: bool = False) -> DataFrame:
    """The rows of ``docs``, as often as they are taken, range-sorted by
    position.  Rows of a null key take part with ``nulls``; else they stay out
    and count for nothing.  The rows are numbered and stored first, so that
    copies meet their own row, whatever ids are repeated."""
    path = new_path(docs.sparkSession, "mix")
    some = docs if nulls else docs.where(column(docs, key).isNotNull())
    some.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.schema(T.StructType([*docs.schema, T.StructField("__row", T.LongType())])).parquet(path)
    copies = (plan(rows, key, text, source, "__row").where("copies > 0")
              .select(F.col("__row").alias("__of"), F.explode("positions").alias("__position")))
    joined = rows.join(copies, F.col("__row") == F.col("__of"))
    return (joined.repartitionByRange("__position", "__row").sortWithinPartitions("__position", "__row")
            .select(*[column(rows, c) for c in docs.columns]))
