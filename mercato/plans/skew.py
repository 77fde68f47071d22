"""Equi-joins of two large tables of which one has hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(big: DataFrame, small: DataFrame, on: str, spread_by: list[str],
              weights: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of ``big`` with ``small`` on ``on``, both large, where
    keys of ``big`` may be hot.

    Keys are counted first.  A key that has more rows than its share of a
    shuffle partition is hot; there are fewer of those than shuffle partitions,
    so their table is broadcast.  A hot key's rows are dealt out by a hash of
    ``spread_by`` (columns of ``big``, so the deal is stable under
    recomputation) over as many salts as partitions' shares that it fills, and
    only its rows of ``small`` are repeated, once a salt.  All other keys keep
    one salt, so next to nothing of ``small`` is copied.  The salts of all hot
    keys together are at most twice the shuffle partitions.

    ``weights``: rows that have about the same keys as ``big`` and are cheaper
    to compute; they decide how even the join is, not its result.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = ((big if weights is None else weights).where(F.col(on).isNotNull())
              .groupBy(F.col(on).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).scalar()
    filled = F.ceil(F.col("_n") * parts / F.col("_total")).cast("int")
    hot = (counts.withColumn("_total", total).where(F.col("_n") * parts > F.col("_total"))
           .select("_hot", filled.alias("_salts")))
    hot = F.broadcast(hot)  # fewer rows than shuffle partitions
    salts = F.coalesce("_salts", F.lit(1))
    dealt = (big.join(hot, F.col(on) == F.col("_hot"), "left")
             .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_hot", "_salts"))
    copies = (small.join(hot, F.col(on) == F.col("_hot"), "left")
              .select(F.explode(F.sequence(F.lit(0), salts - 1)).alias("_small_salt"),
                      *[F.col(c).alias(f"_small_{c}") if c == on else F.col(c) for c in small.columns]))
    same = (F.col("_salt") == F.col("_small_salt")) & (F.col(on) == F.col(f"_small_{on}"))
    return dealt.join(copies, same).drop("_salt", "_small_salt", f"_small_{on}")
