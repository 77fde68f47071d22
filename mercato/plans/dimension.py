"""Joins with dimensions: tables of few keys, of which one may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks over which a hot key is spread; ``mercato.join.salts`` overrides it.
SALTS = 32


def dimension_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: list[str],
                   salts: int | None = None, null_safe: bool = False) -> DataFrame:
    """Inner equi-join of ``big`` with a dimension ``small`` on ``on``.

    Dimensions here have few distinct keys (categories, states, cities), so
    one key may carry a third of ``big``.  Each ``big`` row gets a salt from a
    hash of ``spread_by`` (its own key, so the salt is stable under
    recomputation), ``small`` is repeated once per salt, and the join runs on
    (key, salt): a hot key is spread over ``salts`` tasks.  The plan is the
    same at every size; Spark may still run it as a broadcast join where its
    own threshold, or adaptive execution, finds ``small`` small.  ``on``
    columns have the same names on both sides; the result keeps ``big``'s.
    ``null_safe`` also matches NULL keys.
    """
    n = salts or int(big.sparkSession.conf.get("mercato.join.salts", str(SALTS)))
    dim = small.select(*[F.col(c).alias(f"_dim_{c}") if c in on else F.col(c)
                         for c in small.columns],
                       F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_dim_salt"))
    cond = F.col("_salt") == F.col("_dim_salt")
    for k in on:
        cond = cond & (F.col(k).eqNullSafe(F.col(f"_dim_{k}")) if null_safe
                       else F.col(k) == F.col(f"_dim_{k}"))
    # never null, so no filter on it reaches below big's aggregates
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int"), F.lit(0))
    salted = big.withColumn("_salt", salt)
    return salted.join(dim, cond).drop(*[f"_dim_{k}" for k in on], "_salt", "_dim_salt")
