"""Data checks for the model's declared keys, foreign keys and NOT NULL columns.

The declarations are not enforced on write (there is no storage engine
here); these checks report violations as DataFrames instead.  Rows are
counted per key before keys meet, so a hot key is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.plans.skew import skew_join
from mercato.sources import schemas
from mercato.sources.model import Tables


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count (``n_rows``)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def orphans(child: DataFrame, parent: DataFrame, child_key: str,
            parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-NULL key has no parent row (a NULL key is allowed).

    Only distinct keys meet the parent's.  The missing ones may be as many as
    the keys (a parent table that is absent), and one may have very many rows:
    they meet the child by a join that deals out hot keys and copies no other."""
    parent_key = parent_key or child_key
    parents = parent.select(F.col(parent_key).alias("_parent_key"))
    missing = (child.filter(F.col(child_key).isNotNull()).select(child_key).distinct()
               .join(parents, F.col(child_key) == F.col("_parent_key"), "left_anti"))
    return skew_join(child, missing, child_key, child.columns)


def _orphan_counts(table: str, child: DataFrame, keys: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(check, table_name, columns, violations) for each foreign key (column,
    parent, parent column) of ``child``: rows are counted per key value, of
    all columns in one pass, before the values meet the parents'."""
    unpivoted = child.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("columns"), F.col(c).cast("string").alias("_key"))
        for c, _, _ in keys])).alias("_f")).select("_f.columns", "_f._key")
    counts = (unpivoted.filter(F.col("_key").isNotNull()).groupBy("columns", "_key")
              .agg(F.count(F.lit(1)).alias("_n")))
    known = reduce(DataFrame.unionByName, [
        parent.select(F.lit(c).alias("columns"), F.col(pkey).cast("string").alias("_key"))
        for c, parent, pkey in keys])
    totals = (counts.join(known, ["columns", "_key"], "left_anti")
              .groupBy("columns").agg(F.sum("_n").alias("_n")))
    declared = child.sparkSession.createDataFrame([(c,) for c, _, _ in keys], "columns string")
    return declared.join(totals, "columns", "left").select(
        F.lit("orphan").alias("check"), F.lit(table).alias("table_name"), "columns",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("violations"))


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a NULL in any of ``cols``."""
    if not cols:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def integrity_report(tables: Tables) -> DataFrame:
    """One row per declared constraint: (check, table_name, columns, violations).

    Duplicate keys and NOT NULL violations of a table come from one
    aggregation by its key (one pass and one shuffle per table), its foreign
    keys from one more.
    """
    named = tables.by_model_name()
    parts = []
    for table, keys in schemas.PRIMARY_KEYS.items():
        if table not in named:
            continue
        not_null = schemas.NOT_NULL.get(table, [])
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in not_null]) \
            if not_null else F.lit(False)
        per_key = named[table].groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.count(F.when(any_null, 1)).alias("_nulls"))
        totals = per_key.agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("_dup"),
            F.coalesce(F.sum("_nulls"), F.lit(0)).alias("_null"))
        rows = [F.struct(F.lit("duplicate_key").alias("check"), F.lit(",".join(keys)).alias("columns"),
                         F.col("_dup").cast("bigint").alias("violations"))]
        if not_null:
            rows.append(F.struct(F.lit("not_null").alias("check"),
                                 F.lit(",".join(not_null)).alias("columns"),
                                 F.col("_null").cast("bigint").alias("violations")))
        parts.append(totals.select(F.explode(F.array(*rows)).alias("_r")).select(
            "_r.check", F.lit(table).alias("table_name"), "_r.columns", "_r.violations"))
    foreign: dict[str, list] = {}
    for child, ckey, parent, pkey in schemas.FOREIGN_KEYS:
        if child in named and parent in named:
            foreign.setdefault(child, []).append((ckey, named[parent], pkey))
    parts += [_orphan_counts(child, named[child], keys) for child, keys in foreign.items()]
    return reduce(DataFrame.unionByName, parts)
