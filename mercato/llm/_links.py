"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm._store import Stored


def components(links: DataFrame) -> Stored:
    """(id, label) for every id in ``links`` (a, b): the smallest id of its
    connected component.  Each round takes the neighbours' smallest label and
    then the label's own label, until nothing changes; rounds are stored, and
    dropped once the next one is."""
    edges = Stored(links.union(links.select("b", "a")).toDF("id", "other").distinct(), "edges")
    labels = Stored(edges.rows.groupBy("id").agg(F.min("other").alias("m"))
                    .select("id", F.least("id", "m").alias("label"), F.col("id").alias("was")), "labels")
    while not labels.rows.where("label <> was").isEmpty():
        known = labels.rows.select("id", "label")
        near = (edges.rows.join(known.toDF("other", "label"), "other")
                .groupBy("id").agg(F.min("label").alias("m")))
        lower = known.join(near, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = known.toDF("label", "further")
        after = Stored(lower.join(jump, "label", "left").select(
            "id", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels")
        labels.drop()
        labels = after
    edges.drop()
    labels.rows = labels.rows.select("id", "label")
    return labels


def links_of_one_id(rows: DataFrame) -> DataFrame:
    """(a, b): of ``rows`` (id, rep), rep being one or several ids that stand
    for the id's texts, the smallest rep of an id with each of its others."""
    pairs = rows.distinct()
    several = (pairs.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
               .select("id", "a"))
    return pairs.join(several, "id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
