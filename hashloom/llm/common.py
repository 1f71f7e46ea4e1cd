"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.plans.scratch import materialize, scratch_dir

__all__ = ["SPACE", "connected_components", "let", "materialize", "scratch_dir", "words_of"]

#: Java character class of what separates words.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where the body uses it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of an undirected graph given as long columns a and b.

    component is the least node reachable. Alternating large-star and small-star
    rounds: each is a few joins and pre-aggregated minima, and each round's edges are
    written to shared storage. Edges of a hub share a join key; they are dealt out over
    tasks by the adaptive skew join (``spark.sql.adaptive.skewJoin.enabled``, on by default).
    Self loops and repeated edges change nothing; an empty graph gives no rows.
    """
    def signature(df):
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).head()
        return tuple(r)

    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before = signature(e)
    while before[0]:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        e = materialize(small, name)
        after = signature(e)
        if after == before:
            break
        before = after
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
