"""Joins on the similarity of sets that never compare all pairs of a block.

Grams of a block are ordered by how rare they are. Two sets of Jaccard t or more share a gram among the first
n - ceil(t n) + 1 of each (prefix filter), so prefixes are joined on (block, gram) and not on the block. A pair is looked at
where its first shared gram meets itself, once, and only if the grams after it could still be enough (position filter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLACK = 1e-9


def ordered(sets: DataFrame, frequency: DataFrame) -> DataFrame:
    """(block, id, g): the grams of each set, rarest first. sets: (block, id, g array); frequency: (block, gram, f)."""
    one = sets.select("block", "id", F.explode("g").alias("gram")).join(frequency, ["block", "gram"])
    return one.groupBy("block", "id").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("s")).select("block", "id", F.col("s.gram").alias("g"))


def frequencies(*sides: DataFrame) -> DataFrame:
    """(block, gram, f): in how many sets of a block a gram is."""
    every = sides[0].select("block", "g")
    for s in sides[1:]:
        every = every.unionByName(s.select("block", "g"))
    return every.select("block", F.explode("g").alias("gram")).groupBy("block", "gram").agg(F.count("*").alias("f"))


def _prefix(sets: DataFrame, t: float, tag: str) -> DataFrame:
    n = F.size("g")
    keep = F.greatest(n - F.ceil(n * F.lit(t) - _SLACK).cast("int") + 1, F.lit(1))
    cut = sets.select("block", F.col("id").alias(f"id{tag}"), F.col("g").alias(f"g{tag}"), n.alias(f"n{tag}"), F.slice("g", F.lit(1), keep).alias(f"p{tag}"))
    return cut.select("*", F.posexplode(f"p{tag}").alias(f"at{tag}", "gram"))


def overlaps(left: DataFrame, right: DataFrame | None, t: float, also: Column | None = None) -> DataFrame:
    """(block, id1, id2, both, n1, n2) of all pairs of a block whose Jaccard is t or more; both: how many grams they share.

    left, right: (block, id, g), g being arrays of distinct values; right None: left with itself. also: what a pair must meet besides.
    """
    frequency = frequencies(left) if right is None else frequencies(left, right)
    a = ordered(left, frequency)
    x, y = _prefix(a, t, "1"), _prefix(a if right is None else ordered(right, frequency), t, "2")
    need = F.lit(t / (1 + t)) * (F.col("n1") + F.col("n2")) - _SLACK
    left_over = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    met = x.join(y, ["block", "gram"]).where((F.least("n1", "n2") >= F.lit(t) * F.greatest("n1", "n2") - _SLACK) & (left_over >= need))
    if also is not None:
        met = met.where(also)
    first = met.where(F.element_at(F.array_intersect("p1", "p2"), 1) == F.col("gram"))
    return first.select("block", "id1", "id2", F.size(F.array_intersect("g1", "g2")).alias("both"), "n1", "n2").where(F.col("both") >= need)
