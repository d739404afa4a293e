"""How many rows refer to each member, by table and column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.spec import FkRef


def counts(members: DataFrame, refs: tuple[FkRef, ...], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(id, ref, total) of every member and reference, zeros too. members: (id). References count before the join, so the join sees one row per value."""
    ids = members.select("id").distinct()
    parts = []
    for r in refs:
        n = tables[r.table].where(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("id")).agg(F.count("*").alias("n"))
        parts.append(ids.join(n, "id", "left").select("id", F.lit(f"{r.table}.{r.column}").alias("ref"), F.coalesce("n", F.lit(0)).cast("long").alias("total")))
    return reduce(DataFrame.unionByName, parts)


def per_member(members: DataFrame, refs: tuple[FkRef, ...], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(group_id, pos, id, name, impact map<ref, total>, total). members: (group_id, pos, id, name)."""
    n = counts(members, refs, tables).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ref", "total")))).alias("impact"), F.sum("total").alias("total"))
    return members.join(n, "id").select("group_id", "pos", "id", "name", "impact", "total")


def ranked(impact: DataFrame) -> DataFrame:
    """(group_id, members): most referenced first, ties in the group's order."""
    return impact.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("minus"), "pos", "id", "name", "total"))).alias("m")).select("group_id", F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["total"].alias("total"))).alias("members"))
