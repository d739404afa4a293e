"""Official names and the member that comes closest: best matches, votes, cascades. The outside world is look-up DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import bigram_codes, code, dice
from kindred.functions.text import fold, join_parts, postal_code
from kindred.operators.nearest import nearest
from kindred.session import durable

CITY_LEAST = 0.5
OFFICIAL = "struct<name:string,source:string,score:double,address:string>"


def official(name: Column, source: str, score: Column, address: Column | None = None) -> Column:
    made = F.struct(name.alias("name"), F.lit(source).alias("source"), score.cast("double").alias("score"), (F.lit(None) if address is None else address).cast("string").alias("address"))
    return F.when(name.isNotNull() & (name != ""), made)


def best_match(left: DataFrame, right: DataFrame, block: str, key: str, name: str, other: str, other_name: str, above: float | None = None) -> DataFrame:
    """(key, best, best_name, score): for each left row the right row of its block with the most similar name.

    Ties go to the smaller id of the right side. above: the score that must be exceeded. Rows without a block or name have no match.
    """
    x = left.select(F.col(block).alias("block"), F.col(key).alias("key"), fold(F.col(name)).alias("f")).where("block IS NOT NULL AND f IS NOT NULL")
    y = right.select(F.col(block).alias("block"), F.col(other).alias("other"), F.col(other_name).alias("other_name"), fold(F.col(other_name)).alias("f")).where("block IS NOT NULL AND f IS NOT NULL")
    # A text of under two characters has no bigram and is like its equals only: it stands for itself, by a number that no bigram has.
    grams = F.when(F.length("f") < 2, F.array(-1 - code(F.col("f")))).otherwise(bigram_codes(F.col("f"))).alias("g")
    asks = durable(x.select("block", "f").distinct().select("block", "f", F.monotonically_increasing_id().alias("id"), grams))
    # Of the right rows with one folded name only the first can win. Numbered in the order of their ids, whatever type those have.
    ends = y.groupBy("block", "f").agg(F.min(F.struct("other", "other_name")).alias("o")).orderBy("o")
    answers = durable(ends.select("block", "o", F.col("f").alias("near"), F.monotonically_increasing_id().alias("id"), grams))
    best = nearest(asks, answers).join(answers.select(F.col("id").alias("best"), "o"), "best").join(asks, "id")
    out = x.join(best.select("block", "f", "o", "score"), ["block", "f"]).select("key", F.col("o.other").alias("best"), F.col("o.other_name").alias("best_name"), "score")
    return out.where(F.col("score") > above) if above is not None else out


def majority(votes: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """(group, winner, share): the commonest value; ties go to the one seen first. Null and empty values don't vote."""
    cast = votes.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return cast.groupBy(group).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("p"))).alias("winner"), (F.max("n") / F.sum("n")).alias("share"))


def city_name(members: DataFrame, municipalities: DataFrame) -> DataFrame:
    """(group_id, official): municipalities (uf, id, nome) by the first member's name within its state."""
    first = members.groupBy("group_id").agg(F.min_by(F.struct("name", "uf"), "pos").alias("m")).select("group_id", F.upper("m.uf").alias("uf"), F.col("m.name").alias("name"))
    hit = best_match(first, municipalities.select(F.upper("uf").alias("uf"), "id", "nome"), "uf", "group_id", "name", "id", "nome", CITY_LEAST)
    return hit.select(F.col("key").alias("group_id"), official(F.col("best_name"), "ibge", F.col("score")).alias("official"))


def district_name(member_ceps: DataFrame, ceps: DataFrame, most: int = 10) -> DataFrame:
    """(group_id, official): districts that the first postal codes of a group name, by vote. member_ceps: (group_id, pos, cep)."""
    c = member_ceps.select("group_id", "pos", postal_code(F.col("cep")).alias("cep")).where("cep IS NOT NULL").groupBy("group_id", "cep").agg(F.min("pos").alias("pos"))
    taken = c.groupBy("group_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "cep"))), 1, most).alias("c")).select("group_id", F.posexplode("c").alias("at", "c")).select("group_id", "at", "c.cep")
    votes = taken.join(ceps.where(~F.coalesce(F.col("erro"), F.lit(False))).select("cep", "bairro"), "cep")
    won = majority(votes, "group_id", "bairro", "at")
    return won.select("group_id", official(F.col("winner"), "viacep", F.col("share")).alias("official"))


def street_name(member_ceps: DataFrame, ceps: DataFrame) -> DataFrame:
    """(group_id, official): the street of the first postal code that has one."""
    hit = member_ceps.select("group_id", "pos", postal_code(F.col("cep")).alias("cep")).join(ceps.where(~F.coalesce(F.col("erro"), F.lit(False)) & (F.coalesce(F.col("logradouro"), F.lit("")) != "")).select("cep", "logradouro"), "cep")
    return hit.groupBy("group_id").agg(F.min_by("logradouro", F.struct("pos", "cep")).alias("n")).select("group_id", official(F.col("n"), "viacep", F.lit(1.0)).alias("official"))


def component(parts: Column, *types: str) -> Column:
    """long_name of the first address component of the first type that occurs."""
    def first(t: str) -> Column:
        return F.get(F.filter(parts, lambda c: F.array_contains(c["types"], t)), F.lit(0))["long_name"]

    return F.coalesce(*map(first, types))


_PARTS = {1: ("administrative_area_level_2", "locality"), 2: ("sublocality_level_1", "sublocality", "neighborhood"), 3: ("route",), 4: ("premise", "point_of_interest", "establishment")}


def geocoded(queries: DataFrame, geocode: DataFrame, tipo: int, score: float = 0.8) -> DataFrame:
    """(group_id, official) from (group_id, query) and geocode (query, components, formatted_address)."""
    hit = queries.join(geocode, "query")
    return hit.select("group_id", official(component(F.col("components"), *_PARTS[tipo]), "google", F.lit(score), F.col("formatted_address")).alias("official"))


def condo_name(members: DataFrame, places: DataFrame, geocode: DataFrame) -> DataFrame:
    """(group_id, official): the first member that the place search knows (0.9), else the first member's address (0.7).

    members: (group_id, pos, name, cidade, uf); places: (query, candidates array<struct<name, formatted_address>>).
    """
    q = members.withColumn("query", join_parts(F.col("name"), F.col("cidade"), F.col("uf")))
    found = q.join(places.where(F.size("candidates") > 0).select("query", F.col("candidates")[0].alias("c")), "query").groupBy("group_id").agg(F.min_by("c", "pos").alias("c"))
    placed = found.select("group_id", official(F.col("c.name"), "google_places", F.lit(0.9), F.col("c.formatted_address")).alias("a"))
    first = q.groupBy("group_id").agg(F.min_by("query", "pos").alias("query"))
    coded = geocoded(first, geocode, 4, 0.7).select("group_id", F.col("official").alias("b"))
    return cascade(first.select("group_id"), placed.withColumnRenamed("a", "official"), coded.withColumnRenamed("b", "official"))


def cascade(groups: DataFrame, *sources: DataFrame) -> DataFrame:
    """(group_id, official): what the first source that knows the group says; null if none does."""
    out = groups.select("group_id")
    for k, s in enumerate(sources):
        out = out.join(s.select("group_id", F.col("official").alias(f"o{k}")), "group_id", "left")
    return out.select("group_id", F.coalesce(*(F.col(f"o{k}") for k in range(len(sources)))).alias("official"))


def suggested(members: DataFrame, names: DataFrame) -> DataFrame:
    """(group_id, member_id, score): the member closest to the official name; ties go to the first. members: (group_id, pos, id, name)."""
    # Of the members of one name only the first can win.
    first = members.groupBy("group_id", "name").agg(F.min(F.struct("pos", "id")).alias("f")).select("group_id", "name", "f.pos", "f.id")
    m = first.join(names.where(F.col("official").isNotNull()).select("group_id", F.col("official.name").alias("official")), "group_id")
    s = m.select("group_id", "id", "pos", dice(fold(F.col("name")), fold(F.col("official"))).alias("score"))
    return s.groupBy("group_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("pos")).alias("p"))).alias("t")).select("group_id", F.col("t.id").alias("member_id"), F.col("t.score").alias("score"))
