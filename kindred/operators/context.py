"""Hierarchy chains and member context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain(district: DataFrame, city: DataFrame, street: DataFrame | None = None, condo: DataFrame | None = None) -> DataFrame:
    """Each record of the lowest table given with the names and ids above it."""
    c = city.select(F.col("id").alias("cidade_id"), F.col("nome").alias("cidade_nome"), F.col("estado_id").alias("estado_sigla"))
    out = district.select(F.col("id").alias("bairro_id"), F.col("nome").alias("bairro_nome"), "cidade_id").join(c, "cidade_id")
    if street is not None:
        out = street.select(F.col("id").alias("logradouro_id"), F.col("nome").alias("logradouro_nome"), "bairro_id", "cep").join(out, "bairro_id")
    if condo is not None:
        out = condo.select(F.col("id").alias("condominio_id"), F.col("nome").alias("condominio_nome"), "logradouro_id").join(out, "logradouro_id")
    return out


def child_counts(parent: DataFrame, key: str, child: DataFrame, fk: str, name: str, soft_delete: str | None = None) -> DataFrame:
    """parent with the number of its living children; the count is grouped once, not asked per row."""
    live = child.where(~F.coalesce(F.col(soft_delete), F.lit(False))) if soft_delete else child
    n = live.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias(name))
    return parent.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_ceps(street: DataFrame, parent: str = "bairro_id", most: int = 10) -> DataFrame:
    """(parent, ceps): the first distinct postal codes of living streets, in order."""
    live = street.where(~F.coalesce(F.col("excluido"), F.lit(False)) & F.col("cep").isNotNull() & (F.col("cep") != ""))
    return live.groupBy(parent).agg(F.slice(F.sort_array(F.collect_set("cep")), 1, most).alias("ceps"))


def dedupe(contexts: DataFrame) -> DataFrame:
    """One context per (grupo_id, registro_id)."""
    return contexts.groupBy("grupo_id", "registro_id").agg(F.min(F.struct(*(c for c in contexts.columns if c not in ("grupo_id", "registro_id")))).alias("c")).select("grupo_id", "registro_id", "c.*")
