"""Merging groups and undoing it, as whole-table plans: a mapping of ids, a log that comes of joins, rewritten tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import durable
from kindred.spec import DISCARDED, EXECUTED, PENDING, REVERTED, EntitySpec, FkRef

MERGEABLE = (PENDING, REVERTED)
LOG = "grupo_id string, registro_eliminado_id string, tabela_afetada string, registro_afetado_id string, coluna_alterada string, valor_anterior string, valor_novo string, revertido boolean"


class StateError(ValueError):
    pass


def check(status: int, action: str) -> None:
    """Merging needs a pending or reverted group, undoing an executed one, discarding any that is not executed."""
    allowed = {"merge": MERGEABLE, "revert": (EXECUTED,), "discard": (PENDING, DISCARDED, REVERTED)}[action]
    if status not in allowed:
        raise StateError(f"a group of status {status} cannot {action}")


def check_canonical(ids: list, canonical: object) -> None:
    if canonical not in ids:
        raise StateError(f"{canonical!r} is no member of the group")


def mapping(groups: DataFrame, canonical: str = "registro_canonico_id") -> DataFrame:
    """(grupo_id, old, new) for all members but the canonical one."""
    return groups.select(F.col("id").alias("grupo_id"), F.explode("registro_ids").alias("old"), F.col(canonical).alias("new")).where(F.col("old") != F.col("new"))


def key_of(ref: FkRef) -> Column:
    """The affected row's key as text; several columns are joined by |."""
    return F.concat_ws("|", *(F.col(k).cast("string") for k in ref.key))


def log_rows(ref: FkRef, child: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per value that the merge rewrites in this column."""
    m = pairs.select("grupo_id", "old", "new")
    hit = child.select(F.col(ref.column).alias("old"), key_of(ref).alias("registro_afetado_id")).join(m, "old")
    return hit.select("grupo_id", F.col("old").cast("string").alias("registro_eliminado_id"), F.lit(ref.table).alias("tabela_afetada"), "registro_afetado_id", F.lit(ref.column).alias("coluna_alterada"), F.col("old").cast("string").alias("valor_anterior"), F.col("new").cast("string").alias("valor_novo"), F.lit(False).alias("revertido"))


def log(spec: EntitySpec, tables: Mapping[str, DataFrame], pairs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (log_rows(r, tables[r.table], pairs) for r in spec.refs))


def redirect(child: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """child with old ids replaced by new ones. The mapping has one row per absorbed record; Spark broadcasts it when its size allows."""
    m = pairs.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = child.join(m, child[column] == F.col("_old"), "left")
    return out.select(*(F.coalesce(F.col("_new"), child[c]).cast(child.schema[c].dataType).alias(c) if c == column else child[c] for c in child.columns))


def soft_delete(table: DataFrame, spec: EntitySpec, pairs: DataFrame, deleted: bool = True, column: str = "excluido") -> DataFrame:
    """table with the absorbed records marked as deleted, or as living again."""
    gone = pairs.select(F.col("old").alias("_old")).distinct()
    have = F.coalesce(F.col(column), F.lit(False)) if column in table.columns else F.lit(False)
    out = table.join(gone, table[spec.id_col] == F.col("_old"), "left")
    return out.select(*(table[c] for c in table.columns if c != column), F.when(F.col("_old").isNotNull(), F.lit(deleted)).otherwise(have).alias(column))


def rename(table: DataFrame, spec: EntitySpec, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with canonical records renamed, log of the names before). names: (grupo_id, id, name)."""
    n = names.select("grupo_id", F.col("id").alias("_id"), F.col("name").alias("_name"))
    out = table.join(n, table[spec.id_col] == F.col("_id"), "left")
    new = out.select(*(F.coalesce(F.col("_name"), table[c]).alias(c) if c == spec.name_col else table[c] for c in table.columns))
    hit = out.where(F.col("_name").isNotNull() & ~F.col("_name").eqNullSafe(table[spec.name_col]))
    key = F.col("_id").cast("string")
    before = hit.select("grupo_id", key.alias("registro_eliminado_id"), F.lit(spec.table).alias("tabela_afetada"), key.alias("registro_afetado_id"), F.lit(spec.name_col).alias("coluna_alterada"), table[spec.name_col].alias("valor_anterior"), F.col("_name").alias("valor_novo"), F.lit(False).alias("revertido"))
    return new, before


def restore(child: DataFrame, ref: FkRef, merge_log: DataFrame) -> DataFrame:
    """child with the values before the merge, from log rows that are not reverted; of several for one row the oldest counts (data_execucao, where the log has it).

    Rows are found by their whole key. If the column is part of the key, the key has changed with it: then rows are
    found by the key after the merge, as many of those that have become alike as the log names.
    """
    mine = merge_log.where(~F.col("revertido") & (F.col("tabela_afetada") == ref.table) & (F.col("coluna_alterada") == ref.column))
    at = F.col("data_execucao") if "data_execucao" in merge_log.columns else F.lit(None).cast("timestamp")
    kind = child.schema[ref.column].dataType
    back = lambda out: out.select(*(F.coalesce(F.col("_old").cast(kind), child[c]).alias(c) if c == ref.column else child[c] for c in child.columns))
    if ref.column not in ref.key:
        old = mine.groupBy(F.col("registro_afetado_id").alias("_key")).agg(F.min_by("valor_anterior", F.struct(at.alias("at"), "valor_anterior")).alias("_old"))
        return back(child.withColumn("_own", key_of(ref)).join(old, F.col("_own") == F.col("_key"), "left"))
    place = ref.key.index(ref.column)
    part = lambda k: F.get(F.split("registro_afetado_id", "\\|"), F.lit(k))
    new = F.concat_ws("|", *(F.col("valor_novo") if k == place else part(k) for k in range(len(ref.key))))
    # A merge of a merged record moved the row once more: its last key is what the row has now, its first value what it had.
    number = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    moved = durable(mine.select(new.alias("_key"), F.col("registro_afetado_id").alias("_from"), F.col("valor_anterior").alias("_old"), at.alias("_at"), F.monotonically_increasing_id().alias("_id")))
    while True:
        before = moved.withColumn("_n", number("_key", F.desc("_at"), "_id"))
        after = moved.select(F.col("_from").alias("_key"), F.col("_key").alias("_next"), F.col("_at").alias("_later"), F.col("_id").alias("_used"), number("_from", F.desc("_at"), "_id").alias("_n"))
        chained = durable(before.join(after, ["_key", "_n"]).where("_later > _at"))
        if chained.isEmpty():
            break
        # One step of each chain at a time: a row that is itself carried on waits for its turn.
        ends = chained.join(chained.select(F.col("_used").alias("_id")), "_id", "left_anti")
        spent = ends.select(F.explode(F.array("_id", "_used")).alias("_id")).distinct()
        moved = durable(moved.join(spent, "_id", "left_anti").unionByName(ends.select(F.col("_next").alias("_key"), "_from", "_old", F.col("_later").alias("_at"), "_id")))
    old = moved.select("_key", "_old", number("_key", "_old").alias("_n"))
    return back(child.withColumn("_own", key_of(ref)).withColumn("_k", number("_own", F.lit(0))).join(old, (F.col("_own") == F.col("_key")) & (F.col("_k") == F.col("_n")), "left"))


def nested(groups: DataFrame, children: DataFrame, name: str, *order: str) -> DataFrame:
    """groups with an array of the children of each (by grupo_id), in order; empty if there are none."""
    facts = F.struct(*order, *(c for c in children.columns if c not in order))
    lists = children.groupBy(F.col("grupo_id").alias("_g")).agg(F.sort_array(F.collect_list(facts)).alias(name))
    none = F.array().cast(lists.schema[name].dataType)
    return groups.join(lists, groups["id"] == F.col("_g"), "left").select(*groups.columns, F.coalesce(F.col(name), none).alias(name))


def mark_reverted(merge_log: DataFrame, group_ids: DataFrame) -> DataFrame:
    ids = group_ids.select(F.col("grupo_id").alias("_g"), F.lit(True).alias("_hit")).distinct()
    return merge_log.join(ids, merge_log["grupo_id"] == F.col("_g"), "left").select(*(F.coalesce(F.col("_hit"), merge_log[c]).alias(c) if c == "revertido" else merge_log[c] for c in merge_log.columns))


def set_status(groups: DataFrame, ids: DataFrame, status: int, **values: Column) -> DataFrame:
    """groups with status and further columns set where id is among ids (id)."""
    hit = ids.select(F.col("id").alias("_g")).distinct()
    out = groups.join(hit, groups["id"] == F.col("_g"), "left")
    at = F.col("_g").isNotNull()
    new = {"status": F.lit(status), **values}
    return out.select(*(F.when(at, new[c]).otherwise(groups[c]).cast(groups.schema[c].dataType).alias(c) if c in new else groups[c] for c in groups.columns))


def affected(merge_log: DataFrame) -> DataFrame:
    return merge_log.groupBy("grupo_id").agg(F.count("*").cast("int").alias("total_registros_afetados"))


def decision_context(groups: DataFrame) -> Column:
    """What a person or the batch approved, as JSON."""
    return F.to_json(F.struct(F.col("nome_oficial").alias("nomeOficial"), F.col("fonte_oficial").alias("fonteOficial"), F.col("canonico_sugerido_id").alias("canonicoSugeridoId"), F.col("score_medio").cast("double").alias("scoreMedio")))
