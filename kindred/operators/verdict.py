"""Verdicts on groups: parsing what a validator answered, applying it, and what may be approved without a person."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clamp01, first_object

AUTO_APPROVE = 0.90
_ONE = "sao_duplicatas boolean, confianca double, nome_canonico string, justificativa string, membros_validos_ids array<string>"
ERROR = "Erro ao parsear resposta do LLM"


def _verdict(j: Column, ids: Column) -> Column:
    """Strict types: a quoted boolean or number does not count. Unknown ids go; without a list of ids all are valid."""
    valid = F.when(j["membros_validos_ids"].isNotNull(), F.filter(j["membros_validos_ids"], lambda x: F.array_contains(ids, x))).otherwise(ids)
    return F.struct(F.coalesce(j["sao_duplicatas"], F.lit(False)).alias("dup"), F.coalesce(j["confianca"], F.lit(0.0)).alias("confidence"), F.coalesce(j["nome_canonico"], F.lit("")).alias("name"), F.coalesce(j["justificativa"], F.lit("")).alias("why"), valid.alias("valid_ids"))


def parse_single(content: Column, ids: Column) -> Column:
    """struct<dup, confidence, name, why, valid_ids> of one answer; what is no JSON rejects the group."""
    bad = F.struct(F.lit(False).alias("dup"), F.lit(0.0).alias("confidence"), F.lit("").alias("name"), F.lit(ERROR).alias("why"), F.array().cast("array<string>").alias("valid_ids"))
    return F.when(F.try_parse_json(content).isNull(), bad).otherwise(_verdict(F.from_json(content, _ONE), ids))


def parse_batch(answers: DataFrame, batch: DataFrame) -> DataFrame:
    """(batch_id, group_id, verdict) from answers (batch_id, content) and batch (batch_id, n from 1, group_id, registro_ids). Numbers outside of the batch are left out; the last answer to a number counts."""
    schema = f"grupos array<struct<grupo:int,{_ONE.replace(' ', ':').replace(',:', ',')}>>"
    got = answers.select("batch_id", F.posexplode(F.from_json("content", schema)["grupos"]).alias("at", "g")).groupBy("batch_id", F.col("g.grupo").alias("n")).agg(F.max_by("g", "at").alias("g"))
    return got.join(batch, ["batch_id", "n"]).select("batch_id", "group_id", _verdict(F.col("g"), F.col("registro_ids")).alias("verdict"))


def parse_pair(content: Column, name: Column) -> Column:
    """struct<dup, confidence, name, why> of an answer that may come in a code fence; confidence is held to 0..1."""
    body = first_object(content)
    v = F.from_json(body, "sao_duplicatas string, confianca string, nome_canonico string, justificativa string")
    truthy = F.coalesce(~F.lower(v["sao_duplicatas"]).isin("false", "0", ""), F.lit(False))
    good = F.struct(truthy.alias("dup"), clamp01(v["confianca"]).alias("confidence"), F.coalesce(v["nome_canonico"], name).alias("name"), F.coalesce(v["justificativa"], F.lit("Sem justificativa retornada")).alias("why"))
    bad = F.struct(F.lit(False).alias("dup"), F.lit(0.0).alias("confidence"), name.alias("name"), F.lit(ERROR).alias("why"))
    return F.when((body == "") | F.try_parse_json(body).isNull(), bad).otherwise(good)


def apply(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """groups without the rejected ones. 2 <= k < n valid members cut the group down to them; a name given replaces the group's. Groups without a verdict stay."""
    out = groups.join(verdicts.select("group_id", "verdict"), "group_id", "left").where(F.col("verdict").isNull() | F.col("verdict.dup"))
    k, n = F.size("verdict.valid_ids"), F.size("registro_ids")
    trims = F.coalesce((k >= 2) & (k < n), F.lit(False))
    kept = F.filter(F.arrays_zip("registro_ids", "nomes_membros"), lambda m: F.array_contains(F.col("verdict.valid_ids"), m["registro_ids"]))
    out = out.withColumn("_m", F.when(trims, kept).otherwise(F.arrays_zip("registro_ids", "nomes_membros")))
    named = F.coalesce(F.nullif(F.col("verdict.name"), F.lit("")), F.col("nome_normalizado"))
    columns = [c for c in groups.columns if c not in ("registro_ids", "nomes_membros", "nome_normalizado")]
    return out.select(*columns, named.alias("nome_normalizado"), F.col("_m.registro_ids").alias("registro_ids"), F.col("_m.nomes_membros").alias("nomes_membros"), F.when(F.col("verdict").isNotNull(), F.to_json("verdict")).alias("detalhes_llm"))


def confirmed(details: Column, least: float = AUTO_APPROVE) -> Column:
    """Whether stored details say "duplicates" with enough confidence, both in their own types."""
    j = F.from_json(details, "saoDuplicatas boolean, confianca double")
    return F.coalesce(j["saoDuplicatas"] & (j["confianca"] >= least), F.lit(False))


def auto_approvable(groups: DataFrame, least: float = AUTO_APPROVE) -> DataFrame:
    """Pending groups with an official name and a suggestion that the validator confirmed."""
    return groups.where((F.col("status") == 1) & F.col("nome_oficial").isNotNull() & F.col("canonico_sugerido_id").isNotNull() & F.col("detalhes_llm").isNotNull() & confirmed(F.col("detalhes_llm"), least))


RULES = (
    "A numeral on one name and none, or another, on the other (II, 2, dois, Fase 3) means DIFFERENT places; the same number written in another way does not.",
    "A member without a numeral is no duplicate of one with a numeral.",
    "Directions and positions (Norte, Sul, Leste, Oeste, Central, de Cima, de Baixo) mean DIFFERENT places.",
    "Cities whose names differ by a geographic complement (do Baixio, do Sul, de Minas, da Serra) are DIFFERENT cities, also within one state.",
    "Districts whose names differ by a sector, block, stage or extension (Setor A, Quadra 3, 2a Etapa, Ampliação) are DIFFERENT districts.",
    "Different persons in the name of a street mean DIFFERENT streets; a title or an abbreviation (Dr., Cel., Prof.) does not.",
    "Spelling variants, accents, typing errors and abbreviations (Jd, R., Av., Cond.) of one place are duplicates.",
    "Descriptive prefixes (Jardim, Edifício, Condomínio, Residencial) may vary or be missing; prefixes that name different kinds of place may not.",
    "Where names leave it open, the full address decides: the same street, district and city speak for one place, different ones against it.",
    "Name as valid only the members that are the same place as most of the others; at least two, else the group is no duplicate.",
    "In doubt, answer that the members are different.",
)
_SHAPE = '{"sao_duplicatas": boolean, "confianca": number from 0 to 1, "nome_canonico": string, "justificativa": string, "membros_validos_ids": [string]}'


def _members(names: Column, ids: Column) -> Column:
    return F.array_join(F.transform(F.arrays_zip(names.alias("n"), ids.alias("i")), lambda m, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit('. "'), m["n"], F.lit('" (ID: '), m["i"].cast("string"), F.lit(")"))), "\n")


def _where(context: Column | None) -> Column:
    return F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\nContexto geográfico: "), context)).otherwise(F.lit(""))


def prompt(kind: Column, names: Column, ids: Column, context: Column | None = None) -> Column:
    """The question for a validator: kind, context, numbered members and the rules."""
    return F.concat(F.lit("Are these names of type "), kind, F.lit(" one place or several?"), _where(context), F.lit("\n"), _members(names, ids), F.lit("\n" + "\n".join(RULES)))


def prompt_batch(groups: DataFrame) -> DataFrame:
    """(batch_id, prompt): one question for the groups of a batch, by their numbers. groups: (batch_id, n from 1, kind, names, ids, context)."""
    one = F.concat(F.lit("Group "), F.col("n").cast("string"), F.lit(", type "), F.col("kind"), F.lit(":"), _where(F.col("context")), F.lit("\n"), _members(F.col("names"), F.col("ids")))
    lists = groups.select("batch_id", F.struct("n", one.alias("q")).alias("q")).groupBy("batch_id").agg(F.sort_array(F.collect_list("q")).alias("q"))
    head, tail = "Are the names of each group one place or several?\n", "\n" + "\n".join(RULES) + '\nAnswer with {"grupos": [{"grupo": number of the group, ' + _SHAPE[1:] + "]}"
    return lists.select("batch_id", F.concat(F.lit(head), F.array_join("q.q", "\n"), F.lit(tail)).alias("prompt"))


def prompt_pair(kind: Column, name_a: Column, name_b: Column, parent: Column) -> Column:
    """The question about two names."""
    return F.concat(F.lit("Are these two names of type "), kind, F.lit(" one place?"), _where(parent), F.lit('\n  A. "'), name_a, F.lit('"\n  B. "'), name_b, F.lit('"\n' + "\n".join(RULES) + "\nAnswer with " + _SHAPE.replace(', "membros_validos_ids": [string]', "")))


_ASKED = "group_id string, verdict struct<dup:boolean,confidence:double,name:string,why:string,valid_ids:array<string>>"


def ask(groups: DataFrame, validator: Callable[[list[dict]], list[dict | None]], labels: dict[int, str], size: int = 10) -> DataFrame:
    """(group_id, verdict) of what the validator says to groups, so many at a time, where they are. Ids that are not the group's go; None leaves a group without a verdict.

    groups: (group_id, tipo_entidade, registro_ids, nomes_membros, context).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"group_id": r.group_id, "kind": labels.get(r.tipo_entidade, "Desconhecido"), "names": list(r.nomes_membros), "ids": list(r.registro_ids), "context": r.context} for r in pdf.itertuples()]
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                said = [(g, v) for g, v in zip(part, validator(part)) if v is not None]
                if said:
                    yield pd.DataFrame({"group_id": [g["group_id"] for g, _ in said], "verdict": [v | {"valid_ids": [i for i in v["valid_ids"] if i in g["ids"]]} for g, v in said]})

    return groups.select("group_id", "tipo_entidade", "registro_ids", "nomes_membros", "context").mapInPandas(run, _ASKED)


def context_text(street: Column, district: Column, city: Column, state: Column) -> Column:
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    return F.concat_ws(", ", part("Logradouro", street), part("Bairro", district), part("Cidade", city), part("Estado", state))


def batches(rows: DataFrame, order: str, size: int = 10) -> DataFrame:
    """rows with batch_id (from 0) and n (from 1). Numbers come from per-range counts, so no task sees all rows."""
    from pyspark.sql import Window

    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    local = ranged.withColumn("_k", F.col("_m") - (F.col("_p").cast("long") * F.lit(1 << 33)))
    before = local.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    at = local.join(F.broadcast(before), "_p").withColumn("_at", F.col("_before") + F.col("_k"))
    return at.select(*rows.columns, F.floor(F.col("_at") / size).cast("long").alias("batch_id"), (F.col("_at") % size + 1).cast("int").alias("n"))
