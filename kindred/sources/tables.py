"""Readers and look-ups. Every table of the service has a declared schema; look-up tables stand in for the outside world."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "id string, tipo_entidade smallint, parent_id string, parent_nome string, nome_normalizado string, registro_ids array<string>, nomes_membros array<string>, nome_canonico string, registro_canonico_id string, score_medio decimal(3,2), fonte string, detalhes_llm string, status smallint, total_registros_afetados int, executado_por string, data_criacao timestamp, data_execucao timestamp, data_reversao timestamp, nome_oficial string, fonte_oficial string, endereco_google string, canonico_sugerido_id string, decisao_contexto string"
LOG = "grupo_id string, registro_eliminado_id string, tabela_afetada string, registro_afetado_id string, coluna_alterada string, valor_anterior string, valor_novo string, revertido boolean, data_execucao timestamp, data_reversao timestamp"
RUN = "id string, tipo string, status string, total_analisados int, total_grupos int, duracao_ms long, erro string, data_execucao timestamp"
CONTEXT = "grupo_id string, registro_id string, cidade_nome string, cidade_id string, bairro_nome string, bairro_id string, logradouro_nome string, logradouro_id string, estado_sigla string, ceps array<string>, total_logradouros int, total_condominios int, total_bairros int"
SERVICE = {"ms_grupo_duplicata": GROUP, "ms_merge_log": LOG, "ms_execucao_log": RUN, "ms_membro_contexto": CONTEXT}
LOOKUPS = {
    "ref_cities": "uf string, id int, nome string",
    "ref_ceps": "cep string, logradouro string, complemento string, unidade string, bairro string, localidade string, uf string, erro boolean",
    "ref_geocode": "query string, components array<struct<long_name:string,short_name:string,types:array<string>>>, formatted_address string",
    "ref_places": "query string, candidates array<struct<name:string,formatted_address:string>>",
    "verdicts": "group_id string, verdict struct<dup:boolean,confidence:double,name:string,why:string,valid_ids:array<string>>",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], (SERVICE | LOOKUPS)[name])


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, csv or json files. Text formats need a schema: it is not guessed from the data."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database, read in parallel by ranges of a numeric column if bounds (low, high, parts) are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition and bounds:
        reader = reader.options(partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(bounds[2]))
    return reader.load()


def fresh(lookup: DataFrame, days: int, at: str = "fetched_at") -> DataFrame:
    """Entries of a look-up that are no older than so many days. Negative entries (null results) count as known."""
    return lookup.where(F.col(at) > F.current_timestamp() - F.make_dt_interval(F.lit(days)))


def by_id(df: DataFrame, value: object, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == F.lit(value))
