"""The service's own report and update functions over tables of its shape, made from the driver's: orders as groups, line items as
merge log, parts as properties, suppliers as companies, nations as cities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import context, detect, merge, verdict
from kindred.plans import reports
from kindred.spec import DISCARDED, EXECUTED

_GROUP = {
    "id": "CAST(o_orderkey AS VARCHAR(20))",
    "tipo_entidade": "CAST(o_custkey % 4 + 1 AS SMALLINT)",
    "status": "CAST(o_orderkey % 4 + 1 AS SMALLINT)",
    "parent_id": "CASE WHEN o_custkey % 3 = 0 THEN concat('x', CAST(o_custkey % 25 AS VARCHAR(20))) ELSE CAST(o_custkey % 25 AS VARCHAR(20)) END",
    "nome_normalizado": "o_orderpriority",
    "nome_canonico": "CASE WHEN o_orderkey % 3 = 0 THEN 'São João' END",
    "nome_oficial": "CASE WHEN o_custkey % 5 <> 0 THEN 'N' END",
    "canonico_sugerido_id": "CASE WHEN o_custkey % 7 <> 0 THEN '1' END",
    "detalhes_llm": "CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 6 = 1 THEN '{\"saoDuplicatas\": true, \"confianca\": \"0.95\"}' WHEN o_custkey % 6 = 2 THEN '{\"saoDuplicatas\": false, \"confianca\": 0.95}' WHEN o_custkey % 6 = 3 THEN '{\"saoDuplicatas\": true, \"confianca\": 0.89}' ELSE '{\"saoDuplicatas\": true, \"confianca\": 0.9}' END",
    "total_registros_afetados": "CAST(o_custkey % 7 AS INTEGER)",
    "data_execucao": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END",
}
_LOG = {
    "grupo_id": "CAST(l_orderkey AS VARCHAR(20))",
    "tabela_afetada": "CASE l_linenumber % 3 WHEN 0 THEN 'imovel' WHEN 1 THEN 'imovel_endereco' ELSE 'empresa' END",
    "registro_afetado_id": "CAST(CASE WHEN l_linenumber % 3 = 2 THEN l_suppkey ELSE l_partkey END AS VARCHAR(20))",
    "revertido": "l_returnflag = 'R'",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


_CTES = f"""g AS (SELECT {_select(_GROUP)}, [o_orderpriority, o_orderstatus] AS nomes_membros FROM orders),
ml AS (SELECT {_select(_LOG)} FROM lineitem),
im AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey % 50 + 1 AS VARCHAR) AS empresa_id FROM part),
ie AS (SELECT CAST(p_partkey AS VARCHAR) AS imovel_id FROM part WHERE p_partkey % 2 = 0),
em AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS nome, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END AS nome_fantasia FROM supplier),
live AS (SELECT ml.*, g.tipo_entidade FROM ml JOIN g ON g.id = ml.grupo_id WHERE g.status = 2 AND NOT revertido),
cm AS (SELECT DISTINCT grupo_id, tipo_entidade, coalesce(i.empresa_id, i2.empresa_id) AS empresa_id, coalesce(i.id, i2.id) AS imovel_id, 'imovel' AS via FROM live
       LEFT JOIN im AS i ON i.id = registro_afetado_id AND tabela_afetada = 'imovel' LEFT JOIN ie ON ie.imovel_id = registro_afetado_id AND tabela_afetada = 'imovel_endereco' LEFT JOIN im AS i2 ON i2.id = ie.imovel_id
       WHERE tabela_afetada <> 'empresa' AND coalesce(i.empresa_id, i2.empresa_id) IS NOT NULL
       UNION ALL SELECT DISTINCT grupo_id, tipo_entidade, registro_afetado_id, NULL, 'direto' FROM live WHERE tabela_afetada = 'empresa')"""


class Tables:
    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def _of(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.d}/{name}.parquet")

    @property
    def groups(self) -> DataFrame:
        return self._of("orders").select(*(F.expr(e).alias(n) for n, e in _GROUP.items()), F.array("o_orderpriority", "o_orderstatus").alias("nomes_membros"))

    @property
    def log(self) -> DataFrame:
        return self._of("lineitem").select(*(F.expr(e).alias(n) for n, e in _LOG.items()))

    @property
    def imovel(self) -> DataFrame:
        return self._of("part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 50 + 1).cast("string").alias("empresa_id"))

    @property
    def endereco(self) -> DataFrame:
        return self._of("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("imovel_id"))

    @property
    def empresa(self) -> DataFrame:
        return self._of("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("nome"), F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).alias("nome_fantasia"))

    @property
    def cidade(self) -> DataFrame:
        return self._of("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nome"), F.col("n_regionkey").cast("string").alias("estado_id"))


def catalogue() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    out: dict[str, tuple[Callable, str]] = {}

    def add(sql: str):
        def keep(f):
            out[f.__name__] = (lambda spark, d: f(Tables(spark, d)), f"WITH {_CTES}{sql}" if sql.startswith(",") else f"WITH {_CTES} {sql}")
            return f

        return keep

    auto = "status = 1 AND nome_oficial IS NOT NULL AND canonico_sugerido_id IS NOT NULL AND detalhes_llm LIKE '%true%0.9}'"
    kinds = ", ".join(f"count(*) FILTER (status = 1 AND tipo_entidade = {k}) AS pendentes_{n}" for k, n in ((1, "cidade"), (2, "bairro"), (3, "logradouro"), (4, "condominio")))

    @add(f"SELECT count(*) FILTER (status = 1) AS pendentes, count(*) FILTER (status = 2) AS executados, count(*) FILTER (status = 3) AS descartados, count(*) FILTER (status = 4) AS revertidos, {kinds}, count(*) FILTER ({auto}) AS auto_aprovaveis, CAST(sum(total_registros_afetados) FILTER (status = 2) AS BIGINT) AS registros_afetados FROM g")
    def service_dashboard(t):
        return reports.dashboard(t.groups)

    @add(f"SELECT id FROM g WHERE {auto}")
    def service_auto_approvable(t):
        return verdict.auto_approvable(t.groups).select("id")

    by_city = "SELECT parent_id, n_name AS cidade_nome, CAST(n_regionkey AS VARCHAR) AS estado_sigla, count(*) AS total_grupos, count(*) FILTER (tipo_entidade = 2) AS total_bairros, count(*) FILTER (tipo_entidade = 3) AS total_logradouros, CAST(0 AS BIGINT) AS total_condominios FROM g JOIN nation ON n_nationkey = TRY_CAST(parent_id AS INTEGER) WHERE status = 1 AND tipo_entidade IN (2, 3) AND regexp_full_match(parent_id, '[0-9]{1,9}') GROUP BY ALL"

    @add(f"{by_city} ORDER BY total_grupos DESC, parent_id LIMIT 50")
    def service_ranking_cities(t):
        return reports.by_city(t.groups, t.cidade, 50)

    @add(f"SELECT parent_id AS id, cidade_nome || ' - ' || estado_sigla AS nome, total_grupos AS total FROM ({by_city})")
    def service_cities(t):
        return reports.by_city(t.groups, t.cidade).select(F.col("parent_id").alias("id"), F.concat_ws(" - ", "cidade_nome", "estado_sigla").alias("nome"), F.col("total_grupos").alias("total"))

    @add("SELECT tabela_afetada, count(DISTINCT registro_afetado_id) AS total, CASE tabela_afetada WHEN 'imovel' THEN 'Imóveis' WHEN 'empresa' THEN 'Empresas' ELSE 'Endereços de imóveis' END AS label FROM live GROUP BY 1")
    def service_by_table(t):
        return reports.by_table(t.log, t.groups)

    @add("""SELECT em.id AS empresa_id, coalesce(nome_fantasia, nome) AS empresa_nome, count(DISTINCT imovel_id) FILTER (via = 'imovel') AS total_imoveis, count(DISTINCT grupo_id) FILTER (via = 'direto') AS total_alteracoes_diretas, count(DISTINCT grupo_id) AS total_grupos,
count(DISTINCT grupo_id) FILTER (tipo_entidade = 2) AS bairros, count(DISTINCT grupo_id) FILTER (tipo_entidade = 3) AS logradouros, count(DISTINCT grupo_id) FILTER (tipo_entidade = 4) AS condominios, count(DISTINCT grupo_id) FILTER (tipo_entidade = 1) AS cidades FROM cm JOIN em ON em.id = cm.empresa_id GROUP BY 1, 2""")
    def service_by_company(t):
        return reports.by_company(t.log, t.groups, t.imovel, t.endereco, t.empresa)

    impact = "n AS (SELECT grupo_id, tabela_afetada, count(DISTINCT registro_afetado_id) AS c FROM ml WHERE NOT revertido GROUP BY ALL), j AS (SELECT grupo_id, string_agg(tabela_afetada || '=' || c, ',' ORDER BY tabela_afetada) AS impacto, CAST(sum(c) AS BIGINT) AS total_fks FROM n GROUP BY 1)"
    flat = lambda df: df.select("id", F.array_join(F.transform("impacto", lambda x: F.concat(x["tabela"], F.lit("="), x["total"].cast("string"))), ",").alias("impacto"), "total_fks")

    @add(f", {impact} SELECT id, coalesce(impacto, '') AS impacto, coalesce(total_fks, 0) AS total_fks FROM g LEFT JOIN j ON grupo_id = id WHERE status = 2 AND tipo_entidade = 2 AND (contains(strip_accents(lower(coalesce(nome_canonico, nome_normalizado))), 'sao') OR contains(lower(nomes_membros[1]), 'sao') OR contains(lower(nomes_membros[2]), 'sao')) ORDER BY data_execucao DESC NULLS LAST, id LIMIT 20")
    def service_executed_page(t):
        return flat(reports.page(reports.executed(t.groups, t.log, 2, "São"), 1, 20, F.desc_nulls_last("data_execucao"), "id"))

    @add(f", {impact} SELECT id, coalesce(impacto, '') AS impacto, coalesce(total_fks, 0) AS total_fks FROM g LEFT JOIN j ON grupo_id = id WHERE status = 2 AND id IN (SELECT grupo_id FROM cm WHERE empresa_id = '7')")
    def service_executed_by_company(t):
        return flat(reports.executed(t.groups, t.log, company="7", imovel=t.imovel, endereco=t.endereco))

    @add("SELECT grupo_id, tabela_afetada, count(*) AS total FROM ml WHERE NOT revertido GROUP BY ALL")
    def service_details(t):
        names = t.empresa.select(F.lit("empresa").alias("tabela"), "id", "nome")
        log = t.log.withColumns({"coluna_alterada": F.lit("c"), "valor_anterior": F.lit("a"), "valor_novo": F.lit("b")})
        return reports.details(log, names).select("grupo_id", "tabela_afetada", "total")

    @add("SELECT id, CAST(CASE WHEN tipo_entidade = 3 AND status = 1 THEN 3 ELSE status END AS SMALLINT) AS status FROM g")
    def service_discard(t):
        return merge.set_status(t.groups, t.groups.where("tipo_entidade = 3 AND status = 1").select("id"), DISCARDED).select("id", "status")

    @add("SELECT grupo_id, registro_afetado_id FROM ml WHERE grupo_id NOT IN (SELECT id FROM g WHERE status = 1 AND tipo_entidade = 2)")
    def service_purge_pending(t):
        gone = t.groups.where("status = 1 AND tipo_entidade = 2").select(F.col("id").alias("grupo_id"))
        return t.log.join(gone, "grupo_id", "left_anti").select("grupo_id", "registro_afetado_id")

    @add("SELECT DISTINCT m AS id FROM (SELECT unnest(nomes_membros) AS m, tipo_entidade, status FROM g) WHERE tipo_entidade = 2 AND status IN (1, 2, 3)")
    def service_grouped_ids(t):
        return detect.grouped_ids(t.groups.withColumnRenamed("nomes_membros", "registro_ids"), 2)

    @add("SELECT empresa_id, list_slice(list_sort(list(DISTINCT id)), 1, 10) AS ceps FROM im GROUP BY 1")
    def service_first_values(t):
        rows = t.imovel.select(F.col("empresa_id"), F.col("id").alias("cep"), F.lit(None).cast("boolean").alias("excluido"))
        return context.first_ceps(rows, "empresa_id")

    @add("SELECT grupo_id, registro_afetado_id AS registro_id, min(tabela_afetada) AS tabela_afetada FROM ml GROUP BY 1, 2")
    def service_context_dedupe(t):
        return context.dedupe(t.log.select("grupo_id", F.col("registro_afetado_id").alias("registro_id"), "tabela_afetada"))

    @add(f"SELECT id, CASE WHEN status = {EXECUTED} THEN 'Executado' WHEN status = 1 THEN 'Pendente' ELSE 'Desconhecido' END AS label FROM g")
    def service_labels(t):
        return t.groups.select("id", reports.label(F.col("status").cast("int"), {1: "Pendente", EXECUTED: "Executado"}, F.lit("Desconhecido")).alias("label"))

    return out
