"""Reporting queries: as functions over the service's own tables, and in the same shapes over the driver's."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators.verdict import AUTO_APPROVE, confirmed
from kindred.spec import EXECUTED, PENDING, TABLE_LABEL, TYPE_LABEL


def label(c: Column, names: Mapping, default: Column | None = None) -> Column:
    """A static look-up; unknown values get the default, or stay."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c if default is None else default)


def dashboard(groups: DataFrame) -> DataFrame:
    """All counts of the start page in one pass over the groups."""
    pending = F.col("status") == PENDING
    return groups.agg(
        F.count_if(pending).alias("pendentes"), F.count_if(F.col("status") == EXECUTED).alias("executados"), F.count_if(F.col("status") == 3).alias("descartados"), F.count_if(F.col("status") == 4).alias("revertidos"),
        *(F.count_if(pending & (F.col("tipo_entidade") == k)).alias(f"pendentes_{name.lower()}") for k, name in TYPE_LABEL.items()),
        F.count_if(pending & F.col("nome_oficial").isNotNull() & F.col("canonico_sugerido_id").isNotNull() & F.col("detalhes_llm").isNotNull() & confirmed(F.col("detalhes_llm"), AUTO_APPROVE)).alias("auto_aprovaveis"),
        F.sum(F.when(F.col("status") == EXECUTED, F.col("total_registros_afetados"))).alias("registros_afetados"),
    )


def by_city(groups: DataFrame, city: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending district and street groups by city. A parent that is no number of up to 9 digits is none of a city."""
    g = groups.where((F.col("status") == PENDING) & F.col("tipo_entidade").isin(2, 3) & F.col("parent_id").rlike("^[0-9]{1,9}$"))
    c = city.select(F.col("id").alias("_c"), F.col("nome").alias("cidade_nome"), F.col("estado_id").alias("estado_sigla"))
    out = g.join(c, F.col("parent_id").try_cast("int") == F.col("_c")).groupBy("parent_id", "cidade_nome", "estado_sigla").agg(F.count("*").alias("total_grupos"), F.count_if(F.col("tipo_entidade") == 2).alias("total_bairros"), F.count_if(F.col("tipo_entidade") == 3).alias("total_logradouros"), F.lit(0).cast("long").alias("total_condominios"))
    return out.orderBy(F.desc("total_grupos"), "parent_id").limit(limit) if limit else out.orderBy("cidade_nome", "parent_id")


def by_city_corrected(groups: DataFrame, street: DataFrame, district: DataFrame, city: DataFrame) -> DataFrame:
    """The same with street groups led through their district to the city, and condominiums, whose parent is the city."""
    s = groups.where((F.col("status") == PENDING) & (F.col("tipo_entidade") == 3)).join(district.select(F.col("id").cast("string").alias("parent_id"), F.col("cidade_id").cast("string").alias("_c")), "parent_id").select("tipo_entidade", F.col("_c").alias("parent_id"))
    rest = groups.where((F.col("status") == PENDING) & F.col("tipo_entidade").isin(2, 4)).select("tipo_entidade", "parent_id")
    c = city.select(F.col("id").cast("string").alias("parent_id"), F.col("nome").alias("cidade_nome"), F.col("estado_id").alias("estado_sigla"))
    return s.unionByName(rest).join(c, "parent_id").groupBy("parent_id", "cidade_nome", "estado_sigla").agg(F.count("*").alias("total_grupos"), F.count_if(F.col("tipo_entidade") == 2).alias("total_bairros"), F.count_if(F.col("tipo_entidade") == 3).alias("total_logradouros"), F.count_if(F.col("tipo_entidade") == 4).alias("total_condominios"))


def live_log(log: DataFrame, groups: DataFrame) -> DataFrame:
    """Log rows of executed groups that are not reverted, with the group's type."""
    g = groups.where(F.col("status") == EXECUTED).select(F.col("id").alias("grupo_id"), "tipo_entidade")
    return log.where(~F.col("revertido")).join(g, "grupo_id")


def by_table(log: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct affected records of each table, with the table's label."""
    n = live_log(log, groups).groupBy("tabela_afetada").agg(F.countDistinct("registro_afetado_id").alias("total"))
    return n.withColumn("label", label(F.col("tabela_afetada"), TABLE_LABEL))


def _companies(log: DataFrame, imovel: DataFrame, endereco: DataFrame) -> DataFrame:
    """(grupo_id, tipo_entidade, empresa_id, imovel_id, via) of log rows: properties directly or by their address, and companies themselves."""
    i = imovel.select(F.col("id").cast("string").alias("k1"), F.col("id").alias("imovel_1"), F.col("empresa_id").alias("e1"))
    a = endereco.select(F.col("imovel_id").cast("string").alias("k2"), F.col("imovel_id").alias("_i2")).join(imovel.select(F.col("id").alias("imovel_2"), F.col("empresa_id").alias("e2")), F.col("_i2") == F.col("imovel_2"))
    key, t = F.col("registro_afetado_id"), F.col("tabela_afetada")
    by = log.where(t.isin("imovel", "imovel_endereco")).join(i, (key == F.col("k1")) & (t == "imovel"), "left").join(a, (key == F.col("k2")) & (t == "imovel_endereco"), "left")
    by = by.select("grupo_id", "tipo_entidade", F.coalesce("e1", "e2").cast("string").alias("empresa_id"), F.coalesce("imovel_1", "imovel_2").cast("string").alias("imovel_id"), F.lit("imovel").alias("via")).where(F.col("empresa_id").isNotNull()).distinct()
    direct = log.where(t == "empresa").select("grupo_id", "tipo_entidade", key.alias("empresa_id"), F.lit(None).cast("string").alias("imovel_id"), F.lit("direto").alias("via")).distinct()
    return by.unionByName(direct)


def by_company(log: DataFrame, groups: DataFrame, imovel: DataFrame, endereco: DataFrame, empresa: DataFrame) -> DataFrame:
    t = _companies(live_log(log, groups), imovel, endereco)
    e = empresa.select(F.col("id").cast("string").alias("empresa_id"), F.coalesce("nome_fantasia", "nome").alias("empresa_nome"))
    t = t.join(e, "empresa_id")
    distinct = lambda c, when, name: F.countDistinct(F.when(when, F.col(c))).alias(name)
    kind = lambda k, name: distinct("grupo_id", F.col("tipo_entidade") == k, name)
    return t.groupBy("empresa_id", "empresa_nome").agg(distinct("imovel_id", F.col("via") == "imovel", "total_imoveis"), distinct("grupo_id", F.col("via") == "direto", "total_alteracoes_diretas"), F.countDistinct("grupo_id").alias("total_grupos"), kind(2, "bairros"), kind(3, "logradouros"), kind(4, "condominios"), kind(1, "cidades")).orderBy(F.desc("total_grupos"), "empresa_id")


def executed(groups: DataFrame, log: DataFrame, tipo: int | None = None, search: str | None = None, company: str | None = None, imovel: DataFrame | None = None, endereco: DataFrame | None = None) -> DataFrame:
    """Executed groups that meet the filters, with the affected tables as an array and its total."""
    preds = [F.col("status") == EXECUTED]
    if tipo is not None:
        preds.append(F.col("tipo_entidade") == tipo)
    if search and search.strip():
        needle = search.strip()
        preds.append(text.contains_folded(F.coalesce("nome_canonico", "nome_normalizado"), needle) | F.exists("nomes_membros", lambda m: text.contains_folded(m, needle)))
    out = groups.where(reduce(lambda a, b: a & b, preds))
    if company is not None:
        mine = _companies(live_log(log, groups), imovel, endereco).where(F.col("empresa_id") == company).select(F.col("grupo_id").alias("id"))
        out = out.join(mine, "id", "left_semi")
    n = log.where(~F.col("revertido")).groupBy(F.col("grupo_id").alias("id"), "tabela_afetada").agg(F.countDistinct("registro_afetado_id").alias("total"))
    n = n.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("tabela_afetada").alias("tabela"), "total"))).alias("impacto"), F.sum("total").alias("total_fks"))
    return out.join(n, "id", "left").withColumn("impacto", F.coalesce("impacto", F.array().cast("array<struct<tabela:string,total:bigint>>"))).withColumn("total_fks", F.coalesce("total_fks", F.lit(0)))


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def details(log: DataFrame, names: DataFrame) -> DataFrame:
    """(grupo_id, tabela, label, total, registros): live log rows by table, largest first. names: (tabela, id, nome)."""
    n = names.select(F.col("tabela").alias("tabela_afetada"), F.col("id").cast("string").alias("registro_afetado_id"), "nome")
    rows = log.where(~F.col("revertido")).join(n, ["tabela_afetada", "registro_afetado_id"], "left")
    out = rows.groupBy("grupo_id", "tabela_afetada").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("registro_afetado_id", "coluna_alterada", "valor_anterior", "valor_novo", "nome"))).alias("registros"))
    return out.withColumn("label", label(F.col("tabela_afetada"), TABLE_LABEL)).orderBy("grupo_id", F.desc("total"), "tabela_afetada")


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("data_execucao"), F.desc("id")).limit(n)


# The same shapes over the driver's tables ----------------------------------------------------------------------------


def catalogue() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    out: dict[str, tuple[Callable, str]] = {}

    def report(sql: str):
        def keep(f):
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))

            out[f.__name__] = (run, sql)
            return f

        return keep

    @report("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_totalprice > 100000) AS large, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS affected FROM orders")
    def report_counts_fused(t):
        s = F.col("o_orderstatus")
        return t("orders").agg(F.count("*").alias("total"), F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("filled"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.sum(F.when(s == "F", 1).otherwise(0)).alias("affected"))

    @report("SELECT l_shipyear, count(DISTINCT l_partkey) AS total FROM (SELECT year(l_shipdate) AS l_shipyear, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'N') GROUP BY 1")
    def report_distinct_per_table(t):
        l = t("lineitem").where("l_returnflag <> 'N'").join(t("orders").where("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))  # noqa: E741
        return l.groupBy(F.year("l_shipdate").alias("l_shipyear")).agg(F.countDistinct("l_partkey").alias("total"))

    @report("SELECT n_name, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, CAST(0 AS BIGINT) AS none FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
    def report_count_filter(t):
        o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        return o.groupBy("n_name").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.lit(0).cast("long").alias("none"))

    @report("""WITH log AS (SELECT l_orderkey AS g, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS t, l_partkey AS k, l_suppkey AS s FROM lineitem),
x AS (SELECT DISTINCT coalesce(c.c_nationkey, s.s_nationkey) AS e, log.k, log.g, o_orderstatus AS st, 'via' AS via FROM log JOIN orders ON o_orderkey = g LEFT JOIN customer c ON c.c_custkey = o_custkey AND t = 'a' LEFT JOIN supplier s ON s.s_suppkey = log.s AND t = 'b'),
y AS (SELECT DISTINCT s_nationkey AS e, g, o_orderstatus AS st FROM log JOIN orders ON o_orderkey = g JOIN supplier ON s_suppkey = log.s WHERE t = 'b'),
u AS (SELECT e, k, g, st, via FROM x UNION ALL SELECT e, NULL, g, st, 'direct' FROM y)
SELECT n_nationkey, n_name, count(DISTINCT k) FILTER (via = 'via') AS parts, count(DISTINCT g) FILTER (via = 'direct') AS direct, count(DISTINCT g) AS groups_, count(DISTINCT g) FILTER (st = 'O') AS open, count(DISTINCT g) FILTER (st = 'F') AS filled FROM u JOIN nation ON n_nationkey = e GROUP BY 1, 2""")
    def report_count_distinct_filter(t):
        log = t("lineitem").select(F.col("l_orderkey").alias("g"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("t"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s")).join(t("orders").select(F.col("o_orderkey").alias("g"), "o_custkey", F.col("o_orderstatus").alias("st")), "g")
        c, s = t("customer").select("c_custkey", "c_nationkey"), t("supplier").select("s_suppkey", "s_nationkey")
        x = log.join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("t") == "a"), "left").join(s, (F.col("s_suppkey") == F.col("s")) & (F.col("t") == "b"), "left")
        x = x.select(F.coalesce("c_nationkey", "s_nationkey").alias("e"), "k", "g", "st", (F.col("t") == "b").alias("direct")).where("e IS NOT NULL")
        # Two levels of plain counts, and not countDistinct, which would hold every row once for each of the five.
        parts = x.groupBy("e", "k").agg(F.lit(1).alias("one")).groupBy("e").agg(F.count("k").alias("parts"))
        once = x.groupBy("e", "g").agg(F.max("direct").alias("direct"), F.max(F.coalesce(F.col("st") == "O", F.lit(False))).alias("o"), F.max(F.coalesce(F.col("st") == "F", F.lit(False))).alias("f"))
        seen = F.col("g").isNotNull()
        groups = once.groupBy("e").agg(F.count_if(seen & F.col("direct")).alias("direct"), F.count_if(seen).alias("groups_"), F.count_if(seen & F.col("o")).alias("open"), F.count_if(seen & F.col("f")).alias("filled"))
        n = t("nation").select(F.col("n_nationkey").alias("e"), "n_nationkey", "n_name")
        return n.join(groups, "e").join(parts, "e").select("n_nationkey", "n_name", "parts", "direct", "groups_", "open", "filled")

    @report("SELECT c_nationkey AS nation, c_custkey AS customer, NULL::BIGINT AS supplier, 'customer' AS via FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey, 'supplier' FROM supplier")
    def report_union_null_pad(t):
        a = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.lit(None).cast("long").alias("supplier"), F.lit("customer").alias("via"))
        return a.unionByName(t("supplier").select(F.col("s_nationkey").alias("nation"), F.lit(None).cast("long").alias("customer"), F.col("s_suppkey").alias("supplier"), F.lit("supplier").alias("via")))

    @report("""WITH n AS (SELECT l_orderkey AS k, l_returnflag AS f, count(DISTINCT l_partkey) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY ALL), j AS (SELECT k, string_agg(f || '=' || total, ',' ORDER BY f) AS b, sum(total) AS s FROM n GROUP BY k)
SELECT o_orderkey, coalesce(b, '') AS breakdown, CAST(coalesce(s, 0) AS BIGINT) AS total FROM orders LEFT JOIN j ON k = o_orderkey""")
    def report_nested_breakdown(t):
        n = t("lineitem").where("l_quantity > 10").groupBy("l_orderkey", "l_returnflag").agg(F.countDistinct("l_partkey").alias("total"))
        j = n.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "total"))).alias("b"), F.sum("total").alias("s"))
        joined = t("orders").select("o_orderkey").join(j, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return joined.select("o_orderkey", F.coalesce(F.array_join(F.transform("b", lambda x: F.concat(x["l_returnflag"], F.lit("="), x["total"].cast("string"))), ","), F.lit("")).alias("breakdown"), F.coalesce("s", F.lit(0)).alias("total"))

    @report("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
    def report_semi_filter(t):
        return t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")

    @report("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'cion') OR len(list_filter(string_split(text, chr(10)), lambda m: contains(strip_accents(lower(m)), 'ung_e'))) > 0")
    def report_fold_search(t):
        return t("documents").where(text.contains_folded(F.col("text"), "Ción") | F.exists(F.split("text", "\n"), lambda m: text.contains_folded(m, "üng_e"))).select("doc_id")

    @report("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price FROM orders ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20")
    def report_page_nulls_last(t):
        o = t("orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("price"))
        return page(o, 2, 20, F.desc_nulls_last("price"), "o_orderkey")

    @report("SELECT count(DISTINCT o_custkey) AS total FROM orders WHERE o_totalprice > 1000")
    def report_page_total(t):
        return t("orders").where("o_totalprice > 1000").agg(F.countDistinct("o_custkey").alias("total"))

    @report("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
    def report_distinct_on_first(t):
        return t("orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("f")).select("o_custkey", "f.o_orderkey", "f.o_totalprice")

    @report("""WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS parent_id, c_mktsegment FROM customer)
SELECT parent_id, n_name, count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM g JOIN nation ON n_nationkey = TRY_CAST(parent_id AS INTEGER) WHERE regexp_full_match(parent_id, '[0-9]{1,9}') GROUP BY 1, 2""")
    def report_regex_cast_join(t):
        g = t("customer").select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_nationkey").cast("string")).alias("parent_id"), "c_mktsegment").where(F.col("parent_id").rlike("^[0-9]{1,9}$"))
        return g.join(t("nation"), F.col("parent_id").try_cast("int") == F.col("n_nationkey")).groupBy("parent_id", "n_name").agg(F.count("*").alias("total"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))

    @report("SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE l_returnflag END AS label, count(*) AS total FROM lineitem GROUP BY 1, 2")
    def report_label_lookup(t):
        return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("total")).select("l_returnflag", label(F.col("l_returnflag"), {"R": "Returned", "A": "Accepted"}).alias("label"), "total")

    @report("SELECT l_suppkey, l_returnflag, count(*) AS total, string_agg(l_orderkey || '.' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS rows_ FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2")
    def report_detail_grouped(t):
        g = t("lineitem").where("l_quantity > 40").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("r"))
        return g.select("l_suppkey", "l_returnflag", "total", F.array_join(F.transform("r", lambda x: F.concat_ws(".", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"))), ",").alias("rows_")).orderBy("l_suppkey", F.desc("total"))

    @report("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
    def report_latest_runs(t):
        return t("events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)

    @report("SELECT c_nationkey, n_name, count(*) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 ORDER BY total DESC, c_nationkey LIMIT 50")
    def report_ranking_top50(t):
        # The count comes before the join: names are looked up once per nation.
        n = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("total"))
        return n.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_nationkey", "n_name", "total").orderBy(F.desc("total"), "c_nationkey").limit(50)

    @report("SELECT o_orderkey, list_filter([c_name, n_name], lambda x: x IS NOT NULL) AS names FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
    def report_hash_lookup(t):
        o = t("orders").join(t("customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        return o.select("o_orderkey", F.filter(F.array("c_name", "n_name"), lambda x: x.isNotNull()).alias("names"))

    return out
