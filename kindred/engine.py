"""The service's operations over a snapshot store: detection, enrichment, merging, undo, and the reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import cluster, context, detect, impact, merge, resolve, verdict
from kindred.plans import reports
from kindred.session import durable
from kindred.sources.snapshot import Snapshots
from kindred.sources.tables import LOOKUPS, SERVICE, by_id, empty, fresh
from kindred.spec import CITY, CONDO, DISCARDED, DISTRICT, EXECUTED, PENDING, PLACES, REVERTED, STATUS, STREET, TYPE_LABEL, EntitySpec

GROUPS, LOG, RUNS, CONTEXT = SERVICE


class NotFound(LookupError):
    pass


def change(f: Callable) -> Callable:
    """A method that reads one version of the store from its begin to its end and commits on top of that. If someone else has committed meanwhile, ConflictError is raised and nothing changes."""

    @wraps(f)
    def run(self, *args, **kw):
        if self._base is not None:
            return f(self, *args, **kw)
        self._base = self.store.version()
        try:
            return f(self, *args, **kw)
        finally:
            self._base = None

    return run


class Engine:
    """The service. Every change is one commit on top of the version that it has read.

    validator: asked by scan() and revalidate() about groups that the verdicts table doesn't know, ten at a time:
    a list of dicts (group_id, kind, names, ids, context) in, a list of verdicts (dup, confidence, name, why, valid_ids) or None out.
    """

    def __init__(self, spark: SparkSession, store: Snapshots, specs: dict[int, EntitySpec] = PLACES, threshold: float = detect.THRESHOLD, limit: int = detect.LIMIT, validator: Callable[[list[dict]], list[dict | None]] | None = None, cache_days: int | None = None):
        self.spark, self.store, self.specs, self.threshold, self.limit, self.validator, self.cache_days = spark, store, specs, threshold, limit, validator, cache_days
        self._base: int | None = None

    # Tables

    def table(self, name: str) -> DataFrame:
        if self.store.has(name, self._base):
            df = self.store.read(name, self._base)
            # Look-ups are a cache: entries that are too old count as unknown, if they say when they were fetched.
            return fresh(df, self.cache_days) if self.cache_days is not None and name in LOOKUPS and "fetched_at" in df.columns else df
        if name in SERVICE or name in LOOKUPS:
            return empty(self.spark, name)
        raise NotFound(name)

    def _tables(self, spec: EntitySpec) -> dict[str, DataFrame]:
        return {r.table: self.table(r.table) for r in spec.refs if self.store.has(r.table, self._base)}

    def _spec(self, kind: int) -> EntitySpec:
        from dataclasses import replace

        spec = self.specs[kind]
        return replace(spec, refs=tuple(r for r in spec.refs if self.store.has(r.table, self._base)))

    def _group(self, group_id: str) -> dict:
        rows = by_id(self.table(GROUPS), group_id).limit(1).collect()
        if not rows:
            raise NotFound(group_id)
        return rows[0].asDict()

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        self._base = self.store.commit(tables, self._base)

    @change
    def remember(self, table: str, entries: DataFrame, keys: list[str]) -> None:
        """Put entries into a look-up table, with the time; what it had under the same keys goes. Entries of null results are remembered like others."""
        new = entries.withColumn("fetched_at", F.current_timestamp())
        if self.store.has(table, self._base):
            old = self.store.read(table, self._base)
            if "fetched_at" not in old.columns:
                old = old.withColumn("fetched_at", F.current_timestamp())
            new = old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
        self._commit({table: new})

    @change
    def forget(self, table: str, keys: DataFrame) -> None:
        """Take the entries with these keys out of a look-up table."""
        if self.store.has(table, self._base):
            self._commit({table: self.store.read(table, self._base).join(keys.distinct(), keys.columns, "left_anti")})

    def health(self) -> dict:
        return {"status": "ok", "version": self.store.version()}

    # Detection

    def _rows(self, kind: int) -> DataFrame:
        spec = self.specs[kind]
        if kind == CONDO and spec is PLACES[CONDO]:
            return detect.condo_records(self.table("condominio"), self.table("logradouro"), self.table("bairro"), self.table("cidade"))
        return detect.records(self.table(spec.table), spec)

    def pairs(self, kind: int, parent: str | None = None, filter_first: bool = False, groups: DataFrame | None = None) -> DataFrame:
        """The best similar pairs that are not grouped yet. The limit comes before that filter, unless filter_first. groups: the existing ones, if not those of the store."""
        rows = self._rows(kind).withColumn("id", F.col("id").cast("string")) if kind != CITY else self._rows(kind)
        known = detect.grouped_ids(self.table(GROUPS) if groups is None else groups, kind)
        found = detect.similar_pairs(rows, self.specs[kind], self.threshold, parent, None if filter_first else self.limit)
        if kind == CITY:
            found = found.withColumns({c: F.col(c).cast("string") for c in ("id_a", "id_b")})
        found = detect.without_grouped(found, known)
        return detect.best(found, self.limit) if filter_first else found

    def scan_sync(self, kinds: list[int] | None = None, parent: str | None = None, groups: DataFrame | None = None) -> DataFrame:
        """Groups that a scan would make; nothing is stored."""
        parts = [cluster.groups(durable(self.pairs(k, parent, groups=groups)), k) for k in (kinds or list(self.specs))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @change
    def scan(self, kinds: list[int] | None = None) -> dict:
        """Replace the pending groups of the kinds by what is found now, judged by the verdicts, and log the run: its start at once, its end in the commit that brings the groups."""
        began, run_id, kinds = time.monotonic(), uuid.uuid4().hex, kinds or list(self.specs)
        self._commit({RUNS: self._runs(run_id, "scan", "iniciado", 0, 0, began, None)})
        try:
            old = self.table(GROUPS)
            replaced = (F.col("status") == PENDING) & F.col("tipo_entidade").isin(kinds)
            # Groups that a scan replaces must not stand in its own way.
            keep, gone = old.where(~replaced), old.where(replaced).select(F.col("id").alias("grupo_id"))
            found = durable(self.scan_sync(kinds, groups=keep))
            seen = found.agg(F.coalesce(F.sum(F.size("registro_ids")), F.lit(0)).alias("n")).first()["n"]
            found = found.withColumn("group_id", F.sha2(F.concat_ws("|", "tipo_entidade", F.array_join("registro_ids", ",")), 256))
            judged = verdict.apply(found, self._verdicts(found.select("group_id", "tipo_entidade", "registro_ids", "nomes_membros", F.col("parent_id").alias("context"))))
            new = self._shape(judged.withColumnRenamed("group_id", "id"), GROUPS, fonte=F.lit("trigram"), status=F.lit(PENDING), total_registros_afetados=F.lit(0), data_criacao=F.current_timestamp())
            new = durable(new)
            out = {"analisados": int(seen), "grupos": new.count()}
            rest = {t: self.table(t).join(gone, "grupo_id", "left_anti") for t in (LOG, CONTEXT)}
            self._commit({GROUPS: keep.unionByName(new), **rest, RUNS: self._runs(run_id, "scan", "concluido", out["analisados"], out["grupos"], began, None)})
            return out
        except Exception as e:
            self._base = self.store.version()
            self._commit({RUNS: self._runs(run_id, "scan", "erro", 0, 0, began, str(e)[:500])})
            raise

    def _verdicts(self, groups: DataFrame) -> DataFrame:
        """(group_id, verdict): those of the table, and the validator's on groups that it lacks. groups: (group_id, tipo_entidade, registro_ids, nomes_membros, context)."""
        known = self.table("verdicts").select("group_id", "verdict")
        if self.validator is None:
            return known
        asked = verdict.ask(groups.join(known.select("group_id"), "group_id", "left_anti"), self.validator, TYPE_LABEL)
        return known.unionByName(durable(asked))

    def _shape(self, df: DataFrame, name: str, **values: Column) -> DataFrame:
        """df with exactly the declared columns of a service table; missing ones are null."""
        schema = empty(self.spark, name).schema
        return df.select(*((values[f.name] if f.name in values else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def _runs(self, run_id: str, kind: str, status: str, seen: int, groups: int, began: float, error: str | None) -> DataFrame:
        """The table of runs with one row for this run, in its latest state."""
        row = self.spark.createDataFrame([(run_id, kind, status, seen, groups, int(1000 * (time.monotonic() - began)), error)], "id string, tipo string, status string, total_analisados int, total_grupos int, duracao_ms long, erro string").withColumn("data_execucao", F.current_timestamp())
        return self.table(RUNS).where(F.col("id") != run_id).unionByName(row)

    def history(self, n: int = 20) -> DataFrame:
        return reports.latest_runs(self.table(RUNS), n)

    # Enrichment

    def _members(self, groups: DataFrame) -> DataFrame:
        return groups.select(F.col("id").alias("group_id"), "tipo_entidade", F.posexplode(F.arrays_zip("registro_ids", "nomes_membros")).alias("pos", "m")).select("group_id", "tipo_entidade", "pos", F.col("m.registro_ids").alias("registro_id"), F.col("m.nomes_membros").alias("name"))

    def contexts(self, groups: DataFrame) -> DataFrame:
        """Hierarchy context of every member, of all four kinds at once."""
        m = self._members(groups)
        city = self.table("cidade")
        out = []
        base = {CITY: lambda: context.child_counts(city.select(F.col("id").cast("string").alias("registro_id"), F.col("id").alias("cidade_id"), F.col("nome").alias("cidade_nome"), F.col("estado_id").alias("estado_sigla")), "cidade_id", self.table("bairro"), "cidade_id", "total_bairros", "excluido"), DISTRICT: lambda: self._district_context(city), STREET: lambda: self._street_context(city), CONDO: lambda: context.chain(self.table("bairro"), city, self.table("logradouro"), self.table("condominio")).withColumn("registro_id", F.col("condominio_id").cast("string"))}
        for kind, facts in base.items():
            if kind not in self.specs or not self.store.has(self.specs[kind].table, self._base):
                continue
            f = facts()
            if "ceps" not in f.columns and "cep" in f.columns:
                f = f.withColumn("ceps", F.array_compact(F.array("cep")))
            mine = m.where(F.col("tipo_entidade") == kind).select(F.col("group_id").alias("grupo_id"), "registro_id")
            out.append(self._shape(mine.join(f, "registro_id"), CONTEXT))
        result = out[0]
        for x in out[1:]:
            result = result.unionByName(x)
        return context.dedupe(result)

    def _district_context(self, city: DataFrame) -> DataFrame:
        d = context.chain(self.table("bairro"), city)
        d = context.child_counts(d, "bairro_id", self.table("logradouro"), "bairro_id", "total_logradouros", "excluido")
        return d.join(context.first_ceps(self.table("logradouro")), "bairro_id", "left").withColumn("registro_id", F.col("bairro_id").cast("string"))

    def _street_context(self, city: DataFrame) -> DataFrame:
        s = context.chain(self.table("bairro"), city, self.table("logradouro"))
        return context.child_counts(s, "logradouro_id", self.table("condominio"), "logradouro_id", "total_condominios", "excluido").withColumn("registro_id", F.col("logradouro_id").cast("string"))

    @change
    def enrich(self, only_missing: bool = True) -> int:
        """Contexts, official names and suggestions for pending groups, by one plan per kind; a lasting commit."""
        groups = self.table(GROUPS)
        todo = durable(groups.where((F.col("status") == PENDING) & (F.col("nome_oficial").isNull() if only_missing else F.lit(True))))
        ctx = durable(self.contexts(todo))
        members = self._members(todo).join(ctx.withColumnRenamed("grupo_id", "group_id"), ["group_id", "registro_id"], "left")
        ceps = members.select("group_id", "tipo_entidade", (F.col("pos") * 1000).alias("base"), F.posexplode("ceps").alias("k", "cep")).select("group_id", "tipo_entidade", (F.col("base") + F.col("k")).alias("pos"), "cep")
        ref_c, geo = self.table("ref_ceps"), self.table("ref_geocode")
        of = lambda df, kind: df.where(F.col("tipo_entidade") == kind)
        ask = lambda kind, *parts: of(members, kind).groupBy("group_id").agg(F.min_by(text.join_parts(*parts), "pos").alias("query"))
        name, city, state = F.col("name"), F.col("cidade_nome"), F.col("estado_sigla")
        ids = lambda kind: of(todo, kind).select(F.col("id").alias("group_id"))
        found = [
            resolve.cascade(ids(CITY), resolve.city_name(of(members, CITY).select("group_id", "name", "pos", state.alias("uf")), self.table("ref_cities")), resolve.geocoded(ask(CITY, name, state), geo, CITY)),
            resolve.cascade(ids(DISTRICT), resolve.district_name(of(ceps, DISTRICT), ref_c), resolve.geocoded(ask(DISTRICT, name, city, state), geo, DISTRICT)),
            resolve.cascade(ids(STREET), resolve.street_name(of(ceps, STREET), ref_c), resolve.geocoded(ask(STREET, name, F.col("bairro_nome"), city, state), geo, STREET)),
            resolve.condo_name(of(members, CONDO).select("group_id", "pos", "name", city.alias("cidade"), state.alias("uf")), self.table("ref_places"), geo),
        ]
        names = found[0]
        for x in found[1:]:
            names = names.unionByName(x)
        names = durable(names.where(F.col("official").isNotNull()))
        pick = resolve.suggested(members.select("group_id", "pos", F.col("registro_id").alias("id"), "name"), names)
        facts = names.join(pick, "group_id", "left").select(F.col("group_id").alias("_g"), F.col("official.name").alias("_n"), F.col("official.source").alias("_s"), F.col("official.address").alias("_a"), F.col("member_id").alias("_m"))
        new = {"nome_oficial": "_n", "fonte_oficial": "_s", "endereco_google": "_a", "canonico_sugerido_id": "_m"}
        out = groups.join(facts, groups["id"] == F.col("_g"), "left").select(*(F.coalesce(F.col(new[c]), groups[c]).alias(c) if c in new else groups[c] for c in groups.columns))
        rest = self.table(CONTEXT).join(ctx.select("grupo_id").distinct(), "grupo_id", "left_anti")
        self._commit({GROUPS: out, CONTEXT: rest.unionByName(ctx.select(*rest.columns))})
        return names.count()

    @change
    def re_enrich_addresses(self) -> int:
        """Addresses from the geocoder for groups that have an official name but no address."""
        groups = self.table(GROUPS)
        ctx = context.dedupe(self.table(CONTEXT)).groupBy("grupo_id").agg(F.min_by(F.struct("bairro_nome", "cidade_nome", "estado_sigla"), "registro_id").alias("c"))
        todo = groups.where(F.col("nome_oficial").isNotNull() & F.col("endereco_google").isNull() & F.col("status").isin(PENDING, EXECUTED)).join(ctx, F.col("id") == F.col("grupo_id"))
        q = todo.select("id", text.join_parts(F.col("nome_oficial"), F.col("c.bairro_nome"), F.col("c.cidade_nome"), F.col("c.estado_sigla")).alias("query"))
        hit = durable(q.join(self.table("ref_geocode").where("formatted_address IS NOT NULL"), "query").groupBy(F.col("id").alias("_g")).agg(F.min("formatted_address").alias("_a")))
        self._commit({GROUPS: groups.join(hit, groups["id"] == F.col("_g"), "left").select(*(F.coalesce(F.col("_a"), groups[c]).alias(c) if c == "endereco_google" else groups[c] for c in groups.columns))})
        return hit.count()

    @change
    def revalidate(self) -> dict:
        """Put the verdicts table's answers on pending groups that have none; groups of rejected verdicts are discarded."""
        groups = self.table(GROUPS)
        ask = groups.where((F.col("status") == PENDING) & ~F.coalesce(F.col("detalhes_llm").contains('"saoDuplicatas"'), F.lit(False)))
        v = self._verdicts(ask.select(F.col("id").alias("group_id"), "tipo_entidade", "registro_ids", "nomes_membros", F.col("parent_nome").alias("context"))).withColumnRenamed("group_id", "_g")
        todo = (F.col("status") == PENDING) & F.col("verdict").isNotNull() & ~F.coalesce(F.col("detalhes_llm").contains('"saoDuplicatas"'), F.lit(False))
        stored = F.to_json(F.struct(F.col("verdict.dup").alias("saoDuplicatas"), F.col("verdict.confidence").alias("confianca"), F.col("verdict.name").alias("nomeCanonico"), F.col("verdict.why").alias("justificativa"), F.col("verdict.valid_ids").alias("membrosValidos")))
        out = durable(groups.join(v, groups["id"] == F.col("_g"), "left").withColumn("_todo", todo).withColumn("detalhes_llm", F.when(F.col("_todo"), stored).otherwise(F.col("detalhes_llm"))).withColumn("status", F.when(F.col("_todo") & ~F.col("verdict.dup"), F.lit(DISCARDED)).otherwise(F.col("status")).cast("smallint")))
        n = out.agg(F.count_if("_todo").alias("validados"), F.count_if(F.col("_todo") & ~F.col("verdict.dup")).alias("descartados")).first()
        self._commit({GROUPS: out.select(*groups.columns)})
        return n.asDict()

    # Merging

    def _write_merge(self, chosen: DataFrame, kind: int, who: str, names: DataFrame | None, decision: Column | None = None) -> int:
        """Merge groups (with registro_canonico_id) of one kind: every child table is rewritten once, whatever the number of groups."""
        spec, groups = self._spec(kind), self.table(GROUPS)
        pairs = durable(merge.mapping(chosen))
        tables = self._tables(spec)
        out = {}
        for r in spec.refs:
            child = out.get(r.table, tables[r.table])
            typed = pairs.select("grupo_id", *(F.col(c).cast(child.schema[r.column].dataType).alias(c) for c in ("old", "new")))
            out[r.table] = merge.redirect(child, r.column, typed)
        logs = [merge.log_rows(r, tables[r.table], pairs.select("grupo_id", *(F.col(c).cast(tables[r.table].schema[r.column].dataType).alias(c) for c in ("old", "new")))) for r in spec.refs]
        own = self.table(spec.table)
        typed = pairs.select(F.col("old").cast(own.schema[spec.id_col].dataType).alias("old"))
        if spec.soft_delete:
            own = merge.soft_delete(out.get(spec.table, own), spec, typed)
        if names is not None:
            own, renamed = merge.rename(own, spec, names.select("grupo_id", F.col("id").cast(own.schema[spec.id_col].dataType).alias("id"), "name"))
            logs.append(renamed)
        if spec.soft_delete or names is not None:
            out[spec.table] = own
        log = self._empty_log()
        for x in logs:
            log = log.unionByName(x)
        log = durable(log)
        n = merge.affected(log).select(F.col("grupo_id").alias("_g"), F.col("total_registros_afetados").alias("_n"))
        c = chosen.select(F.col("id").alias("_c"), F.col("registro_canonico_id").alias("_r"), F.col("nome_canonico").alias("_nome"))
        g = groups.join(c, groups["id"] == F.col("_c"), "left").join(n, F.col("_c") == F.col("_g"), "left")
        hit = F.col("_c").isNotNull()
        new = {"status": F.lit(EXECUTED), "registro_canonico_id": F.col("_r"), "total_registros_afetados": F.coalesce("_n", F.lit(0)), "executado_por": F.lit(who), "data_execucao": F.current_timestamp()}
        new["nome_canonico"] = F.coalesce("_nome", groups["nome_canonico"])
        if decision is not None:
            new["decisao_contexto"] = decision
        out[GROUPS] = g.select(*(F.when(hit, new[k]).otherwise(groups[k]).cast(groups.schema[k].dataType).alias(k) if k in new else groups[k] for k in groups.columns))
        old = self.table(LOG)
        out[LOG] = old.unionByName(self._shape(log, LOG, data_execucao=F.current_timestamp()))
        self._commit(out)
        return log.count()

    def _empty_log(self) -> DataFrame:
        return self.spark.createDataFrame([], merge.LOG)

    @change
    def merge(self, group_id: str, canonical: str, who: str, name: str | None = None) -> int:
        """Merge one group into a member; the number of rows rewritten."""
        g = self._group(group_id)
        merge.check(g["status"], "merge")
        merge.check_canonical(g["registro_ids"], canonical)
        chosen = by_id(self.table(GROUPS), group_id).withColumn("registro_canonico_id", F.lit(canonical)).withColumn("nome_canonico", F.coalesce(F.lit(name), F.col("nome_canonico")))
        names = chosen.select(F.col("id").alias("grupo_id"), F.lit(canonical).alias("id"), F.lit(name).alias("name")) if name else None
        return self._write_merge(chosen, g["tipo_entidade"], who, names)

    @change
    def approve(self, group_id: str, who: str) -> int:
        """Merge a group as its enrichment suggests."""
        g = self._group(group_id)
        if not g["canonico_sugerido_id"]:
            raise merge.StateError("the group has no suggestion")
        merge.check(g["status"], "merge")
        merge.check_canonical(g["registro_ids"], g["canonico_sugerido_id"])
        return self._write_suggested(by_id(self.table(GROUPS), group_id), g["tipo_entidade"], who)

    def _write_suggested(self, chosen: DataFrame, kind: int, who: str) -> int:
        chosen = chosen.withColumn("registro_canonico_id", F.col("canonico_sugerido_id")).withColumn("nome_canonico", F.coalesce("nome_oficial", "nome_canonico"))
        names = chosen.where(F.col("nome_oficial").isNotNull()).select(F.col("id").alias("grupo_id"), F.col("registro_canonico_id").alias("id"), F.col("nome_oficial").alias("name"))
        return self._write_merge(chosen, kind, who, names, merge.decision_context(self.table(GROUPS)))

    @change
    def approve_batch(self, who: str, least: float = verdict.AUTO_APPROVE) -> dict:
        """Merge all groups that may be approved without a person: one plan per kind, not one per group.

        A group whose suggestion is no member counts as an error and stays. Groups that share a record wait for the next batch.
        """
        total = {"aprovados": 0, "registros": 0, "erros": 0, "adiados": 0}
        for kind in self.specs:
            every = durable(verdict.auto_approvable(self.table(GROUPS), least).where(F.col("tipo_entidade") == kind))
            ready = every.where(F.array_contains("registro_ids", F.col("canonico_sugerido_id")))
            first = ready.select("id", F.explode("registro_ids").alias("r")).groupBy("r").agg(F.min("id").alias("first"))
            clash = ready.select("id", F.explode("registro_ids").alias("r")).join(first, "r").where("id <> first").select("id").distinct()
            chosen = durable(ready.join(clash, "id", "left_anti").select(*ready.columns))
            n, fit, most = chosen.count(), ready.count(), every.count()
            total["erros"] += most - fit
            total["adiados"] += fit - n
            if n:
                total["registros"] += self._write_suggested(chosen, kind, who)
                total["aprovados"] += n
        return total

    def _revert(self, ids: DataFrame, kinds: list[int]) -> None:
        """Undo all merges of the groups ids (id) at once: every value goes back to the oldest that the log has of it, so each table is rewritten once."""
        groups, log = self.table(GROUPS), self.table(LOG)
        mine = durable(log.join(ids.select(F.col("id").alias("grupo_id")), "grupo_id", "left_semi").where(~F.col("revertido")))
        chosen = durable(groups.join(ids, "id", "left_semi"))
        out: dict[str, DataFrame] = {}
        for kind in kinds:
            spec = self._spec(kind)
            for r in spec.refs:
                out[r.table] = merge.restore(out.get(r.table, self.table(r.table)), r, mine)
            own = out.get(spec.table, self.table(spec.table))
            id_type = own.schema[spec.id_col].dataType
            if spec.soft_delete:
                pairs = merge.mapping(chosen.where(F.col("tipo_entidade") == kind))
                own = merge.soft_delete(own, spec, pairs.select(F.col("old").cast(id_type).alias("old")), False)
            before = mine.where((F.col("tabela_afetada") == spec.table) & (F.col("coluna_alterada") == spec.name_col))
            before = before.groupBy("registro_afetado_id").agg(F.min_by(F.struct("grupo_id", "valor_anterior"), F.struct("data_execucao", "grupo_id")).alias("b"))
            out[spec.table], _ = merge.rename(own, spec, before.select("b.grupo_id", F.col("registro_afetado_id").cast(id_type).alias("id"), F.col("b.valor_anterior").alias("name")))
        out[LOG] = merge.mark_reverted(log, ids.select(F.col("id").alias("grupo_id"))).withColumn("data_reversao", F.when(F.col("revertido"), F.coalesce("data_reversao", F.current_timestamp())))
        out[GROUPS] = merge.set_status(groups, ids, REVERTED, data_reversao=F.current_timestamp())
        self._commit(out)

    @change
    def revert(self, group_id: str) -> None:
        """Undo a merge: references, names and deleted members come back."""
        g = self._group(group_id)
        merge.check(g["status"], "revert")
        self._revert(durable(by_id(self.table(GROUPS), group_id).select("id")), [g["tipo_entidade"]])

    @change
    def revert_all(self) -> int:
        """Undo all merges, also those that build on one another, with one rewrite of each table."""
        done = durable(self.table(GROUPS).where(F.col("status") == EXECUTED).select("id", "tipo_entidade"))
        counts = {r["tipo_entidade"]: r["count"] for r in done.groupBy("tipo_entidade").count().collect()}
        if counts:
            self._revert(done.select("id"), sorted(counts))
        return sum(counts.values())

    @change
    def discard(self, group_id: str, who: str) -> None:
        merge.check(self._group(group_id)["status"], "discard")
        ids = by_id(self.table(GROUPS), group_id).select("id")
        self._commit({GROUPS: merge.set_status(self.table(GROUPS), ids, DISCARDED, executado_por=F.lit(who), data_execucao=F.current_timestamp())})

    # Views

    def groups(self, page: int = 1, size: int = 20, kind: int | None = None, status: int | None = PENDING, parent: str | None = None, search: str | None = None, exact: bool = False) -> tuple[DataFrame, int]:
        """(a page of groups with labels and the parent's name, total). A search folds case and accents, unless exact."""
        g = self.table(GROUPS)
        for column, value in (("tipo_entidade", kind), ("status", status), ("parent_id", parent)):
            if value is not None:
                g = g.where(F.col(column) == value)
        if search:
            g = g.where(F.col("nome_normalizado").contains(search) if exact else text.contains_folded(F.col("nome_normalizado"), search))
        names = None
        for table in ("cidade", "bairro"):
            if self.store.has(table, self._base):
                n = self.table(table).select(F.col("id").cast("string").alias("_p"), F.col("nome").alias("_n")).groupBy("_p").agg(F.min("_n").alias("_n"))
                names = n if names is None else names.unionByName(n)
        out = reports.page(g, page, size, F.desc("data_criacao"), "id").withColumn("tipo_label", reports.label(F.col("tipo_entidade").cast("int"), TYPE_LABEL, F.lit("Desconhecido"))).withColumn("status_label", reports.label(F.col("status").cast("int"), STATUS, F.lit("Desconhecido")))
        if names is not None:
            names = names.groupBy("_p").agg(F.min("_n").alias("_n"))
            out = out.join(names, F.col("parent_id") == F.col("_p"), "left").withColumn("parent_nome", F.coalesce("_n", "parent_nome")).drop("_p", "_n")
        return out, g.count()

    def auto_approvable(self) -> DataFrame:
        return verdict.auto_approvable(self.table(GROUPS)).orderBy("data_criacao", "id")

    def impact(self, group_id: str) -> DataFrame:
        g = self._group(group_id)
        spec = self._spec(g["tipo_entidade"])
        members = self._members(by_id(self.table(GROUPS), group_id)).select("group_id", "pos", F.col("registro_id").alias("id"), "name")
        tables = {t: df.withColumns({r.column: F.col(r.column).cast("string") for r in spec.refs if r.table == t}) for t, df in self._tables(spec).items()}
        return impact.per_member(members, spec.refs, tables).orderBy(F.desc("total"), "pos")

    def with_children(self, groups: DataFrame) -> DataFrame:
        """groups with the log rows and the contexts of each as arrays of structs."""
        ctx = context.dedupe(self.table(CONTEXT))
        return merge.nested(merge.nested(groups, self.table(LOG), "logs", "data_execucao", "registro_afetado_id", "coluna_alterada", "tabela_afetada"), ctx, "contextos", "registro_id")

    def group(self, group_id: str) -> dict:
        """A group with its log and its contexts, in one row, and the impact of its members."""
        rows = self.with_children(by_id(self.table(GROUPS), group_id)).limit(1).collect()
        if not rows:
            raise NotFound(group_id)
        return {"grupo": rows[0].asDict(), "membros": self.impact(group_id)}

    def stats(self) -> DataFrame:
        last = self.table(RUNS).agg(F.max_by(F.struct("tipo", "status", "duracao_ms", "data_execucao"), F.struct("data_execucao", "id")).alias("ultima_execucao"))
        return reports.dashboard(self.table(GROUPS)).crossJoin(last)

    def ranking(self) -> DataFrame:
        return reports.by_city(self.table(GROUPS), self.table("cidade"), 50)

    def cities(self) -> DataFrame:
        c = reports.by_city(self.table(GROUPS), self.table("cidade"))
        return c.select(F.col("parent_id").alias("id"), F.concat_ws(" - ", "cidade_nome", "estado_sigla").alias("nome"), F.col("total_grupos").alias("total"))

    def summary(self) -> tuple[DataFrame, DataFrame]:
        return reports.dashboard(self.table(GROUPS)), reports.by_table(self.table(LOG), self.table(GROUPS))

    def by_company(self) -> DataFrame:
        return reports.by_company(self.table(LOG), self.table(GROUPS), self.table("imovel"), self.table("imovel_endereco"), self.table("empresa"))

    def executed(self, page: int = 1, size: int = 20, kind: int | None = None, search: str | None = None, company: str | None = None) -> tuple[DataFrame, int]:
        extra = {"imovel": self.table("imovel"), "endereco": self.table("imovel_endereco")} if company else {}
        out = reports.executed(self.table(GROUPS), self.table(LOG), kind, search, company, **extra)
        return reports.page(out, page, size, F.desc_nulls_last("data_execucao"), "id"), out.count()

    def details(self, group_id: str) -> DataFrame:
        """Live log rows of a group by table, with the names that records have."""
        names = None
        for table, (key, name) in {"imovel": ("id", "titulo_amigavel"), "pessoa": ("id", "nome"), "empresa": ("id", "nome"), "bairro": ("id", "nome"), "logradouro": ("id", "nome"), "condominio": ("id", "nome"), "building": ("id", "nome")}.items():
            if self.store.has(table, self._base):
                n = self.table(table).select(F.lit(table).alias("tabela"), F.col(key).cast("string").alias("id"), F.col(name).alias("nome"))
                names = n if names is None else names.unionByName(n)
        names = self.spark.createDataFrame([], "tabela string, id string, nome string") if names is None else names
        return reports.details(self.table(LOG).where(F.col("grupo_id") == group_id), names)


def _routes() -> dict[str, Callable]:
    """The service's routes and what answers them."""
    e = Engine
    return {
        "GET /health": e.health, "GET /grupos": e.groups, "GET /grupos/auto-aprovaveis": e.auto_approvable, "GET /grupos/:id": e.group, "GET /grupos/:id/impacto": e.impact, "POST /grupos/revalidar-llm": e.revalidate,
        "PUT /grupos/:id/unificar": e.merge, "PUT /grupos/:id/reverter": e.revert, "PUT /grupos/:id/aprovar-sugestao": e.approve, "POST /grupos/aprovar-sugestoes-batch": e.approve_batch, "POST /grupos/reverter-todos": e.revert_all, "PUT /grupos/:id/descartar": e.discard,
        "POST /scan": e.scan, "POST /scan/sync": e.scan_sync, "POST /scan/enriquecer": e.enrich, "POST /scan/re-enriquecer-google": e.re_enrich_addresses, "GET /scan/historico": e.history,
        "GET /stats": e.stats, "GET /stats/ranking-cidades": e.ranking, "GET /stats/cidades": e.cities,
        "GET /relatorio/resumo": e.summary, "GET /relatorio/por-empresa": e.by_company, "GET /relatorio/grupos-executados": e.executed, "GET /relatorio/grupo/:id/detalhes": e.details, "GET /relatorio/grupo/:id/imoveis": e.details,
    }


ROUTES = _routes()
