import pytest
from pyspark.sql import functions as F

from kindred.engine import GROUPS, LOG, ROUTES, Engine
from kindred.operators.merge import StateError
from kindred.sources.snapshot import ConflictError, Snapshots
from kindred.spec import CONDO, DISTRICT, STREET


def state(engine, name):
    return sorted(map(str, (tuple(r) for r in engine.table(name).collect())))


@pytest.fixture
def engine(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    df = spark.createDataFrame
    store.commit({
        "cidade": df([(1, "Goiânia", "GO"), (2, "Goianira", "GO")], "id int, nome string, estado_id string"),
        "bairro": df([("d1", "Jardim Aurora", 1, False), ("d2", "Jd Aurora", 1, None), ("d3", "Centro", 1, False), ("d4", "Jardim Aurora", 2, False)], "id string, nome string, cidade_id int, excluido boolean"),
        "logradouro": df([("s1", "Rua Goiás", "d1", "74000001", False), ("s2", "R. Goiás", "d1", "74000002", False), ("s3", "Rua Um", "d2", "74000003", False)], "id string, nome string, bairro_id string, cep string, excluido boolean"),
        "condominio": df([("c1", "Reserva", "s1", False)], "id string, nome string, logradouro_id string, excluido boolean"),
        "empresa": df([("e1", "Casa", None, "d2", 1)], "id string, nome string, nome_fantasia string, bairro_id string, cidade_id int"),
        "imovel": df([("i1", "s2", "e1", "Lar")], "id string, logradouro_id string, empresa_id string, titulo_amigavel string"),
        "imovel_endereco": df([("i1", "d2", None)], "imovel_id string, bairro_comercial_id string, condominio_id string"),
        "ref_ceps": df([("74000001", "Rua Goiás", "Jardim Aurora", False), ("74000003", "Rua Um", "Jardim Aurora", False)], "cep string, logradouro string, bairro string, erro boolean"),
    })
    return Engine(spark, store)


def test_scan_enrich_merge_revert(engine):
    assert engine.scan([DISTRICT, STREET])["grupos"] == 2
    before = {t: state(engine, t) for t in ("bairro", "logradouro", "empresa", "imovel", "imovel_endereco")}
    assert engine.enrich() == 2
    g = {r["tipo_entidade"]: r for r in engine.table(GROUPS).collect()}
    assert g[DISTRICT]["nome_oficial"] == "Jardim Aurora" and g[DISTRICT]["canonico_sugerido_id"] == "d1"
    assert g[STREET]["nome_oficial"] == "Rua Goiás" and g[STREET]["canonico_sugerido_id"] == "s1"
    assert {r["id"]: r["total"] for r in engine.impact(g[DISTRICT]["id"]).collect()} == {"d1": 2, "d2": 3}
    assert engine.approve(g[DISTRICT]["id"], "me") == 3
    assert engine.table("empresa").first()["bairro_id"] == "d1"
    assert {r["id"] for r in engine.table("bairro").where("excluido").collect()} == {"d2"}
    with pytest.raises(StateError):
        engine.merge(g[DISTRICT]["id"], "d1", "me")
    assert engine.merge(g[STREET]["id"], "s2", "me", "Avenida Goiás") == 2
    assert engine.table("logradouro").where("id = 's2'").first()["nome"] == "Avenida Goiás"
    companies = {r["empresa_id"]: r for r in engine.by_company().collect()}
    assert companies["e1"]["total_grupos"] == 1 and companies["e1"]["total_imoveis"] == 1 and companies["e1"]["total_alteracoes_diretas"] == 1
    page, total = engine.executed(search="aurora")
    assert total == 1 and page.first()["total_fks"] == 3
    assert engine.executed(company="e1")[1] == 1 and engine.executed(kind=STREET)[1] == 1
    assert {r["tabela_afetada"] for r in engine.details(g[DISTRICT]["id"]).collect()} == {"logradouro", "imovel_endereco", "empresa"}
    assert engine.stats().first()["executados"] == 2
    assert engine.revert_all() == 2
    assert {t: [r.replace("None)", "False)") for r in state(engine, t)] for t in before} == {t: [r.replace("None)", "False)") for r in before[t]] for t in before}
    assert engine.table(LOG).where(~F.col("revertido")).count() == 0
    with pytest.raises(StateError):
        engine.revert(g[DISTRICT]["id"])
    engine.discard(g[DISTRICT]["id"], "me")
    assert engine.scan([DISTRICT])["grupos"] == 0
    assert engine.history().first()["status"] == "concluido"


def test_verdicts_and_batch(engine, spark):
    engine.scan([DISTRICT])
    engine.enrich()
    gid = engine.table(GROUPS).first()["id"]
    v = spark.createDataFrame([(gid, (True, 0.95, "Jardim Aurora", "", ["d1", "d2"]))], "group_id string, verdict struct<dup:boolean,confidence:double,name:string,why:string,valid_ids:array<string>>")
    engine.store.commit({"verdicts": v})
    assert engine.revalidate() == {"validados": 1, "descartados": 0}
    assert engine.auto_approvable().count() == 1 and engine.stats().first()["auto_aprovaveis"] == 1
    assert engine.ranking().first()["cidade_nome"] == "Goiânia" and engine.cities().first()["nome"] == "Goiânia - GO"
    page, total = engine.groups(search="AURORA")
    assert total == 1 and page.first()["parent_nome"] == "Goiânia"
    assert engine.approve_batch("batch") == {"aprovados": 1, "registros": 3, "erros": 0, "adiados": 0}
    whole = engine.group(gid)["grupo"]
    assert whole["status"] == 2 and len(whole["logs"]) == 3 and [c["registro_id"] for c in whole["contextos"]] == ["d1", "d2"]
    assert engine.groups(search="aurora", status=2)[1] == 1 and engine.groups(search="aurora", status=2, exact=True)[1] == 0


def test_snapshots_refuse_a_second_writer(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    base = s.commit({"t": spark.range(1)})
    s.commit({"t": spark.range(2)}, base)
    with pytest.raises(ConflictError):
        s.commit({"t": spark.range(3)}, base)
    assert s.read("t").count() == 2 and s.read("t", base).count() == 1


def test_routes():
    assert len(ROUTES) == 25


def test_a_second_writer_between_read_and_commit_is_refused(engine, monkeypatch):
    engine.scan([DISTRICT])
    engine.enrich()
    gid = engine.table(GROUPS).first()["id"]
    other = engine.spark.createDataFrame([("e9", "New", None, "d3", 1)], engine.table("empresa").schema)
    seen = []

    def between(spec):
        if not seen:
            seen.append(1)
            Snapshots(engine.spark, engine.store.root).commit({"empresa": other})
        return Engine._tables(engine, spec)

    monkeypatch.setattr(engine, "_tables", between)
    with pytest.raises(ConflictError):
        engine.approve(gid, "me")
    assert engine.table("empresa").first()["id"] == "e9" and engine.table(GROUPS).first()["status"] == 1
    monkeypatch.undo()
    assert engine.approve(gid, "me") == 2


def test_a_scan_that_fails_changes_nothing_and_leaves_a_trace(engine, monkeypatch):
    engine.scan([DISTRICT])
    before, version = state(engine, GROUPS), engine.store.version()
    states = []
    monkeypatch.setattr(engine, "_verdicts", lambda groups: states.append([r["status"] for r in engine.table("ms_execucao_log").collect()]) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.scan([DISTRICT])
    assert states == [["concluido", "iniciado"]] or sorted(states[0]) == ["concluido", "iniciado"]
    assert state(engine, GROUPS) == before and engine.store.version() == version + 2
    assert sorted(r["status"] for r in engine.history().collect()) == ["concluido", "erro"]


def test_undo_of_merges_that_build_on_one_another(engine, spark):
    """bairro d2 into d1, then d1 into d3; a link table whose key holds the merged column."""
    link = [("b1", "c1"), ("b1", "c2"), ("b2", "c2")]
    engine.store.commit({"condominio": spark.createDataFrame([("c1", "Reserva", "s1", False), ("c2", "Reserva II", "s1", False), ("c3", "Reserva 2", "s1", False)], "id string, nome string, logradouro_id string, excluido boolean"), "benfeitoria_condominio": spark.createDataFrame(link, "benfeitorias_id string, condominios_id string")})
    names = ("bairro", "logradouro", "empresa", "imovel_endereco", "condominio", "benfeitoria_condominio")
    before = {t: state(engine, t) for t in names}
    group = lambda i, kind, ids: (i, kind, ids, ids, 1)
    rows = [group("g1", DISTRICT, ["d1", "d2"]), group("g2", DISTRICT, ["d1", "d3"]), group("g3", CONDO, ["c1", "c2"]), group("g4", CONDO, ["c1", "c3"])]
    new = spark.createDataFrame(rows, "id string, tipo_entidade smallint, registro_ids array<string>, nomes_membros array<string>, status smallint")
    engine.store.commit({GROUPS: engine._shape(new, GROUPS)})
    engine.merge("g1", "d1", "me", "First")
    engine.merge("g2", "d3", "me")
    engine.merge("g3", "c1", "me")
    engine.merge("g4", "c3", "me")
    assert {r["bairro_id"] for r in engine.table("empresa").collect()} == {"d3"}
    assert state(engine, "benfeitoria_condominio") == ["('b1', 'c3')", "('b1', 'c3')", "('b2', 'c3')"]
    version = engine.store.version()
    assert engine.revert_all() == 4 and engine.store.version() == version + 1
    assert {t: [r.replace("None)", "False)") for r in state(engine, t)] for t in names} == {t: [r.replace("None)", "False)") for r in before[t]] for t in names}


def test_a_validator_is_asked_ten_at_a_time_about_unknown_groups(engine):
    asked = []

    def validator(batch):
        asked.append(len(batch))
        assert batch[0]["ids"] and batch[0]["names"] and batch[0]["kind"] in ("Bairro", "Logradouro")
        return [{"dup": b["kind"] == "Bairro", "confidence": 0.9, "name": "", "why": "", "valid_ids": [*b["ids"], "unknown"]} for b in batch]

    engine.validator = validator
    assert engine.scan([DISTRICT, STREET])["grupos"] == 1
    assert engine.table(GROUPS).first()["tipo_entidade"] == DISTRICT


def test_look_ups_are_a_cache(engine, spark):
    entry = lambda cep, street: spark.createDataFrame([(cep, street, None, False)], "cep string, logradouro string, bairro string, erro boolean")
    engine.remember("ref_ceps", entry("1", None), ["cep"])
    engine.remember("ref_ceps", entry("1", "Rua Nova"), ["cep"])
    assert {r["logradouro"] for r in engine.table("ref_ceps").where("cep = '1'").collect()} == {"Rua Nova"}
    engine.cache_days = 7
    assert engine.table("ref_ceps").count() == 3
    engine.store.commit({"ref_ceps": engine.table("ref_ceps").withColumn("fetched_at", F.when(F.col("cep") == "1", F.current_timestamp() - F.expr("INTERVAL 8 DAYS")).otherwise(F.col("fetched_at")))})
    assert engine.table("ref_ceps").count() == 2
    engine.forget("ref_ceps", spark.createDataFrame([("74000001",)], "cep string"))
    assert engine.table("ref_ceps").count() == 1
