import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import cluster, detect, merge, resolve, verdict
from kindred.spec import PLACES, FkRef, STREET

PAIRS = "id_a string, id_b string, name_a string, name_b string, parent_id string, score double"


def test_clusters(spark):
    rows = [("a", "b", "A", "B", "1", 0.8), ("b", "c", "B", "C", "1", 0.6), ("x", "y", "X", "Y", "2", 0.7)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = {r["root"]: r for r in cluster.groups(spark.createDataFrame(rows, PAIRS), 2).collect()}
        assert set(got) == {"a", "x"}
        assert got["a"]["registro_ids"] == ["a", "b", "c"] and got["a"]["nome_normalizado"] == "A" and float(got["a"]["score_medio"]) == 0.7
    assert cluster.groups(spark.createDataFrame([], PAIRS), 2).count() == 0


def test_components_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in cluster.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}


def test_pairs_stay_in_blocks_and_skip_deleted(spark):
    rows = spark.createDataFrame([("1", "Rua Goiás", "b1", None), ("2", "R. Goiás", "b1", False), ("3", "Rua Goiás", "b2", None), ("4", "Rua Goias", "b1", True), ("5", "Rua Goiás", "b1", None), ("6", None, "b1", None)], "id string, nome string, bairro_id string, excluido boolean")
    got = {(r["id_a"], r["id_b"]) for r in detect.similar_pairs(detect.records(rows, PLACES[STREET]), PLACES[STREET]).collect()}
    assert got == {("1", "2"), ("1", "5"), ("2", "5")}


def test_exclusion_needs_both(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "id_a string, id_b string")
    got = {tuple(r) for r in detect.without_grouped(pairs, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert got == {("a", "c"), ("c", "d")}


def test_verdicts(spark):
    cases = [('{"sao_duplicatas": true, "confianca": 0.95, "nome_canonico": "N", "membros_validos_ids": ["1", "2"]}', True, 0.95, ["1", "2"]), ('{"sao_duplicatas": false, "confianca": 0.98, "membros_validos_ids": []}', False, 0.98, []), ('{"sao_duplicatas": true, "membros_validos_ids": ["1", "id-fake"]}', True, 0.0, ["1"]), ('{"sao_duplicatas": true}', True, 0.0, ["1", "2"]), ("não é json", False, 0.0, []), ('{"sao_duplicatas": "true", "confianca": "0.9"}', False, 0.0, ["1", "2"])]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, c string").withColumn("v", verdict.parse_single(F.col("c"), F.array(F.lit("1"), F.lit("2"))))
    for r in df.orderBy("k").collect():
        _, dup, confidence, ids = cases[r["k"]]
        assert (r["v"]["dup"], r["v"]["confidence"], r["v"]["valid_ids"]) == (dup, confidence, ids)


def test_batch_and_pair_answers(spark):
    answers = spark.createDataFrame([(1, '{"grupos": [{"grupo": 1, "sao_duplicatas": true, "confianca": 0.9}, {"grupo": 9, "sao_duplicatas": true}]}')], "batch_id int, content string")
    batch = spark.createDataFrame([(1, 1, "g1", ["a", "b"]), (1, 2, "g2", ["c"])], "batch_id int, n int, group_id string, registro_ids array<string>")
    got = verdict.parse_batch(answers, batch).collect()
    assert [(r["group_id"], r["verdict"]["dup"], r["verdict"]["valid_ids"]) for r in got] == [("g1", True, ["a", "b"])]
    p = spark.createDataFrame([("```json\n{\"sao_duplicatas\": true, \"confianca\": 7}\n```",), ("none",)], "c string").select(verdict.parse_pair(F.col("c"), F.lit("A")).alias("v")).collect()
    assert (p[0]["v"]["dup"], p[0]["v"]["confidence"], p[0]["v"]["name"]) == (True, 1.0, "A") and not p[1]["v"]["dup"]


def test_apply_verdicts(spark):
    groups = spark.createDataFrame([("g1", "n", ["a", "b", "c"], ["A", "B", "C"]), ("g2", "n", ["d", "e"], ["D", "E"]), ("g3", "n", ["f", "g"], ["F", "G"]), ("g4", "n", ["h", "i"], ["H", "I"])], "group_id string, nome_normalizado string, registro_ids array<string>, nomes_membros array<string>")
    v = spark.createDataFrame([("g1", (True, 0.9, "New", "", ["a", "c"])), ("g2", (False, 0.9, "", "", [])), ("g3", (True, 0.9, "", "", ["f"]))], "group_id string, verdict struct<dup:boolean,confidence:double,name:string,why:string,valid_ids:array<string>>")
    got = {r["group_id"]: r for r in verdict.apply(groups, v).collect()}
    assert set(got) == {"g1", "g3", "g4"}
    assert got["g1"]["registro_ids"] == ["a", "c"] and got["g1"]["nomes_membros"] == ["A", "C"] and got["g1"]["nome_normalizado"] == "New"
    assert got["g3"]["registro_ids"] == ["f", "g"] and got["g4"]["detalhes_llm"] is None


def test_confirmed_needs_own_types(spark):
    rows = ['{"saoDuplicatas": true, "confianca": 0.9}', '{"saoDuplicatas": true, "confianca": "0.9"}', '{"saoDuplicatas": true, "confianca": 0.89}', "x", None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, d string")
    assert [r["y"] for r in df.orderBy("k").select(verdict.confirmed(F.col("d")).alias("y")).collect()] == [True, False, False, False, False]


def test_batches_number_rows_in_order(spark):
    got = verdict.batches(spark.range(37).repartition(5), "id", 10).orderBy("id").collect()
    assert [(r["batch_id"], r["n"]) for r in got] == [(k // 10, k % 10 + 1) for k in range(37)]


def test_suggestion_and_cascade(spark):
    members = spark.createDataFrame([("g", 0, "1", "Jd Aurora"), ("g", 1, "2", "Jardim Aurora"), ("h", 0, "3", "Rio Vermelho"), ("h", 1, "4", "Edifício Rio Vermelho")], "group_id string, pos int, id string, name string")
    groups = members.select("group_id").distinct()
    first = spark.createDataFrame([("g", "Jardim Aurora")], "group_id string, n string").select("group_id", resolve.official(F.col("n"), "a", F.lit(1.0)).alias("official"))
    second = spark.createDataFrame([("g", "Other"), ("h", "Edifício Rio Vermelho")], "group_id string, n string").select("group_id", resolve.official(F.col("n"), "b", F.lit(0.8)).alias("official"))
    names = resolve.cascade(groups, first, second)
    assert {r["group_id"]: r["official"]["source"] for r in names.collect()} == {"g": "a", "h": "b"}
    assert {r["group_id"]: r["member_id"] for r in resolve.suggested(members, names).collect()} == {"g": "2", "h": "4"}


def test_majority_ties_go_to_the_first(spark):
    v = spark.createDataFrame([("g", "B", 0), ("g", "A", 1), ("g", "A", 2), ("g", "B", 3), ("g", None, 4), ("h", "", 0)], "g string, v string, p int")
    assert [tuple(r) for r in resolve.majority(v, "g", "v", "p").collect()] == [("g", "B", 0.5)]


def test_merge_and_restore(spark):
    child = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (2, "a", 11), (3, None, 12)], "x int, fk string, y int")
    ref = FkRef("child", "fk", ("x", "y"))
    pairs = spark.createDataFrame([("g", "b", "a")], "grupo_id string, old string, new string")
    log = merge.log_rows(ref, child, pairs)
    new = merge.redirect(child, "fk", pairs)
    assert sorted(map(str, (tuple(r) for r in new.collect()))) == sorted(map(str, [(1, "a", 10), (2, "a", 10), (2, "a", 11), (3, None, 12)]))
    assert [(r["registro_afetado_id"], r["valor_anterior"], r["valor_novo"]) for r in log.collect()] == [("2|10", "b", "a")]
    assert sorted(map(str, (tuple(r) for r in merge.restore(new, ref, log).collect()))) == sorted(map(str, (tuple(r) for r in child.collect())))


def test_states():
    merge.check(1, "merge"), merge.check(4, "merge"), merge.check(2, "revert")
    for status, action in ((2, "merge"), (3, "merge"), (1, "revert"), (2, "discard")):
        with pytest.raises(merge.StateError):
            merge.check(status, action)
    with pytest.raises(merge.StateError):
        merge.check_canonical(["a"], "b")
