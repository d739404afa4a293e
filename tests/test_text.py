import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "want"), [("Jardim Shangri-Lá", "jardim shangri-la"), ("São João", "sao joao"), ("Setor   Marista", "setor marista"), ("  Aurora  ", "aurora"), ("Café Ñandú", "cafe nandu"), (None, None), ("", "")])
def test_fold(spark, value, want):
    assert one(spark, value, text.fold) == want


@pytest.mark.parametrize(("value", "kind", "want"), [("Jardim Aurora", text.DISTRICT, "aurora"), ("Setor Marista", text.DISTRICT, "marista"), ("Vila Nova", text.DISTRICT, "nova"), ("Vila Velha", None, "vila velha"), ("Edifício Aurora", text.CONDO, "aurora"), ("Condomínio Reserva", text.CONDO, "reserva"), ("Ed Rio Vermelho", text.CONDO, "rio vermelho"), ("Parque Industrial I", text.DISTRICT, "industrial 1"), ("Parque Industrial III", text.DISTRICT, "industrial 3"), ("setor jardim aurora", text.DISTRICT, "aurora"), ("jardim setor aurora", text.DISTRICT, "setor aurora"), ("x constructor", None, "10 constructor")])
def test_normalise(spark, value, kind, want):
    assert one(spark, value, lambda c: text.normalise(c, kind)) == want


def test_one_prefix(spark):
    assert one(spark, "Jd Setor Aurora", text.clean_district) == "setor aurora"
    assert one(spark, "Edifício Aurum | Plaenge (A)", text.clean_condo) == "aurum plaenge a"


def test_small_helpers(spark):
    assert one(spark, "74.000-123", text.postal_code) == "74000123"
    assert one(spark, "7400", text.postal_code) is None
    assert one(spark, "Ok ```json\n{\"a\": {}}\n``` bye", text.first_object) == '{"a": {}}'
    assert [one(spark, v, text.clamp01) for v in ("2", "-1", "0.25", "x", None)] == [1.0, 0.0, 0.25, 0.0, 0.0]
    assert spark.range(1).select(text.round2(F.lit(0.145)).alias("y")).first()["y"] == 0.14


def sim(spark, f, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("y")).first()["y"]


def test_trigrams(spark):
    assert sim(spark, similarity.similarity, "word", "two words") == pytest.approx(4 / 11)
    assert sim(spark, similarity.similarity, "", "") == 0.0
    assert sim(spark, similarity.similarity, "!!", "!!") == 0.0


@pytest.mark.parametrize(("a", "b", "want"), [("jardim aurora", "jd aurora", 0.6), ("abc", "xyz", 0.0), ("a", "a", 1.0), ("a", "b", 0.0), ("condominio reserva", "residencial reserva", 0.4), ("ed. reserva", "edificio reserva", 0.64), ("aaaa", "aa", 0.5)])
def test_dice(spark, a, b, want):
    assert sim(spark, similarity.dice, a, b) == pytest.approx(want)


def test_similarity_properties(spark):
    words = ["rua goias", "r goias", "centro", "centro historico", "áé 12", ""]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", similarity.similarity(F.col("a"), F.col("b")).alias("x"), similarity.similarity(F.col("b"), F.col("a")).alias("y"), similarity.dice(F.col("a"), F.col("b")).alias("d")).collect()
    for r in rows:
        assert r["x"] == r["y"] and 0 <= r["x"] <= 1 and 0 <= r["d"] <= 1
        if r["a"] == r["b"] and r["a"]:
            assert r["x"] == r["d"] == 1
