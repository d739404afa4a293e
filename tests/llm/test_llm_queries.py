"""Queries against their SQL, and the pipeline stage by stage against brute-force versions, on the smallest tables."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import mixing, quality_rules, sentencepiece_codec, toxicity
from kindred.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(v):
    return round(v, 7) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, duck, name):
    df = llm.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(llm.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def brute_pipeline(spark, rows):
    """(doc_id, ids) of every row of the result, from (doc_id, text, lang, source, n_chars)."""
    from tests_llm_brute import brute_groups, brute_mix, brute_quality, brute_repeats

    cut = quality_rules.chi2(quality_rules.QUANTILE, quality_rules.P)
    rows = [r for r, d in zip(rows, brute_quality(spark, rows)) if d is not None and d <= cut]
    gone = {i for i, g, _ in brute_groups(rows) if i != g}
    rows = [r for r in rows if r[0] not in gone]
    covered, left = brute_repeats(rows, 50), []
    for r in rows:
        parts = re.findall(r"[^ \t\n\r\f\v]+[ \t\n\r\f\v]*", r[1])
        lead = r[1][: len(r[1]) - len("".join(parts))]
        text = lead + "".join(p for i, p in enumerate(parts) if r[0] is None or i not in covered[r[0]])
        if text.strip():
            left.append((r[0], text, r[2], r[3], len(text)))
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    texts = {r[0]: r[1] for r in left}
    return sorted(((doc_id, tuple(model.encode(texts[doc_id]))) for (doc_id, *_), n in brute_mix(left).items() for _ in range(n)), key=repr)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()), key=repr) == brute_pipeline(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_of_odd_rows(spark):
    from test_llm_operators import CLASH, DOCS, corpus

    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    odd = docs.withColumns({c: F.lit("clash") for c in CLASH})
    # The row that stands twice under one doc_id has the same text both times.
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.apply(spark, odd, SF).collect()), key=repr) == brute_pipeline(spark, rows)
    assert corpus_pipeline.apply(spark, docs.limit(0), SF).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    toxic, clean = ([got[i] for i, t in held.items() if t == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_brute_force_of_mixing_counts_as_sql_does(spark):
    df = spark.createDataFrame([(t,) for t in (" a b", "a\n\nb ", "", None, "   ", "x")], "t string").select(mixing.tokens(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [2, 2, 0, 0, 0, 1]
