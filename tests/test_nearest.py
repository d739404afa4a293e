"""Best matches where names can't be told apart by rare grams: against all pairs, and without a row for each pair."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import nearest, resolve


@pytest.mark.parametrize("tiles,grams,cells", [((8192, 32768), 4_000_000, 16_000_000), ((7, 11), 4_000_000, 40), ((8192, 32768), 50, 1)])
def test_nearest_equals_all_pairs(spark, tiles, grams, cells):
    rng = random.Random(cells)
    side = lambda n, k, blocks: [(b, rng.randrange(k), sorted(rng.sample(range(-4, 9), rng.randrange(1, 8)))) for b in blocks for _ in range(n)]
    left, right = ([(b, at * 1000 + k, g) for at, (b, k, g) in enumerate(rows)] for rows in (side(40, 999, "xy"), side(60, 999, "yx")))
    left += [("x", 10**6, [77]), ("alone", 10**6 + 1, [1])]  # without a shared gram, and without a right set in the block
    rng.shuffle(right)
    frames = [spark.createDataFrame(rows, "block string, id long, g array<long>") for rows in (left, right)]
    frames[1] = frames[1].withColumn("near", F.col("g").cast("string"))
    got = {r["id"]: (r["best"], r["score"]) for r in nearest.nearest(*frames, tiles, grams, cells).collect()}
    want = {}
    for b, k, g in left:
        found = [(-2.0 * len(set(g) & set(h)) / (len(g) + len(h)), o) for c, o, h in right if c == b]
        if found:
            s, o = min(found)
            want[k] = (o, -s)
    assert got == want


def rows_of_steps(spark, run):
    """The most rows that a step of the queries in run() gave, whatever was checkpointed between."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, all_ = 0, store.executionsList()
    for k in range(before, all_.size()):
        one = all_.apply(k)
        values = store.executionMetrics(one.executionId())
        for m in range(one.metrics().size()):
            metric = one.metrics().apply(m)
            value = values.get(metric.accumulatorId())
            if metric.name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return out, most


def test_best_match_lists_no_pairs(spark):
    left = spark.range(400).select(F.lit("x").alias("b"), "id", F.format_string("Supplier#%09d", F.col("id") * 37).alias("n"))
    right = spark.range(2000).select(F.lit("x").alias("b"), F.col("id").alias("o"), F.format_string("Customer#%09d", F.col("id") * 11).alias("m"))
    rows, most = rows_of_steps(spark, lambda: resolve.best_match(left, right, "b", "id", "n", "o", "m").collect())
    assert len(rows) == 400
    assert 2000 <= most <= 12_000  # of 800,000 pairs


def test_short_names_and_ids_of_text(spark):
    left = [("x", k, n) for k, n in enumerate(["", "a", "A", "é", "ab", "zz", None])] + [(None, 99, "a"), ("y", 100, "a")]
    right = [("x", "k10", "a"), ("x", "k9", "á"), ("x", "k2", "b"), ("x", "k1", None), ("x", "k3", "abc"), ("x", "k4", "abd"), (None, "k0", "a")]
    args = spark.createDataFrame(left, "b string, k int, n string"), spark.createDataFrame(right, "b string, o string, m string")
    got = {r["key"]: (r["best"], r["best_name"], r["score"]) for r in resolve.best_match(*args, "b", "k", "n", "o", "m").collect()}
    assert got == {0: ("k10", "a", 0.0), 1: ("k10", "a", 1.0), 2: ("k10", "a", 1.0), 3: ("k10", "a", 0.0), 4: ("k3", "abc", pytest.approx(2 / 3)), 5: ("k10", "a", 0.0)}
