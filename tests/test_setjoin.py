"""Similarity joins against comparisons of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.operators import resolve, setjoin


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_overlaps_equal_all_pairs(spark, t):
    rng = random.Random(t)
    rows = [(b, k, sorted(rng.sample(range(14), rng.randrange(0, 9)))) for b in "xy" for k in range(40)] + [("z", 0, [1, 2])]
    sets = spark.createDataFrame(rows, "block string, id int, g array<long>")
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    got = [(r["block"], r["id1"], r["id2"], r["both"]) for r in setjoin.overlaps(sets, None, t, F.col("id1") < F.col("id2")).collect()]
    assert sorted(got) == sorted((b, i, j, len(set(x) & set(y))) for b, i, x in rows for c, j, y in rows if b == c and i < j and jaccard(x, y) >= t)
    other = sets.where("id % 3 = 0")
    got = [(r["block"], r["id1"], r["id2"]) for r in setjoin.overlaps(sets, other, t).collect()]
    assert sorted(got) == sorted((b, i, j) for b, i, x in rows for c, j, y in rows if b == c and j % 3 == 0 and jaccard(x, y) >= t)


def test_bigram_codes_keep_repeats(spark):
    texts = ["", "a", "ab", "aaaa", "abab", "banana", "ananas", "é😀é😀é", "éé"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", similarity.dice(F.col("a"), F.col("b")).alias("d")).collect():
        a, b = ([t[i : i + 2] for i in range(len(t) - 1)] for t in (r["a"], r["b"]))
        both = sum(min(a.count(g), b.count(g)) for g in set(a))
        assert r["d"] == pytest.approx(1.0 if r["a"] == r["b"] else 2 * both / (len(a) + len(b)) if a and b else 0.0)


@pytest.mark.parametrize("above", [None, 0.4, 0.7])
def test_best_match_equals_all_pairs(spark, above):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    left, right = [(b, k, name()) for b in "xy" for k in range(30)], [(b, k, name()) for b in "xy" for k in range(100, 125)]
    got = {(r["key"], r["best"]): r["score"] for r in resolve.best_match(spark.createDataFrame([(b, f"{b}{k}", n) for b, k, n in left], "b string, k string, n string"), spark.createDataFrame(right, "b string, o int, m string"), "b", "k", "n", "o", "m", above).collect()}

    def dice(x, y):
        a, b = ([t[i : i + 2] for i in range(len(t) - 1)] for t in (x, y))
        return 1.0 if x == y else 2 * sum(min(a.count(g), b.count(g)) for g in set(a)) / (len(a) + len(b)) if a and b else 0.0

    want = {}
    for b, k, n in left:
        s, o = min((-dice(n, m), o) for c, o, m in right if c == b)
        if above is None or -s > above:
            want[f"{b}{k}", o] = -s
    assert got == pytest.approx(want)
