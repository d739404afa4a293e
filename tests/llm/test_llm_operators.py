"""Each operator against a brute-force version, and its edge cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import brute_groups, brute_mix, brute_pairs, brute_quality, brute_repeats

from kindred.llm import html_extract, jaccard_join, knn, mixing, quality_crf, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("d", "l", "s", "x", "g", "mean", "inv", "_d", "_s", "_n", "_e", "_id", "k", "firsts", "uptos", "_gone", "sig", "pivot", "mix_epoch", "n_words", "rep", "n", "a", "g", "near", "tick`s")


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Unrelated documents, exact and near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(60, 160)) for _ in range(40)]
    passage = words(rng, 70)
    rows = [" ".join(b) for b in base]
    for k in range(8):
        near = list(base[k])
        near[rng.randrange(len(near))] = "edited"
        rows += [" ".join(base[k]), " ".join(near)]
    for k in range(20, 26):
        rows.append(" ".join([*base[k][:50], *passage, *words(rng, 30)]))
    rows += ["", None, "one", "one", "  \n ", " ".join(words(rng, 30_000))]
    return [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(rows)] + [(None, "no id here", None, None, 10), (0, rows[0], "en", "s0", len(rows[0]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# SentencePiece


def test_sentencepiece_equals_the_library(spark):
    rng = random.Random(3)
    texts = ["a  b", " a", "a ", "  ", " ", "", None, "▁x y", "x▁", "ﬁ ① z", "<s>hi</s>", "a \n b", "\x00a\r\n", "é̂ ñ", "日本 語", *(" ".join(words(rng, 50)) for _ in range(20)), " ".join(words(rng, 20_000))]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    enc = sentencepiece_codec.encode(df).cache()
    for r in enc.collect():
        t = texts[r["doc_id"]]
        assert r["ids"] == (None if t is None else model.encode(t))
        assert r["n_tokens"] == (None if t is None else len(r["ids"]))
        assert r["round_trip"] == (None if t is None else "▁" not in t)
    for r in sentencepiece_codec.decode(enc).collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (None if t is None else t.replace("▁", " "))
    assert sentencepiece_codec.encode(df.limit(0)).count() == 0


# Mixing


def test_mixing_equals_brute_force(spark, docs):
    assert Counter(tuple(r) for r in mixing.manifest(docs).collect()) == brute_mix(corpus())
    mixed = mixing.mix(clashing(docs), epoch=None)
    assert mixed.columns == clashing(docs).columns and mixed.count() == sum(brute_mix(corpus()).values())
    assert mixing.manifest(docs.limit(0)).count() == 0
    named = mixing.mix(clashing(docs))
    assert sorted(named.columns) == sorted(clashing(docs).columns) and named.where("mix_epoch = 0").count() > 0 and dict(named.dtypes)["mix_epoch"] == "int"


def test_mixing_meets_budgets_and_repeats_epochs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 40))), "en", "big" if k % 10 else "small", 0) for k in range(400)]
    got = mixing.manifest(spark.createDataFrame(rows, DOCS), {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("mix_epoch").alias("e")).collect()
    total = sum(len(r[1].split()) for r in rows)
    for r in got:
        assert total / 2 - 40 < r["n"] <= total / 2
    assert {r["source"]: r["e"] > 2 for r in got} == {"big": False, "small": True}


# Near copies


@pytest.mark.parametrize("chunk", [jaccard_join.CHUNK, 400])
def test_jaccard_join_equals_brute_force(spark, docs, chunk):
    assert {tuple(r) for r in jaccard_join.groups(clashing(docs), chunk=chunk).collect()} == brute_groups(corpus())
    pairs = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard_join.pairs(clashing(docs), chunk=chunk).collect()}
    assert pairs == pytest.approx(brute_pairs(corpus()))


def test_jaccard_join_of_a_chain_in_chunks(spark):
    """Documents that drift from one another: only neighbours are near, and chunks part them."""
    rng = random.Random(8)
    text, rows = words(rng, 100, 10**6), []
    for k in range(60):
        rows.append((k, " ".join(text), "en", "s", 0))
        text = list(text)
        for _ in range(7):
            text[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
    assert {tuple(r) for r in jaccard_join.groups(spark.createDataFrame(rows, DOCS), chunk=700).collect()} == brute_groups(rows)


@pytest.mark.parametrize("chunk", [250, 350, 800])
def test_jaccard_join_of_overlapping_windows_in_chunks(spark, chunk):
    """Windows of one long text: whether two are near depends on how far apart they begin, so that single documents bridge groups."""
    rng = random.Random(chunk)
    long = [f"v{k}" for k in range(900)]
    rows = [(k, " ".join(long[a : a + 100]), "en", "s", 0) for k, a in enumerate(rng.randrange(800) for _ in range(45))]
    df = spark.createDataFrame(rows, DOCS)
    assert {(r["doc_a"], r["doc_b"]) for r in jaccard_join.pairs(df, chunk=chunk).collect()} == set(brute_pairs(rows))
    assert {tuple(r) for r in jaccard_join.groups(df, chunk=chunk).collect()} == brute_groups(rows)


def test_jaccard_join_bridges_components_of_a_chunk():
    """A left-over document that is near two components of one chunk joins both; one of its own component gives no edge."""
    text = lambda first: np.arange(first, first + 100, dtype=np.uint64).tobytes()
    rows = [(1, text(0), False, True, 1), (2, text(20), False, True, 2), (3, text(10), True, False, 3), (4, text(22), False, True, 2), (5, text(11), False, True, 3), (6, text(900), False, True, 6)]
    pdf = pd.DataFrame(rows, columns=["doc_id", "grams", "guest", "home", "root"])
    edges = jaccard_join._across(1 - 0.75 + 1e-12)(pdf)
    assert list(zip(edges["a"], edges["b"])) == [(3, 1), (3, 2)]


def test_random_regions_in_chunks_lose_no_edge():
    """Forests of chunks, then left-over documents against all chunks: the components of all pairs, whatever the chunks."""
    rng, r = np.random.default_rng(5), 0.4 + 1e-12
    for trial in range(60):
        sets = [np.unique(rng.integers(0, 40, rng.integers(8, 30)).astype(np.uint64)) for _ in range(18)]
        chunks = np.concatenate([[0], rng.integers(0, (2, 3, 7)[trial % 3], 17)])
        near = {(a, b) for a in range(18) for b in range(a) if 1 - len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) <= r}

        def roots(edges):
            root = list(range(18))
            for a, b in edges:
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
            return root

        frame = lambda own, **more: pd.DataFrame({"doc_id": own, "grams": [sets[i].tobytes() for i in own]} | more)  # noqa: E731, B023
        edges = [e for c in set(chunks) for e in jaccard_join._within(r)(frame(sorted({0, *np.flatnonzero(chunks == c)}))).itertuples(index=False)]
        first = roots(edges)
        apart = [i for i in range(18) if first[i] != first[0]]
        for c in set(chunks) if apart else ():
            own = sorted({0, *np.flatnonzero(chunks == c), *apart})
            edges += jaccard_join._across(r)(frame(own, home=[i == 0 or chunks[i] == c for i in own], guest=[i in apart for i in own], root=[first[i] for i in own])).itertuples(index=False)
        assert roots(edges) == roots(near)


def test_without_copies(spark, docs):
    gone = {i for i, g, _ in brute_groups(corpus()) if i != g}
    left = jaccard_join.without_copies(clashing(docs))
    assert left.columns == clashing(docs).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in corpus() if r[0] not in gone)
    assert jaccard_join.groups(docs.limit(0)).count() == 0 and jaccard_join.without_copies(docs.limit(0)).count() == 0


def test_forest_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(25)]
        r = float(rng.choice([0.2, 0.4, 0.6])) + 1e-12
        near = lambda a, b: 1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b)) <= r  # noqa: E731, B023

        def label(edges):
            root = list(range(25))
            for a, b in edges:
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
            return root

        edges = jaccard_join.forest(jaccard_join.Region(sets), r)
        assert all(near(sets[a], sets[b]) for a, b in edges)
        assert label(edges) == label([(a, b) for a in range(25) for b in range(25) if near(sets[a], sets[b])])


# Suffix arrays


def test_suffix_array_and_common_prefixes():
    from kindred.llm.common import mix

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 300):
        t = np.append(rng.integers(1, 4, n), 0)
        plain = t.tolist()
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: plain[i:])

        def common(a, b):
            k = 0
            while max(a, b) + k <= n and plain[a + k] == plain[b + k]:
                k += 1
            return k

        assert suffix_dedup.common_prefix(sa, t, mix(t.astype(np.uint64))).tolist() == [0] + [common(sa[j - 1], sa[j]) for j in range(1, n + 1)]


@pytest.mark.parametrize(("shard", "part", "tasks"), [(1, 1 << 24, 9), (5_000, 20_000, 3), (5_000, 20_000, 50), (1 << 21, 1 << 24, 9)])
def test_repeats_equal_brute_force(spark, docs, shard, part, tasks):
    got = {r["doc_id"]: {i for a, b in zip(r["firsts"], r["uptos"]) for i in range(a, b)} for r in suffix_dedup.repeats(clashing(docs), 50, shard, part, tasks).collect()}
    assert got == brute_repeats(corpus(), 50)


def test_cut_texts(spark, docs):
    covered = brute_repeats(corpus(), 50)
    left = suffix_dedup.without_repeats(clashing(docs))
    assert left.columns == clashing(docs).columns
    want = []
    for r in corpus():
        w = (r[1] or "").split()
        kept = [x for i, x in enumerate(w) if r[0] is None or i not in covered[r[0]]]
        if kept or not w:
            want.append((r[0], kept))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], (r["text"] or "").split())) for r in left.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in left.where("text IS NOT NULL").collect())
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


# Quality rules


def test_quality_rules_equal_brute_force_and_reject_junk(spark):
    """Two sources of their own, two that only together are enough for a language, and one that is left over."""
    rng = random.Random(4)
    syllables = ["ba", "ne", "tiro", "lum", "sa", "kedo", "mi", "ra"]
    sentence = lambda: "".join((w := [rng.choice(syllables) + rng.choice(syllables) * rng.randrange(2) for _ in range(rng.randrange(5, 15))])[0].capitalize() + " " + " ".join(w[1:]) + ". ")
    rows = []
    for lang, source, n in (("en", "a", 300), ("en", "b", 150), ("de", "a", 60), ("de", "b", 70), (None, None, 30)):
        for _ in range(n):
            rows.append((len(rows), "".join(sentence() for _ in range(rng.randrange(4, 40))), lang, source, 0, False))
        for _ in range(n // 10):
            rows.append((len(rows), " ".join(w + "***" for w in words(rng, 60)), lang, source, 0, True))
            rows.append((len(rows), "LOUD " * 40 + " ".join(words(rng, 5)), lang, source, 0, True))
    want = brute_quality(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.judged(clashing(spark.createDataFrame([r[:5] for r in rows], DOCS))).collect()}
    cut = quality_rules.chi2(quality_rules.QUANTILE, quality_rules.P)
    for k, r in enumerate(rows):
        assert got[k]["distance2"] == pytest.approx(want[k], rel=1e-5, abs=1e-5)
        assert got[k]["rejected"] == (want[k] > cut)
        assert got[k]["rejected"] or not r[5]
    assert sum(got[k]["rejected"] for k, r in enumerate(rows) if not r[5]) <= 3


def test_quality_rules_edge_cases(spark, docs):
    got = quality_rules.judged(clashing(docs)).collect()
    assert len(got) == len(corpus())
    assert all(r["rejected"] and r["distance2"] is None for r in got if r["n_words"] == 0) and sum(r["n_words"] == 0 for r in got) == 3
    left = quality_rules.accepted(clashing(docs))
    assert left.columns == clashing(docs).columns and left.count() == sum(not r["rejected"] for r in got)
    assert quality_rules.judged(docs.limit(0)).count() == 0 and quality_rules.accepted(docs.limit(0)).count() == 0


def test_chi2():
    for q, p, want in ((0.95, 6, 12.592), (0.975, 6, 14.449), (0.99, 3, 11.345)):
        assert quality_rules.chi2(q, p) == pytest.approx(want, rel=0.01)


# Line classifier


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 0, 5, 2]
    doc = np.concatenate([[0], np.cumsum(sizes)])
    unary, move = rng.normal(size=doc[-1]), rng.normal(size=(2, 2))
    good, pair, z = quality_crf.forward_backward(unary, move, doc)
    want, pairs, logz = np.zeros(doc[-1]), np.zeros((2, 2)), 0.0
    for a, b in zip(doc[:-1], doc[1:]):
        if a == b:
            continue
        total, here, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for m in range(2 ** (b - a)):
            y = [(m >> i) & 1 for i in range(b - a)]
            p = math.exp(sum(unary[a + i] for i in range(b - a) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += p
            here += p * np.array(y)
            for i in range(b - a - 1):
                two[y[i], y[i + 1]] += p
        want[a:b], pairs, logz = here / total, pairs + two / total, logz + math.log(total)
    assert good == pytest.approx(want) and pair == pytest.approx(pairs) and z == pytest.approx(logz)


def plain_features(text):
    """The features of the lines of a text, in plain Python."""
    raw = [x for x in text.encode().split(b"\n") if x]
    sym, up, low, dig = b"!#$%&*+<=>@[\\]^_`{|}~", range(65, 91), range(97, 123), range(48, 58)
    share = lambda c, n: math.sqrt(c / max(n, 1))
    own, tokens = [], [[w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", x)] for x in raw]
    flat = [w for t in tokens for w in t]
    grams = [tuple(flat[i : i + 5]) for i in range(max(len(flat) - 4, min(len(flat), 1)))]
    looped = [i < len(grams) and grams.count(grams[i]) > 1 for i in range(len(flat))]
    at = 0
    for x, t in zip(raw, tokens):
        n, size = len(t), len(x)
        letters = sum(c in up or c in low for c in x)
        loops, at = sum(looped[at : at + n]), at + n
        own.append([math.log1p(n) / 4, share(sum(c in sym for c in x), size), share(sum(c in up for c in x), letters), share(sum(c in dig for c in x), size), sum(map(len, t)) / max(n, 1) / 10, share(sum(a == b for a, b in zip(t, t[1:])), n), share(loops, n), share(sum(len(w) > 30 for w in t), n), float(x[-1:] in (b".", b"!", b"?")), float(raw.count(x) > 1)])
    near = [[o[i] for i in quality_crf.NEAR] for o in own]
    none = [0.0] * len(quality_crf.NEAR)
    return raw, [own[k] + (near[k - 1] if k else none) + (near[k + 1] if k + 1 < len(own) else none) + [float(k == 0), float(k + 1 == len(own)), 1.0] for k in range(len(own))]


def test_line_labels_equal_enumeration(spark):
    """The query's labels and qualities against sums over all labellings of a document's lines."""
    rows, labels = labelled(3, 60)
    rows += [(500, "one line"), (501, "A A A\n\nB!! C1\nA A A\n\u00e9t\u00e9 x y z w v x y z w v."), (502, None), (503, "\n")]
    docs, train = clashing(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    w, move = quality_crf.fit(docs, train)
    got = {r["doc_id"]: r for r in quality_crf.classify(docs, train).collect()}
    for i, text in rows:
        raw, x = plain_features(text or "")
        total, good = 0.0, np.zeros(len(raw))
        for m in range(2 ** len(raw) if raw else 0):
            y = [(m >> k) & 1 for k in range(len(raw))]
            p = math.exp(sum(float(np.dot(x[k], w)) for k in range(len(raw)) if y[k]) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        r = got[i]
        assert r["n_lines"] == len(raw)
        if raw:
            p = good / total
            assert r["line_p"] == pytest.approx(p, abs=1e-4) and r["line_good"] == [bool(v >= 0.5) for v in p]
            assert r["quality"] == pytest.approx(sum(len(b) * v for b, v in zip(raw, p)) / sum(map(len, raw)), abs=1e-5)


def labelled(seed, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        lines = [" ".join(words(rng, rng.randrange(3, 15))) + "." for _ in range(rng.randrange(1, 8))]
        rows.append((k, "\n".join(x.upper().replace(" ", "!! ") if bad else x for x in lines) + (" scum moron" if k % 4 == 0 else "")))
        labels.append((k, int(not bad), int(k % 4 == 0)))
    return rows, labels


def test_classifiers_on_held_out_rows(spark):
    rows, labels = labelled(1)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [x for x in labels if x[0] % 2]
    held += [x for x in labels if x[0] % 8 == 0]
    train = spark.createDataFrame([x for x in labels if x not in held], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r["kept"] for r in quality_crf.classify(docs, train).collect()}
    assert np.mean([q[i] == bool(good) for i, good, _ in held]) > 0.97
    t = {r["doc_id"]: r["is_toxic"] for r in toxicity.classify(docs, train).collect()}
    assert np.mean([t[i] == bool(bad) for i, _, bad in held]) > 0.97


def test_classifiers_edge_cases(spark, docs):
    rows, labels = labelled(2, 80)
    train = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    odd = clashing(spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "\n\n"), (1003, "word " * 50_000), (None, "x"), (1, rows[1][1])], "doc_id long, text string"))
    for r in quality_crf.classify(odd, train).collect():
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["n_lines"], r["quality"], r["kept"]) == (0, None, False)
    for r in toxicity.classify(odd, train).collect():
        if r["doc_id"] in (1000, 1001, 1002):
            assert r["p_toxic"] is None and not r["is_toxic"]
    none = train.limit(0)
    assert all(r["quality"] == 0.5 and r["kept"] for r in quality_crf.classify(odd, none).where("n_lines > 0").collect())
    assert all(r["p_toxic"] is None and not r["is_toxic"] for r in toxicity.classify(odd, none).collect())
    for f in (quality_crf, toxicity):
        assert f.classify(odd.limit(0), train).count() == 0
        assert f.classify(odd, train).count() == odd.count()


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y1 = (x[:, 0] > 0).astype(float)
    y2 = (x[:, 0] + x[:, 1] > 0).astype(float)
    fold = np.arange(200) % toxicity.FOLDS
    asked = []
    weights, _, seen = toxicity.train(lambda rows: asked.append(rows) or x * (1 + rows.sum() / 1000), [y1, y2], fold)
    assert [r.tolist() for r in asked[:-1]] == [(fold != k).tolist() for k in range(toxicity.FOLDS)] and asked[-1].all()
    for k in range(toxicity.FOLDS):
        xk = x * (1 + (fold != k).sum() / 1000)
        assert seen[0][fold == k] == pytest.approx(toxicity.probability(xk[fold == k], toxicity.fit_logistic(xk[fold != k], y1[fold != k])))
    assert len(weights[0]) == 6 and len(weights[1]) == 7


def test_lexicon_and_folds_owe_nothing_to_held_out_labels():
    owner, at, values = np.array([0, 0, 1, 2, 3, 3]), np.array([0, 1, 0, 1, 2, 1]), np.array([7, 8, 9], np.uint32)
    toxic, some = np.array([1.0, 1.0, 0.0, 0.0]), np.array([True, True, True, False])
    a = toxicity.lexicon_of(owner, at, values, toxic, some)
    assert a.tolist() == toxicity.lexicon_of(owner, at, values, np.array([1.0, 1.0, 0.0, 1.0]), some).tolist()
    fold = toxicity.folds([b"a", b"b", b"a", b"c", b"d", b"a"], np.array([1, 1, 1, 0, 0, 1]), 2)
    assert fold[0] == fold[2] == fold[5] != fold[1] and fold[3] != fold[4]


def test_toxicity_of_repeated_rows(spark):
    rows, labels = labelled(5, 80)
    twice = spark.createDataFrame([*rows, *((i + 1000, t) for i, t in rows)], "doc_id long, text string")
    got = {r["doc_id"]: list(r)[1:] for r in toxicity.classify(twice, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == got[i + 1000] for i, _ in rows)


# HTML


def brute_cut(net, links):
    best = None
    for m in range(2 ** len(net)):
        side = [(m >> i) & 1 for i in range(len(net))]
        cost = sum(v for v, s in zip(net, side) if v > 0 and not s) + sum(-v for v, s in zip(net, side) if v < 0 and s) + sum(c for (i, j), c in links.items() if side[i] != side[j])
        if best is None or (cost, sum(side)) < best[:2]:
            best = (cost, sum(side), side)
    return [bool(s) for s in best[2]]


def test_minimum_cut_equals_enumeration():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 9)
        net = [rng.randrange(-9, 10) for _ in range(n)]
        links = {(i, j): rng.randrange(1, 6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
        assert html_extract.minimum_cut(net, links) == brute_cut(net, links)


def test_html_blocks_and_pages(spark):
    b = html_extract.blocks('<nav><a href=x>A &amp; B</a></nav><article><p>one <b>two</b><p>three<br>four</article><script>var t="</p>"</script><!-- c --><style>x{}</style>tail')
    assert [x.text for x in b] == ["A & B", "one two", "three", "four", "tail"]
    assert [x.label for x in b] == [0, 1, 1, 1, -1] and b[0].links > 0
    assert [x.text for x in html_extract.blocks("a < b <p>x<script>never closed")] == ["a < b", "x"]
    rng = random.Random(7)
    page = lambda k: f"<html><body><nav><ul>{''.join(f'<li><a href=/{w}>{w}</a></li>' for w in words(rng, 6))}</ul></nav><article><h1>Title {k}</h1>{''.join('<p>' + ', '.join(words(rng, 40)) + '.</p>' for _ in range(5))}</article><footer>&copy; x</footer></body></html>"
    rows = [(k, page(k)) for k in range(60)] + [(100, None), (101, ""), (102, "<p></p>"), (103, "<p>" + "long, text. " * 50_000), (None, page(1)), (1, page(1))]
    df = clashing(spark.createDataFrame(rows, "page_id long, html string"))
    got = html_extract.content(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 60:
            assert r["n_content"] == 6 and r["n_blocks"] == 13 and "©" not in r["text"]
        if r["page_id"] in (100, 101, 102):
            assert (r["text"], r["n_blocks"]) == (None, 0)
    assert html_extract.content(df.limit(0)).count() == 0


class PlainBlocks(HTMLParser):
    """Text blocks of a well-formed page: (text, parent, grandparent)."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.out, self.parts, self.serial = [0], [], [], 0
        self.feed(page)
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append((text, self.stack[-2] if len(self.stack) > 1 else 0, self.stack[-3] if len(self.stack) > 2 else 0))

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.flush()
            self.serial += 1
            self.stack.append(self.serial)

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
            self.stack.pop()

    def handle_data(self, data):
        self.parts.append(data)


def test_html_extraction_equals_enumeration(spark):
    """The query against the cheapest of all labellings of a page's blocks."""
    rng = random.Random(11)
    part = lambda: rng.choice([lambda: f"<p>{', '.join(words(rng, rng.randrange(1, 40)))}.</p>", lambda: f'<div class="ad"><a href=x>{" ".join(words(rng, 4))}</a></div>', lambda: f"<ul><li>{words(rng, 1)[0]}</li><li><a href=y>{words(rng, 1)[0]}</a></li></ul>"])()
    pages = [f"<body><nav><a href=/>home</a></nav><article>{''.join(part() for _ in range(rng.randrange(1, 5)))}</article><footer>all <b>rights</b></footer></body>" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    w = html_extract.fit(df)
    got = {r["page_id"]: r for r in html_extract.content(df).collect()}
    for k, page in enumerate(pages):
        plain = PlainBlocks(page).out
        bs = html_extract.blocks(page)
        assert [b.text for b in bs] == [p[0] for p in plain]
        links = Counter()
        for i, (_, parent, up) in enumerate(plain):
            if i:
                links[i - 1, i] += 600
            for column, value, cap in ((1, parent, 600), (2, up, 200)):
                if before := [j for j in range(i) if plain[j][column] == value]:
                    links[before[-1], i] += cap
        assert links == html_extract.edges(bs)
        kept = [p[0] for p, s in zip(plain, brute_cut(html_extract.terminal(html_extract.features(bs), w), links)) if s]
        assert (got[k]["text"], got[k]["n_blocks"], got[k]["n_content"]) == ("\n".join(kept) if kept else None, len(plain), len(kept))


def test_html_of_long_pages_takes_time_in_proportion():
    for page in ("<a " * 100_000, "</" * 100_000, "<!--" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<p>word, and. " * 10_000, "<p>one<p>two, three. " * 5_000):
        began = time.monotonic()
        html_extract.extract(page, html_extract._FALLBACK)
        assert time.monotonic() - began < 5


# Top-k


@pytest.mark.parametrize(("n", "groups"), [(300, 4000), (300, 40), (300, 7), (5, 40), (1, 40)])
def test_knn_equals_brute_force(spark, n, groups):
    rng = np.random.default_rng(n + groups)
    centres = rng.normal(size=(6, 8))
    v = [(centres[rng.integers(6)] + rng.normal(size=8) * 0.2).astype(np.float32) for _ in range(n)]
    v[0:2] = [v[0], v[0]]
    v = v[:n]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [float("nan")] * 8), (None, [0.0] * 8), (0, rows[0][1])]
    got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in knn.knn_join(clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")), 10, groups).collect()}
    want = {}
    for k, x in enumerate(v):
        d = sorted((float(np.sqrt(((x.astype(float) - y.astype(float)) ** 2).sum())), j) for j, y in enumerate(v) if j != k)
        want |= {(k, r + 1): (j, dist) for r, (dist, j) in enumerate(d[:10])}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_knn_of_equal_vectors_in_several_groups(spark):
    """One cell with all vectors is cut into groups; ties go to the smaller id."""
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(60)], "vec_id long, embedding array<double>")
    got = knn.knn_join(df, 3, 20).collect()
    assert {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in got} == {(k, r): ([j for j in range(5) if j != k][r - 1], 0.0) for k in range(60) for r in (1, 2, 3)}


def test_knn_of_nothing(spark):
    assert knn.knn_join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# URLs


def test_url_hits(spark):
    terms = {"casino": 2, "adult": 2, "cheap": 1, "free": 1, "win": 1, "ads": 1, "free-win": 1}
    urls = ["http://casino-win.example.net/1", "http://x.com/cheapest", "http://cheap.free.com", "http://free.com/free/free", "HTTP://ADULT-X.com", None, "", "casino", "http://mycasino.com", "http://a.com/" + "ads-" * 50_000, "http://a.com/c%61sino%2Fx", "http://a.com/free-win", "http://a.com/%ff%"]
    df = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {r["page_id"]: r for r in url_filter.url_hits(df, terms).collect()}
    assert [got[k]["rejected"] for k in range(len(urls))] == [True, False, True, False, True, False, False, True, False, False, True, True, False]
    assert got[0]["strict_terms"] == ["casino"] and got[0]["soft_terms"] == ["win"] and got[2]["soft_terms"] == ["cheap", "free"] and got[11]["soft_terms"] == ["free", "free-win", "win"]
    assert [got[k]["score"] for k in (0, 2, 3, 11)] == [3, 2, 1, 3]
    assert url_filter.url_hits(df.limit(0)).count() == 0 and url_filter.url_hits(df, {}).where("rejected").count() == 0
    assert len(url_filter.vocabulary()) > 150 and set(url_filter.vocabulary().values()) == {1, 2}
    with pytest.raises(ValueError):
        url_filter.automaton({"Upper": 1})
