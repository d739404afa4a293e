"""Quality rules as robust multivariate outliers.

Each document has a vector of transformed statistics. For every (language, source) the minimum covariance determinant
gives a mean and covariance that spoilt documents cannot pull. Documents whose squared Mahalanobis distance is beyond the
cut go.

Concentration steps run over all documents at once, from one start with all documents and RANDOM starts with a few
hash-chosen documents each; after EARLY steps the KEEP starts of least determinant go on, after LATE more the best one is
left, and one reweighting step follows. A step is two aggregations: the distance that the share H of the documents lies
within (percentile_approx: a rank that is off by at most n / ACCURACY), and the moments of the documents within it. So nothing
grows with the table but the scan, and the small parameter rows stay distributed.

Statistics are square roots of smoothed shares, (count + M p0) / (n + M), and the logarithm of the smoothed length of words: a
short text, whose shares say little, lies near the typical value and not far out. A variance is never taken for less than
FLOOR of the pooled one (from the quartiles of all documents); that only guards groups without any spread.

Groups of fewer than MIN_GROUP documents are judged with others like them: first all small groups of the language, and if
those are still too few, all that are left.

Cases: a null or blank text has no words and is rejected; a null language or source is a group of its own; repeated
rows and ties get equal decisions; very long texts count in full; an empty table gives an empty result; in a group
whose documents are all alike nothing is rejected; columns of the input pass through accepted() whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import Text, column, durable, frugal, grams, release, slices, small

NAMES = ("punctuation", "upper", "stutter", "repeats", "short_words", "word_bytes")
#: Typical shares (bytes a word for word_bytes), and how many bytes, letters or words of typical text each is smoothed with.
PRIOR = np.array([0.023, 0.017, 0.007, 0.01, 0.31, 5.0])
M = np.array([900.0, 900.0, 150.0, 150.0, 150.0, 150.0])
H = 0.75
RANDOM, START_DOCS = 4, 18
EARLY, LATE, KEEP = 2, 3, 2
ACCURACY = 10_000
FLOOR = 1e-3
MIN_GROUP = 100
QUANTILE = 1 - 1e-9
P = len(NAMES)
NONE = "∅"

SYMBOL = np.array([chr(c) in "!#$%&*+<=>@[\\]^_`{|}~" for c in range(256)])
UPPER = np.array([65 <= c <= 90 for c in range(256)])
LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
DIGIT = np.array([48 <= c <= 57 for c in range(256)])
PUNCTUATION = np.array([33 <= c <= 126 and not chr(c).isalnum() for c in range(256)])


def repeated(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each document how many of its grams occurred in it before."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = g + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    return np.bincount(owner[order[1:][same]], minlength=len(at) - 1)


class Counts:
    """What is counted in each text of a slice."""

    def __init__(self, t: Text):
        self.t, self.words, self.bytes = t, t.count().astype(np.float64), np.diff(t.off).astype(np.float64)
        self.hash, self.size = t.hash(), t.end - t.start

    def of(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a class."""
        return np.diff(self.t.bytes_where(table)[self.t.off]).astype(np.float64)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of a value per word."""
        return np.diff(np.concatenate([[0], np.cumsum(x)])[self.t.doc]).astype(np.float64)

    def stutter(self) -> np.ndarray:
        """Words that equal the one before."""
        h, doc = self.hash, self.t.doc
        same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
        same[doc[:-1][doc[:-1] < len(h)]] = False
        return self.sums(same)

    def repeats(self, n: int) -> np.ndarray:
        return repeated(*grams(self.hash, self.t.doc, n))


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, vectors) of texts."""
    words, out = [], []
    for _, _, t in slices(texts):
        c = Counts(t)
        n, size = c.words, c.sums(c.size)
        pairs = ((c.of(PUNCTUATION), c.bytes), (c.of(UPPER), c.of(LETTER)), (c.stutter(), n), (c.repeats(2), n), (c.sums(c.size <= 3), n), (size, n))
        x = np.stack([(k + m * p) / (of + m) for (k, of), p, m in zip(pairs, PRIOR, M)], 1)
        out.append(np.column_stack([np.sqrt(x[:, :-1]), np.log(x[:, -1])]))
        words.append(n)
    return (np.concatenate(words).astype(np.int64), np.concatenate(out)) if words else (np.zeros(0, np.int64), np.zeros((0, P)))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def vector(text: Column) -> Column:
    """array<double>: the number of words, then the statistics."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                n, x = statistics(texts)
                yield _lists(np.column_stack([n.astype(np.float64), x]))
        finally:
            release()

    # A deterministic function would be run twice where its result is both filtered by and returned, by two workers at a time.
    return run.asNondeterministic()(text)


def chi2(q: float, p: int) -> float:
    """Quantile by Wilson and Hilferty."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _chi2_cdf(x: float, p: int) -> float:
    return NormalDist().cdf(((x / p) ** (1 / 3) - (1 - 2 / (9 * p))) / math.sqrt(2 / (9 * p)))


def consistency(part: float) -> float:
    """What the covariance of the nearest part of a normal sample is to be multiplied with."""
    return min(part / max(_chi2_cdf(chi2(part, P), P + 2), 1e-6), 10.0) if part < 1 - 1e-12 else 1.0


_PARAMS = "g string, start int, logdet double, mean array<double>, inv array<double>"
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, scale: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log determinants, means, inverse covariances) of many groups from their counts, sums and sums of products."""
    mean = s / n[:, None]
    cov = np.zeros((len(n), P, P))
    for k, (i, j) in enumerate(PAIRS):
        cov[:, i, j] = cov[:, j, i] = (ss[:, k] / n - mean[:, i] * mean[:, j]) * scale
    d = np.arange(P)
    cov[:, d, d] = np.maximum(cov[:, d, d], floor)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, floor.min() * 1e-3)
    return np.log(values).sum(1), mean, np.einsum("nij,nj,nkj->nik", vectors, 1 / values, vectors)


def _fits(floor: np.ndarray, scaled: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy(np.float64)
            scale = np.array([consistency(k) for k in n / pdf["total"].to_numpy(np.float64)]) if scaled else np.ones(len(n))
            logdet, mean, inv = fit(n, pdf[[f"s{i}" for i in range(P)]].to_numpy(), pdf[[f"q{i}_{j}" for i, j in PAIRS]].to_numpy(), scale, floor)
            yield pd.DataFrame({"g": pdf["g"], "start": pdf["start"], "logdet": logdet, "mean": list(mean), "inv": list(inv.reshape(len(n), -1))})

    return run


def _moments() -> list[Column]:
    x = [F.col("x")[i + 1] for i in range(P)]
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in PAIRS)]


def distance2(x: Column, mean: Column, inv: Column) -> Column:
    """Squared Mahalanobis distance; x has the number of words before the statistics."""
    d = [x[i + 1] - mean[i] for i in range(P)]
    terms = [d[i] * d[j] * inv[i * P + j] * (1 if i == j else 2) for i, j in PAIRS]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


def _key(part: str) -> Column:
    return F.coalesce(F.col(part).cast("string"), F.lit(NONE))


def group_names(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(l, s, g): the group in which a language and source is judged. counts: (l, s, n)."""
    tight = F.col("n") >= min_group
    by_lang = counts.where(~tight).groupBy("l").agg(F.sum("n").alias("n_small"))
    g = F.when(tight, F.concat(F.lit("1"), F.to_json(F.struct("l", "s")))).when(F.col("n_small") >= min_group, F.concat(F.lit("2"), F.to_json(F.struct("l")))).otherwise(F.lit("3"))
    return counts.join(by_lang, "l", "left").select("l", "s", g.alias("g"))


def floors(x: DataFrame) -> np.ndarray:
    """The least variance of each statistic: FLOOR of the pooled one, as the quartiles of all documents give it. Two numbers a statistic reach the driver."""
    q = x.agg(*(F.percentile_approx(F.col("x")[i + 1], F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(f"q{i}") for i in range(P))).first()
    return np.array([FLOOR * ((v[1] - v[0]) / 1.349) ** 2 if v else 0.0 for v in q]) + 1e-12


def chosen(start: Column, total: Column) -> Column:
    """Whether a document belongs to a random start: about START_DOCS of each group do, by a hash of its statistics."""
    return F.pmod(F.xxhash64("x", start), F.lit(1 << 30)) * total < F.lit(START_DOCS << 30)


def _step(x: DataFrame, params: DataFrame, floor: np.ndarray, least: float = 0.0) -> DataFrame:
    """Parameters from the documents within the distance of the share H, or within least, whichever is more."""
    d2 = distance2(F.col("x"), F.col("mean"), F.col("inv"))
    at = x.join(small(params), "g").select("g", "start", "x", d2.alias("d2"))
    cut = durable(at.groupBy("g", "start").agg(F.greatest(F.percentile_approx("d2", F.lit(H), ACCURACY), F.lit(least)).alias("cut"), F.count("*").alias("total")))
    near = at.join(small(cut), ["g", "start"]).where("d2 <= cut")
    return durable(near.groupBy("g", "start").agg(F.max("total").alias("total"), *_moments()).mapInPandas(_fits(floor, True), _PARAMS))


def _best(params: DataFrame, keep: int) -> DataFrame:
    """The starts of least determinant of each group; ties go to the first."""
    tops = params.groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("logdet", "start"))), 1, keep).alias("t"))
    return params.join(tops.select("g", F.explode("t.start").alias("start")), ["g", "start"])


def estimates(stats: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """((l, s, g), parameters of each g) from (l, s, x) of all documents with words."""
    counts = durable(stats.groupBy("l", "s").agg(F.count("*").alias("n")))
    names = durable(group_names(counts, min_group))
    x = durable(stats.join(small(names), ["l", "s"]).select("g", "x"))
    totals = durable(counts.join(names, ["l", "s"]).groupBy("g").agg(F.sum("n").alias("total")))
    floor = floors(x)
    first = x.join(small(totals), "g").select("g", "x", "total", F.explode(F.sequence(F.lit(0), F.lit(RANDOM))).alias("start")).where((F.col("start") == 0) | chosen(F.col("start"), F.col("total")))
    params = durable(first.groupBy("g", "start").agg(F.max("total").alias("total"), *_moments()).mapInPandas(_fits(floor, False), _PARAMS))
    for _ in range(EARLY):
        params = _step(x, params, floor)
    params = durable(_best(params, KEEP))
    for _ in range(LATE):
        params = _step(x, params, floor)
    return names, _step(x, durable(_best(params, 1)), floor, chi2(0.975, P))


def _stats(docs: DataFrame) -> DataFrame:
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("source"), _key("lang").alias("l"), _key("source").alias("s"), vector(F.col("text").cast("string")).alias("x"))


def judged(docs: DataFrame, quantile: float = QUANTILE, min_group: int = MIN_GROUP) -> DataFrame:
    """(doc_id, lang, source, n_words, distance2, rejected) of every row; distance2 is null without words."""
    stats = durable(_stats(docs))
    names, params = estimates(stats.where("x[0] > 0").select("l", "s", "x"), min_group)
    of = small(durable(names.join(params, "g").select("l", "s", "mean", "inv")))
    words = F.col("x")[0].cast("long")
    d2 = F.when(words > 0, distance2(F.col("x"), F.col("mean"), F.col("inv")))
    return stats.join(of, ["l", "s"], "left").select("doc_id", "lang", "source", words.alias("n_words"), F.round(d2, 6).alias("distance2"), ((words == 0) | (d2 > chi2(quantile, P))).alias("rejected"))


def accepted(docs: DataFrame, quantile: float = QUANTILE, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of docs that the rules keep. Texts are read twice and never shuffled or written."""
    names, params = estimates(durable(_stats(docs).where("x[0] > 0").select("l", "s", "x")), min_group)
    of = small(durable(names.join(params, "g").select("l", "s", "mean", "inv")))
    columns = docs.columns
    whole = frugal(docs).select(F.struct(*(column(c) for c in columns)).alias("d"), _key("lang").alias("l"), _key("source").alias("s"), vector(F.col("text").cast("string")).alias("x"))
    near = whole.join(of, ["l", "s"]).where((F.col("x")[0] > 0) & (distance2(F.col("x"), F.col("mean"), F.col("inv")) <= chi2(quantile, P)))
    return near.select(*(F.col("d")[c].alias(c) for c in columns))
