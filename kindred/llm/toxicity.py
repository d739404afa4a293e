"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models; each model also sees the probabilities of the
categories before it. In training those come out of fold, so that a later model learns from predictions as good as it
will get, not from fitted ones; for scoring, each category's model is fitted on the whole sample. A fold's predictions owe
nothing to its own labels: the lexicon is picked anew from the other folds, and equal texts are in one fold.

The chain: low_quality (1 - labels.quality), toxic (labels.toxic), both (a toxic text of low quality). All labels come from
the table of labels, none from the features.

Features: whether a document has a word, or a word with the first 4 or 5 bytes, of those that best tell toxic documents
apart in the sample; shares of symbols, capitals, digits, stutters, loops and long words; the logarithm of the words. Presence,
not frequency, so that one long text is judged as are many short ones.

The sample has at most per_class documents of either label (a documented bound, by hash order); scoring reads every document.

Cases: a null or empty text has no features and no flags, its probabilities null; without labels of both classes nothing is
toxic and all probabilities are null; repeated rows get equal values; very long texts count in full; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import Text, frugal, lean, mix, slices
from kindred.llm.quality_rules import DIGIT, LETTER, SYMBOL, UPPER, Counts
from kindred.llm.samples import labelled

CATEGORIES = ("low_quality", "toxic", "both")
PER_CLASS = 2000
WORDS = 256
FOLDS = 4
RIDGE = 3.0
LEAST_DOCS = 4
#: Typical shares, and how many bytes, letters or words of typical text they are smoothed with.
PRIOR = np.array([0.002, 0.02, 0.002, 0.005, 0.005, 0.02])
M = np.array([60.0, 60.0, 300.0, 60.0, 60.0, 60.0])
NAMES = ["doc_id", *(f"p_{c}" for c in CATEGORIES), *(f"is_{c}" for c in CATEGORIES)]
SCHEMA = ", ".join(["doc_id long", *(f"p_{c} double" for c in CATEGORIES), *(f"is_{c} boolean" for c in CATEGORIES)])


def dense(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, features of the whole text) of texts."""
    words, out = [np.zeros(0, np.int64)], [np.zeros((0, len(M) + 1))]
    for _, _, t in slices(texts):
        c = Counts(t)
        n = c.words
        pairs = ((c.of(SYMBOL), c.bytes), (c.of(UPPER), c.of(LETTER)), (c.of(DIGIT), c.bytes), (c.stutter(), n), (c.repeats(5), n), (c.sums(c.size > 30), n))
        words.append(n.astype(np.int64))
        out.append(np.stack([np.log1p(n) / 4, *(np.sqrt((k + m * p) / (of + m)) for (k, of), p, m in zip(pairs, PRIOR, M))], 1))
    return np.concatenate(words), np.concatenate(out)


def codes(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """(document, 32-bit code) of each word and word start."""
    owner = t.owner()
    size = t.end - t.start
    parts = [(owner, t.hash())]
    for k, salt in ((4, 0x51ED270B), (5, 0x2545F491)):
        long = np.flatnonzero(size >= k)
        parts.append((owner[long], mix(t.hash(t.start[long], t.start[long] + k) ^ np.uint64(salt))))
    return np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) >> np.uint64(32)).astype(np.uint32)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 8) -> np.ndarray:
    """Weights, bias last, by Newton steps with a ridge on all but the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        w = w + np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -12, 12)))


@dataclass
class Chain:
    lexicon: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best cut by F1 on out-of-fold probabilities; 1 without positives."""
    if not y.any():
        return 1.0
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    low = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((score[order[k]] + low) / 2)


def folds(same: Sequence[bytes], y: np.ndarray, many: int = FOLDS) -> np.ndarray:
    """A fold for each row: equal texts share one, and each fold gets about as many toxic texts."""
    first: dict[bytes, int] = {}
    at = np.array([first.setdefault(s, k) for k, s in enumerate(same)], np.int64)
    out = np.zeros(len(at), np.int64)
    for label in (0, 1):
        heads = np.flatnonzero((at == np.arange(len(at))) & (y == label))
        out[heads] = np.arange(len(heads)) % many
    return out[at]


def train(features: Callable[[np.ndarray], np.ndarray], ys: list[np.ndarray], fold: np.ndarray) -> tuple[list[np.ndarray], list[float], list[np.ndarray]]:
    """The chain's weights and thresholds, and its out-of-fold probabilities. features(rows): those of all rows, as chosen on the labels of some."""
    every = np.ones(len(fold), bool)
    parts = [(fold == k, features(fold != k)) for k in np.unique(fold)]
    whole, weights, thresholds, seen = features(every), [], [], []
    for y in ys:
        out = np.zeros(len(y))
        for held, x in parts:
            xs = np.column_stack([x, *seen])
            out[held] = probability(xs[held], fit_logistic(xs[~held], y[~held]))
        weights.append(fit_logistic(np.column_stack([whole, *seen]), y))
        thresholds.append(best_threshold(out, y))
        seen.append(out)
    return weights, thresholds, seen


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, x = dense(batch.column(1))
        out = []
        for _, _, t in slices(batch.column(1)):
            owner, code = codes(t)
            key = np.unique((owner.astype(np.uint64) << np.uint64(32)) | code)
            cut = np.searchsorted(key, np.arange(len(t.off), dtype=np.uint64) << np.uint64(32))
            out += [key[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "codes", "dense", "quality", "toxic"])


def lexicon_of(owner: np.ndarray, at: np.ndarray, values: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The codes that tell the toxic among some rows apart best, by chi-square. owner, at: the row and the place in values of each code."""
    seen = rows[owner]
    y = toxic * rows
    hot, all_ = np.bincount(at[seen], y[owner[seen]], len(values)), np.bincount(at[seen], minlength=len(values)).astype(float)
    share = y.sum() / rows.sum()
    expected = np.maximum(all_ * share, 1e-9)
    score = np.where((all_ >= min(LEAST_DOCS, max(1, rows.sum() // 20))) & (hot > expected), (hot - expected) ** 2 / (expected * max(1 - share, 1e-9)), -1.0)
    best = np.argsort(-score, kind="stable")[:WORDS]
    return np.sort(values[best[score[best] >= 0]])


def presence(owner: np.ndarray, code: np.ndarray, docs: int, lexicon: np.ndarray) -> np.ndarray:
    out = np.zeros((docs, len(lexicon)))
    if len(lexicon):
        k = np.minimum(np.searchsorted(lexicon, code), len(lexicon) - 1)
        hit = lexicon[k] == code
        out[owner[hit], k[hit]] = 1.0
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain | None:
    sample = labelled(docs, labels, F.col("toxic"), ["quality", "toxic"], per_class).select("doc_id", "text", "quality", "toxic")
    rows = sorted(sample.mapInArrow(_collect, "doc_id long, codes binary, dense binary, quality int, toxic int").collect(), key=lambda r: (r["doc_id"], bytes(r["codes"])))
    toxic = np.array([r["toxic"] for r in rows], float)
    if len(rows) < 2 * FOLDS or toxic.min(initial=1) == toxic.max(initial=0):
        return None
    fold = folds([bytes(r["codes"]) for r in rows], toxic)
    if any(len(np.unique(toxic[fold != k])) < 2 for k in np.unique(fold)):
        return None
    sets = [np.frombuffer(r["codes"], np.uint32) for r in rows]
    owner, every = np.repeat(np.arange(len(rows)), [len(s) for s in sets]), np.concatenate(sets)
    values, at = np.unique(every, return_inverse=True)
    x = np.stack([np.frombuffer(r["dense"]) for r in rows])

    def features(some: np.ndarray) -> np.ndarray:
        return np.column_stack([presence(owner, every, len(rows), lexicon_of(owner, at, values, toxic, some)), x])

    low = np.array([0.0 if r["quality"] is None else 1.0 - r["quality"] for r in rows])
    weights, thresholds, _ = train(features, [low, toxic, low * toxic], fold)
    return Chain(lexicon_of(owner, at, values, toxic, np.ones(len(rows), bool)), weights, thresholds)


def _score(chain: Chain | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if chain is None:
                none, no = pa.nulls(rows, pa.float64()), pa.array(np.zeros(rows, bool))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[none] * len(CATEGORIES), *[no] * len(CATEGORIES)], names=NAMES)
                continue
            n, whole = dense(batch.column(1))
            door = np.zeros(1 << 16, bool)
            door[chain.lexicon & np.uint32(0xFFFF)] = True
            some = np.zeros((rows, len(chain.lexicon)), bool)
            for first, _, t in slices(batch.column(1)):
                owner, code = codes(t)
                may = door[code & np.uint32(0xFFFF)]
                owner, code = owner[may] + first, code[may]
                if len(code):
                    k = np.minimum(np.searchsorted(chain.lexicon, code), len(chain.lexicon) - 1)
                    hit = chain.lexicon[k] == code
                    some[owner[hit], k[hit]] = True
            x = np.column_stack([some, whole])
            seen: list[np.ndarray] = []
            for w in chain.weights:
                seen.append(probability(np.column_stack([x, *seen]), w))
            blank = n == 0
            p = [pa.array(np.round(s, 6), mask=blank) for s in seen]
            flags = [pa.array((s > c) & ~blank) for s, c in zip(seen, chain.thresholds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *p, *flags], names=NAMES)

    return lean(run)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, and for each category its probability (p_) and whether it is taken to apply (is_), of every row."""
    chain = fit(docs, labels, per_class)
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(chain), SCHEMA)
