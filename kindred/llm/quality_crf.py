"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line has features of its own and those of the lines before and after it; two labels, transitions between neighbours.
Forward-backward runs over all documents of a slice at once, one step per line number. A document's quality is the mean of
its lines' probabilities of being good, weighted by their bytes; a line is labelled good if that probability is at least one half.

Training: at most per_class documents of either label (a documented bound, by hash order), every line bearing the label of
its document; a line of a bad document that also stands in a good one counts as good. The penalised likelihood is
maximised by Adam over the full batch, the same in every run.

Cases: a null text or one of only line ends has no lines, null quality and is not kept; lines of only white space are lines
like others, without words; a document of one line has no neighbours and no transition; repeated rows get equal
values; without labels of both classes all weights are 0, so every quality is 0.5; the threshold then
falls to 0.5, and all are kept; very long texts count in full;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import WORD, Text, frugal, grams, lean, slices
from kindred.llm.quality_rules import DIGIT, LETTER, SYMBOL, UPPER
from kindred.llm.samples import labelled

PER_CLASS = 2000
THRESHOLD = 0.7
SLICE = 1 << 18
SCHEMA = "doc_id long, n_lines int, line_good array<boolean>, line_p array<float>, quality double, kept boolean"
_LINE = np.array([c != 10 for c in range(256)])
_STOP = np.array([chr(c) in ".!?" for c in range(256)])
OWN = ("words", "symbols", "upper", "digits", "word_bytes", "stutter", "loops", "long_words", "stop", "copy")
#: Features that a line also has of the line before and of the one after.
NEAR = (1, 2, 3, 5, 6, 9)
WIDTH = len(OWN) + 2 * len(NEAR) + 3


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.sqrt(count / np.maximum(of, 1))


def _again(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a value stands more than once with its owner."""
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def features(line: Text) -> tuple[np.ndarray, np.ndarray]:
    """(line features, line hashes) of the lines of a slice."""
    n = len(line.start)
    if not n:
        return np.zeros((0, WIDTH)), np.zeros(0, np.uint64)
    word = Text(line.buf, line.off, WORD, True)
    size = (line.end - line.start).astype(np.float64)

    def count(table: np.ndarray) -> np.ndarray:
        c = line.bytes_where(table)
        return (c[line.end] - c[line.start]).astype(np.float64)

    at = np.searchsorted(line.start, word.start, "right") - 1
    sums = lambda x: np.bincount(at, x, n)
    words = np.bincount(at, minlength=n).astype(np.float64)
    h, owner = word.hash(), line.owner()
    stutter = np.zeros(len(h))
    if len(h) > 1:
        stutter[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    g, g_at = grams(h, word.doc, 5)
    looped = np.zeros(len(h))
    if len(g):
        g_doc = np.repeat(np.arange(len(g_at) - 1), np.diff(g_at))
        looped[word.doc[:-1][g_doc] + np.arange(len(g)) - g_at[:-1][g_doc]] = _again(g, g_doc)
    letters, hashes = count(LETTER), line.hash()
    own = np.stack([np.log1p(words) / 4, _share(count(SYMBOL), size), _share(count(UPPER), letters), _share(count(DIGIT), size), sums((word.end - word.start).astype(float)) / np.maximum(words, 1) / 10, _share(sums(stutter), words), _share(sums(looped), words), _share(sums(((word.end - word.start) > 30).astype(float)), words), _STOP[line.buf[line.end - 1]].astype(float), _again(hashes, owner).astype(float)], 1)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    last = np.append(first[1:], True)
    near = own[:, NEAR]
    before = np.where(first[:, None], 0.0, np.roll(near, 1, 0))
    after = np.where(last[:, None], 0.0, np.roll(near, -1, 0))
    return np.column_stack([own, before, after, first, last, np.ones(n)]), hashes


def forward_backward(unary: np.ndarray, move: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of good per line, expected transitions, log partition) of all documents. unary: score of good, bad having 0."""
    size = np.diff(doc)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = doc[:-1][order], size[order]
    n = len(unary)
    score = np.stack([np.zeros(n), unary], 1)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for t, m in enumerate(active):
        i = begin[:m] + t
        if t == 0:
            alpha[i] = score[i]
        else:
            p = alpha[i - 1]
            alpha[i] = score[i] + np.logaddexp(p[:, :1] + move[0], p[:, 1:] + move[1])
    for t in range(len(active) - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        b = beta[i + 1] + score[i + 1]
        beta[i] = np.stack([np.logaddexp(move[0, 0] + b[:, 0], move[0, 1] + b[:, 1]), np.logaddexp(move[1, 0] + b[:, 0], move[1, 1] + b[:, 1])], 1)
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.ones(n, bool)
    inner[begin + size - 1] = False
    i = np.flatnonzero(inner)
    pair = np.exp(alpha[i][:, :, None] + move[None] + (beta[i + 1] + score[i + 1])[:, None, :] - z[i][:, None, None]).sum(0) if len(i) else np.zeros((2, 2))
    return good, pair, float(z[begin].sum()) if len(begin) else 0.0


def train(x: np.ndarray, y: np.ndarray, doc: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by maximum likelihood."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.zeros(len(w) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[doc[1:][np.diff(doc) > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
    for k in range(1, steps + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        good, pair, _ = forward_backward(x @ w, move, doc)
        gradient = np.concatenate([x.T @ (y - good), (seen - pair).ravel()]) / max(len(y), 1) - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.2 * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, line in slices(batch.column(1), _LINE, False, SLICE):
            x, h = features(line)
            rows = [(x[a:b].tobytes(), h[a:b].tobytes()) for a, b in zip(line.doc[:-1], line.doc[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column(2).slice(first, last - first)], names=["doc_id", "x", "h", "quality"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    sample = labelled(docs, labels, F.col("quality"), ["quality"], per_class)
    rows = sample.select("doc_id", "text", "quality").mapInArrow(_collect, "doc_id long, x binary, h binary, quality int").collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["doc_id"], bytes(r["x"])))
    if len({r["quality"] for r in rows}) < 2:
        return np.zeros(WIDTH), np.zeros((2, 2))
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, WIDTH) for r in rows])
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
    many = np.array([len(r["h"]) // 8 for r in rows])
    y = np.repeat(np.array([r["quality"] for r in rows], float), many)
    y = np.where(np.isin(h, h[y == 1]), 1.0, y)
    return train(x, y, np.concatenate([[0], np.cumsum(many)]))


def _score(w: np.ndarray, move: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, line in slices(batch.column(1), _LINE, False, SLICE):
                x, _ = features(line)
                good, _, _ = forward_backward(x @ w, move, line.doc)
                size, owner = (line.end - line.start).astype(float), line.owner()
                docs = last - first
                total = np.bincount(owner, size, docs)
                q = np.round(np.bincount(owner, size * good, docs) / np.maximum(total, 1), 6)
                at = pa.array(line.doc.astype(np.int32))
                labels = pa.ListArray.from_arrays(at, pa.array(good >= 0.5)), pa.ListArray.from_arrays(at, pa.array(np.round(good, 4).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, docs), pa.array(line.count().astype(np.int32)), *labels, pa.array(q, mask=total == 0), pa.array((total > 0) & (q >= threshold))], names=["doc_id", "n_lines", "line_good", "line_p", "quality", "kept"])

    return lean(run)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, line_good, line_p, quality, kept) of every row; line_good has the label of every line that is not empty, line_p its probability of being good."""
    w, move = fit(docs, labels, per_class)
    threshold = threshold if w.any() else min(threshold, 0.5)
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(w, move, threshold), SCHEMA)
