"""Brute-force versions of operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.llm import jaccard_join, mixing, quality_rules


def brute_mix(rows, alpha=mixing.ALPHA, seed=mixing.SEED):
    count = lambda t: len([w for w in re.split("[ \t\n\r\f\v]+", t or "") if w])
    have = Counter()
    for r in rows:
        have[r[3]] += count(r[1])
    have = {s: n for s, n in have.items() if n}
    w = {s: float(n) ** alpha for s, n in have.items()}
    out = Counter()
    for s, n in have.items():
        epochs, rest = divmod(math.floor(sum(have.values()) * w[s] / sum(w.values())), n)
        keyed = defaultdict(int)
        own = [r for r in rows if r[3] == s]
        key = lambda r: hashlib.md5(f"{seed}|{epochs}|{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: E731, B023
        for r in own:
            keyed[key(r)] += count(r[1])
        taken, total = set(), 0
        for k in sorted(keyed):
            total += keyed[k]
            if total > rest:
                break
            taken.add(k)
        for r in own:
            for e in range(epochs + (key(r) in taken)):
                out[(r[0], r[3], e, count(r[1]))] += 1
    return out


def grams_of(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return set(w) if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def row_sets(rows):
    return [(r[0], g) for r in rows if r[0] is not None and r[1] is not None and (g := grams_of(r[1]))]


def brute_pairs(rows, threshold=jaccard_join.THRESHOLD):
    """Pairs of representatives, and of each copy with its own."""
    rep = {}
    for i, g in row_sets(rows):
        rep[frozenset(g)] = min(i, rep.get(frozenset(g), i))
    out = {(r, i): 1.0 for i, g in row_sets(rows) if (r := rep[frozenset(g)]) != i}
    sets = list(rep.items())
    for k, (x, a) in enumerate(sets):
        for y, b in sets[k + 1 :]:
            both = len(x & y)
            if a != b and both >= threshold * (len(x) + len(y) - both):
                out[min(a, b), max(a, b)] = max(both / (len(x) + len(y) - both), out.get((min(a, b), max(a, b)), 0))
    return out


def brute_groups(rows, threshold=jaccard_join.THRESHOLD):
    root = {i: i for i, _ in row_sets(rows)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs(rows, threshold):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in root:
        members[find(i)].append(i)
    return {(i, g, len(m)) for g, m in members.items() if len(m) > 1 for i in m}


def brute_mcd(x, hashes, floor):
    """Minimum covariance determinant of one group by concentration steps on sorted distances. hashes: for each random start those of the rows."""
    q, n = quality_rules, len(x)
    h = math.ceil(q.H * n) - 1

    def fit(x, scale):
        c = np.cov(x.T, bias=True).reshape(q.P, q.P) * scale
        c[np.diag_indices(q.P)] = np.maximum(np.diag(c), floor)
        w, v = np.linalg.eigh(c)
        w = np.maximum(w, floor.min() * 1e-3)
        return np.log(w).sum(), x.mean(0), (v / w) @ v.T

    def far(p):
        return np.einsum("ij,jk,ik->i", x - p[1], p[2], x - p[1])

    def step(p, least=0.0):
        d = far(p)
        near = d <= max(np.sort(d)[h], least)
        return fit(x[near], q.consistency(near.mean()))

    starts = [fit(x, 1.0)]
    for k in hashes:
        some = (k.astype(object) % (1 << 30)) * n < q.START_DOCS << 30
        if some.any():
            starts.append(fit(x[some.astype(bool)], 1.0))
    for _ in range(q.EARLY):
        starts = [step(p) for p in starts]
    starts = sorted(starts, key=lambda p: p[0])[: q.KEEP]
    for _ in range(q.LATE):
        starts = [step(p) for p in starts]
    return far(step(min(starts, key=lambda p: p[0]), q.chi2(0.975, q.P)))


def brute_quality(spark, rows, min_group=quality_rules.MIN_GROUP):
    """Distance of each row (None without words), over languages and sources with small ones put together."""
    q = quality_rules
    n, x = q.statistics(pa.array([r[1] for r in rows], pa.string()))
    df = spark.createDataFrame([(k, [float(n[k]), *map(float, x[k])]) for k in range(len(rows))], "k int, x array<double>")
    hashes = {r["k"]: list(r)[1:] for r in df.select("k", *(F.xxhash64("x", F.lit(s)) for s in range(1, q.RANDOM + 1))).collect()}
    have = [k for k in range(len(rows)) if n[k]]
    quartile = lambda c, p: np.sort(x[have, c])[math.ceil(p * len(have)) - 1]
    floor = np.array([q.FLOOR * ((quartile(c, 0.75) - quartile(c, 0.25)) / 1.349) ** 2 for c in range(q.P)]) + 1e-12
    count = Counter((rows[k][2], rows[k][3]) for k in have)
    small = Counter()
    for (lang, source), m in count.items():
        small[lang] += m if m < min_group else 0
    groups = defaultdict(list)
    for k in have:
        lang, source = rows[k][2], rows[k][3]
        groups[(lang, source) if count[lang, source] >= min_group else (lang,) if small[lang] >= min_group else ()].append(k)
    out = dict.fromkeys(range(len(rows)))
    for own in groups.values():
        d = brute_mcd(x[own], [np.array([hashes[k][s] for k in own], np.int64) for s in range(q.RANDOM)], floor)
        out |= dict(zip(own, d))
    return [out[k] for k in range(len(rows))]


def brute_repeats(rows, k):
    """Covered words of each document."""
    first, covered = {}, defaultdict(set)
    windows = []
    for r in rows:
        w = (r[1] or "").split()
        if r[0] is not None:
            windows += [((r[0], i), tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    for at, w in windows:
        first[w] = min(first.get(w, at), at)
    for at, w in windows:
        if first[w] != at:
            covered[at[0]] |= set(range(at[1], at[1] + k))
    return covered
