"""Suffix-array dedup: passages of at least K words that stand earlier in the corpus are cut; the first copy stays.

Words are runs of characters other than ASCII white space, compared byte for byte. A window of K words repeats if it
stands at a smaller (doc_id, place) anywhere in the corpus; every word of a repeated window is cut.

Per shard (some MB of documents): the suffixes of the word sequence are sorted by Larsson-Sadakane refinement in numpy
(groups of equal prefixes are sorted by the group number h words on, h doubling, and suffixes that stand alone are
left out of later rounds); the common prefixes of neighbours follow by Kasai's rule (a suffix shares at least one word
less than the one before it) in its permuted form, so that only suffixes where the rule gives no value are compared.
Neighbours that share K words are one window; only its first copy in the shard goes on.

Across shards: runs of windows go, packed, to the part of their minimizer (the least 25-word hash in a window,
which equal windows have in common); there the fingerprints of all shards are merged and each shard's windows are found
by binary search. About 10 bytes a word are shuffled, texts never; the suffix arrays themselves stay in their shards (README).
There is a part for every PART_BYTES of text, so its size does not grow with the corpus. Fingerprints have 64 bits and only
those of one part are compared: among W words about W * W / (2 ** 65 * parts) windows are taken for equal falsely, 2 of
16,000,000,000,000 at 100 TB.

Cases: null texts and texts of fewer than K words have no windows; rows with a null doc_id are left out of the search
and kept whole; rows that share a doc_id name the same places, so a window at the same place of both is no repeat;
repeated rows under other ids are cut as any copy; overlapping repeats merge into one span; an empty table gives an
empty result; very long texts count in full; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import NONSPACE, column, durable, frugal, lean, mix, power, slices, small

K = 50
SHARD_BYTES = 2 << 20
PART_BYTES = 16 << 20
#: Partitions of the merge; beyond them a task merges several parts, one after another.
MOST_TASKS = 50_000
_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 1 << 64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence of integers, whose last is least and occurs once, by Larsson-Sadakane refinement."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    sa = np.argsort(t, kind="stable")
    new = np.concatenate([[True], t[sa[1:]] != t[sa[:-1]]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    alone = new & np.append(new[1:], True)
    at, h = np.flatnonzero(~alone), 1
    while len(at):
        i = sa[at]
        key = rank[i] * n + rank[np.minimum(i + h, n - 1)]
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        sa[at] = i
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[i] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.append(new[1:], True)
        at, h = at[~alone], 2 * h
    return sa


class Prefix:
    """Hashes of any run of a sequence, from running sums."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power(_STEP, self.n + 1)[: self.n], dtype=np.uint64)])
        self.back = power(_BACK, self.n + 1)[: self.n + 1]

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * self.back[start]


def common_prefix(sa: np.ndarray, t: np.ndarray, h: np.ndarray) -> np.ndarray:
    """lcp[j]: words that the suffixes sa[j - 1] and sa[j] share, by Kasai's rule. h are hashes of t, equal where t is."""
    n = len(sa)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    # Where the words before both suffixes agree, the value is one less than that of the suffix before.
    follows = (i > 0) & (before > 0)
    follows[follows] = t[i[follows] - 1] == t[before[follows] - 1]
    follows[0] = False
    ask = np.flatnonzero(~follows & (before >= 0))
    low, high = np.zeros(len(ask), np.int64), n - np.maximum(ask, before[ask])
    prefix = Prefix(h)
    equal = t[ask] == t[before[ask]]
    high = np.where(equal, high, 0)
    live = np.flatnonzero(equal)
    while len(live):
        middle = (low[live] + high[live] + 1) // 2
        a = ask[live]
        same = prefix.of(a, middle) == prefix.of(before[a], middle)
        low[live] = np.where(same, middle, low[live])
        high[live] = np.where(same, high[live], middle - 1)
        live = live[low[live] < high[live]]
    value = np.zeros(n, np.int64)
    value[ask] = low
    source = np.maximum.accumulate(np.where(follows, 0, i))
    value = np.where(follows, np.maximum(value[source] - (i - source), 0), value)
    return value[sa]


def slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of x[i:i + w]; shorter at the end."""
    f, pad = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    out, size = x.copy(), 1
    while size < w:
        step = min(size, w - size)
        moved = np.full(len(out), pad, np.uint64)
        moved[: max(0, len(out) - step)] = out[step:]
        out, size = f(out, moved), size + step
    return out


def shard_windows(ids: np.ndarray, words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of a shard sorted by doc_id: document, place, fingerprint and minimizer of each window, and whether an earlier one in the shard equals it."""
    n, docs = len(words), len(doc) - 1
    size = np.diff(doc)
    owner = np.repeat(np.arange(docs), size)
    place = np.arange(n) - doc[:-1][owner]
    window = np.flatnonzero(place + k <= size[owner])
    none = np.zeros(0, np.int64)
    if not len(window):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    # Each document ends in a word of its own, so that no common prefix crosses from one into the next.
    end = doc[1:] + np.arange(docs)
    h = np.empty(n + docs, np.uint64)
    inside = np.ones(n + docs, bool)
    inside[end] = False
    h[inside] = words
    h[end] = mix(np.arange(1, docs + 1, dtype=np.uint64) * np.uint64(_STEP))
    _, t = np.unique(words, return_inverse=True)
    code = np.empty(n + docs, np.int64)
    code[inside], code[end] = t + docs, docs - 1 - np.arange(docs)
    sa = suffix_array(code)
    lcp = common_prefix(sa, code, h)
    same = lcp >= k
    repeated = np.zeros(n + docs, bool)
    if same.any():
        group = np.cumsum(~same) - 1
        first = np.minimum.reduceat(sa, np.flatnonzero(~same))
        many = same | np.append(same[1:], False)
        p, g = sa[many], group[many]
        f = first[g]
        doc_of = lambda x: np.searchsorted(end, x)
        d, df = doc_of(p), doc_of(f)
        start = doc[:-1] + np.arange(docs)
        later = (p != f) & ~((ids[d] == ids[df]) & (p - start[d] == f - start[df]))
        repeated[p] = later
    prefix = Prefix(words)
    half = (k + 1) // 2
    reach = k - half + 1
    gram = np.full(n, _TOP, np.uint64)
    ok = np.flatnonzero(place + half <= size[owner])
    gram[ok] = mix(prefix.of(ok, half))
    return owner[window], place[window], mix(prefix.of(window, k) ^ np.uint64(0x5851F42D4C957F2D)), slide(gram, reach, True)[window], repeated[window + owner[window]]


def _ranges(owner: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by (owner, start) -> owner, first and last-plus-one word of runs of them."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]) if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1 if len(at) else at
    return owner[at], start[at], start[last] + k


def _shards(k: int, parts: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("doc_id").combine_chunks()
            for first, last, text in slices(table.column(1), NONSPACE, False, shard_bytes):
                ids = table.column(0).slice(first, last - first).to_numpy()
                owner, place, fp, least, repeated = shard_windows(ids, text.hash(), text.doc, k)
                if not len(owner):
                    continue
                o, s, e = _ranges(owner[repeated], place[repeated], k)
                # What is known to repeat already goes along to some part, without fingerprints.
                rows = [(int(ids[0] % parts), ids[o].tobytes(), s.astype(np.int32).tobytes(), e.astype(np.int32).tobytes(), b"")] if len(o) else []
                owner, place, fp, least = owner[~repeated], place[~repeated], fp[~repeated], least[~repeated]
                if len(owner):
                    to = (mix(least) % np.uint64(parts)).astype(np.int64)
                    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (to[1:] != to[:-1])])
                    at = np.flatnonzero(new)
                    many = np.diff(np.append(at, len(owner)))
                    by = np.argsort(to[at], kind="stable")
                    run_to, run_at, run_n = to[at][by], at[by], many[by]
                    ends = np.append(np.flatnonzero(run_to[1:] != run_to[:-1]) + 1, len(run_to))
                    for x, y in zip(np.concatenate([[0], ends[:-1]]), ends):
                        a, m = run_at[x:y], run_n[x:y]
                        to_take = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                        rows.append((int(run_to[x]), ids[owner[a]].tobytes(), place[a].astype(np.int32).tobytes(), m.astype(np.int32).tobytes(), fp[to_take].tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "docs", "starts", "sizes", "prints"])

    return lean(run)


def _merged(rows: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """(document, first, last plus one) of the repeats of one part. Each row is what one shard sent."""
    none = np.zeros(0, np.int64)
    prints = [(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.uint64)) for r in rows if r[3]]
    out = [(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32)) for r in rows if not r[3]]
    if prints:
        every = np.concatenate([x[3] for x in prints])
        every.sort()
        known = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        hits = []
        for docs, starts, sizes, fp in prints if len(known) else ():
            at = np.minimum(np.searchsorted(known, fp), len(known) - 1)
            there = np.flatnonzero(known[at] == fp)
            upto = np.cumsum(sizes)
            run = np.searchsorted(upto, there, "right")
            hits.append((at[there], docs[run], starts[run] + there - np.concatenate([[0], upto])[run]))
        if hits:
            g, doc, place = (np.concatenate(x) for x in zip(*hits))
            by = np.lexsort((place, doc, g))
            g, doc, place = g[by], doc[by], place[by]
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
            later = (doc != doc[begin]) | (place != place[begin])
            doc, place = doc[later], place[later]
            by = np.lexsort((place, doc))
            out.append(_ranges(doc[by], place[by].astype(np.int64), k))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come with those of one part next to one another; a part is held at a time."""
        part, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            d, s, e = _merged(rows, k)
            rows.clear()
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "first", "upto"])

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    yield from done()
                    part = p
                rows.append(row)
        yield from done()

    return lean(run)


def _union(doc: np.ndarray, first: np.ndarray, upto: np.ndarray) -> pa.RecordBatch:
    """Merged spans of whole documents, from spans sorted by document and first word."""
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = np.cumsum(new_doc) << 32
    reach = np.maximum.accumulate(upto + shift)
    new = new_doc | np.concatenate([[True], (first + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    d, a, b = doc[at], first[at], reach[last] - shift[last]
    begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    off = pa.array(np.append(begin, len(d)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(d[begin]), *lists, pa.array(np.add.reduceat(b - a, begin))], names=["doc_id", "firsts", "uptos", "n_cut"])


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans come sorted by document; those of the last one wait for the next batch."""
    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        doc, first, upto = (np.concatenate([r, c.to_numpy().astype(np.int64)]) for r, c in zip(rest, batch.columns))
        n = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
        if n:
            yield _union(doc[:n], first[:n], upto[:n])
        rest = [doc[n:], first[n:], upto[n:]]
    if len(rest[0]):
        yield _union(*rest)


def repeats(docs: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """(doc_id, firsts, uptos, n_cut): for each document with repeats the words firsts[i]..uptos[i] - 1 (from 0) that are cut, and how many."""
    rows = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // part_bytes))
    packed = rows.mapInArrow(_shards(k, parts, shard_bytes), "part int, docs binary, starts binary, sizes binary, prints binary")
    tasks = min(parts, most_tasks)
    packed = packed.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    if parts > tasks:
        packed = packed.sortWithinPartitions("part")
    found = packed.mapInArrow(_merge(k), "doc_id long, first int, upto int")
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "first").mapInArrow(_unions, "doc_id long, firsts array<int>, uptos array<int>, n_cut long")


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text = names.index("text")
        for batch in batches:
            columns, firsts, uptos = batch.column(0).flatten(), batch.column(1), batch.column(2)
            text = columns[at_text]
            touched = np.flatnonzero(firsts.is_valid().to_numpy(zero_copy_only=False))
            keep, values = np.ones(batch.num_rows, bool), None
            if len(touched):
                values, take = text.to_pylist(), pa.array(touched)
                a, b = firsts.take(take).to_pylist(), uptos.take(take).to_pylist()
                for lo, hi, t in slices(text.take(take), NONSPACE, False):
                    for i in range(lo, hi):
                        off = t.off[i - lo]
                        raw, out, done = t.buf[off : t.off[i - lo + 1]].tobytes(), [], 0
                        places = np.append(t.start[t.doc[i - lo] : t.doc[i - lo + 1]] - off, len(raw))
                        for x, y in zip(a[i], b[i]):
                            out.append(raw[done : places[min(x, len(places) - 1)]])
                            done = int(places[min(y, len(places) - 1)])
                        new = b"".join([*out, raw[done:]])
                        keep[touched[i]] = bool(new.strip())
                        values[touched[i]] = new.decode()
            new = text if values is None else pa.array(values, pa.string())
            out = pa.RecordBatch.from_arrays([new if i == at_text else c for i, c in enumerate(columns)], names=names)
            yield out if keep.all() else out.filter(pa.array(keep))

    return lean(run)


def without_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with the repeats cut out of text, and n_chars made to fit; a document of which no word is left goes."""
    spans = small(durable(repeats(docs, k).select("doc_id", "firsts", "uptos")))
    names = docs.columns
    whole = frugal(docs).select(F.struct(*(column(c) for c in names)).alias("d"))
    out = whole.join(spans, F.col("d.doc_id").cast("long") == spans["doc_id"], "left")
    out = out.select("d", "firsts", "uptos").mapInArrow(_cut(names), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def sql(table: str = "documents", k: int = K) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS w FROM {table} WHERE doc_id IS NOT NULL),
     win AS (SELECT doc_id, unnest(range(len(w) - {k - 1})) AS i,
                    unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: md5(array_to_string(w[i:i + {k - 1}], ' ')))) AS h FROM w WHERE len(w) >= {k}),
     rep AS (SELECT doc_id, i FROM (SELECT *, doc_id * 4194304 + i AS own, min(doc_id * 4194304 + i) OVER (PARTITION BY h) AS earliest FROM win) WHERE own > earliest),
     cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS j FROM rep),
     isl AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM cov),
     span AS (SELECT doc_id, g, CAST(min(j) AS INTEGER) AS a, CAST(max(j) + 1 AS INTEGER) AS b FROM isl GROUP BY doc_id, g)
SELECT doc_id, list(a ORDER BY a) AS firsts, list(b ORDER BY a) AS uptos, CAST(sum(b - a) AS BIGINT) AS n_cut FROM span GROUP BY doc_id"""
