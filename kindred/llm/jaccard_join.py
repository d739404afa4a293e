"""N-gram Jaccard join: documents whose sets of word n-grams lie within Jaccard distance 1 - threshold of one another.

Copies. Documents with equal sets (by 128 bits of hash over the distinct grams) are one: the least doc_id stands for them all, and
each copy gets one edge to it. The aggregation that finds them combines on the map side, so a text that is copied a billion
times is one row per task.

Regions. Distances between unrelated texts crowd at 1, so pivots picked from the corpus put every document into every
window (README has figures). Pivots are therefore found where they can matter: documents that agree on a band of
min-hashes form a region around the least of them, its pivot. A document enters the region of each pivot it shares a
band with. A pair at the threshold shares no band with a chance of (1 - threshold ** ROWS) ** BANDS, about 1 in 2,400; that
is the only step that is not exact, and a pair inside a larger group is usually joined through others all the same.

Inside a region. Distances to the pivot part it into core (d <= r), shell (r < d <= 2r) and far. By the triangle
inequality no far document is within r of the core, and a shell document only of core documents whose distance to the
pivot is at most r less than its own: that is its window. Shell and far documents recur with a pivot of their own. The
result is a spanning forest of the exact graph. Regions beyond CHUNK grams are cut into chunks that all hold the
pivot; documents of one that neither the pivot nor any other edge joined to it then meet all chunks, and get an edge to each
component so far that has a document within r of them.

groups(): components of the graph, named by their least doc_id. pairs(): the pairs themselves with their similarity, where
documents with equal sets are represented by the least of them. Words are runs of ASCII letters, digits and characters beyond ASCII;
ASCII case is folded. A text of fewer words than n has one gram of them all.

Cases: null or wordless texts have no grams and no partners; rows with a null doc_id are left out; rows that share a
doc_id are compared each on its own, and what any of them is near to the document is near to; ties go to the smaller doc_id; a
table without partners gives an empty result; very long texts count in full; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import durable, frugal, grams, lean, mix, slices, small
from kindred.operators.cluster import components

N = 2
THRESHOLD = 0.6
BANDS, ROWS = 56, 4
#: Grams that a task holds of a region at a time, 8 bytes each.
CHUNK = 1_500_000
_rng = np.random.default_rng(7)
_TIMES = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def distinct(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each document, in place of all."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = g + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    keep = np.ones(len(g), bool)
    keep[order[1:][key[order[1:]] == key[order[:-1]]]] = False
    return g[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(at) - 1))])


def signatures(n: int):
    """(doc_id, set hash a and b, number of grams, bands) of each row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, last, text in slices(batch.column(1)):
                g, at = distinct(*grams(text.hash(), text.doc, n))
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                begin, size = at[:-1][some], np.diff(at)[some]
                a, b = np.add.reduceat(mix(g), begin), np.add.reduceat(mix(g ^ _OTHER), begin)
                g = (g >> np.uint64(32)).astype(np.uint32)
                out = np.empty((len(some), BANDS), np.uint64)
                for k in range(BANDS):
                    band = np.full(len(some), k + 1, np.uint64)
                    for j in range(k * ROWS, (k + 1) * ROWS):
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(g * _TIMES[j], begin))
                    out[:, k] = band
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(out.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][some]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(size), bands], names=["doc_id", "a", "b", "n", "bands"])

    return lean(run)


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, doc_id, n) from rows sorted by (sig, doc_id), all rows of a sig in one partition: the first of each sig is the pivot of the others."""
    sig_before = pivot_before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[sig_before is None or sig[0] != sig_before], sig[1:] != sig[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        pivot = np.where(at >= 0, doc[np.maximum(at, 0)], doc[0] if pivot_before is None else pivot_before)
        sig_before, pivot_before = sig[-1], pivot[-1]
        keep = np.flatnonzero(pivot != doc)
        yield pa.RecordBatch.from_arrays([pa.array(pivot[keep]), pa.array(doc[keep]), batch.column(2).take(pa.array(keep))], names=["pivot", "doc_id", "n"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, text in slices(batch.column(1)):
                g, at = grams(text.hash(), text.doc, n)
                sets = [np.unique(g[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sets, pa.binary()), batch.column(2).slice(first, last - first)], names=["doc_id", "grams", "to"])

    return lean(run)


class Region:
    """Sets of a region as codes, so that the overlap of one with all others is one pass over a table of marks."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        values, codes = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.mark = np.zeros(len(values), np.uint8)

    def distance(self, i: int, others: np.ndarray) -> np.ndarray:
        """Jaccard distances of i to others, none of which is empty."""
        mine = self.codes[self.at[i] : self.at[i + 1]]
        self.mark[mine] = 1
        n = self.size[others]
        to = np.concatenate([[0], np.cumsum(n)])
        if len(others) == len(self.size):
            hit = self.mark[self.codes]
        else:
            hit = self.mark[self.codes[np.repeat(self.at[others] - to[:-1], n) + np.arange(to[-1])]]
        both = np.add.reduceat(hit, to[:-1], dtype=np.int64)
        self.mark[mine] = 0
        return 1.0 - both / (n + self.size[i] - both)


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def forest(region: Region, r: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within r. Documents come with the pivot first."""
    root, edges = list(range(len(region.size))), []
    levels, rest = [], np.arange(len(region.size))
    while len(rest) > 1:
        pivot, rest = rest[0], rest[1:]
        d = region.distance(pivot, rest)
        core = d <= r
        for j in rest[core]:
            edges.append((int(pivot), int(j)))
            root[_find(root, int(j))] = _find(root, int(pivot))
        shell = ~core & (d <= 2 * r)
        if shell.any() and core.any():
            levels.append((rest[core], d[core], rest[shell], d[shell]))
        rest = rest[~core]
    for core, dc, shell, ds in reversed(levels):
        for x, dx in zip(shell, ds):
            window = dc >= dx - r
            mine, there = _find(root, int(x)), _find(root, int(core[0]))
            if mine == there or not window.any():
                continue
            near = np.flatnonzero(region.distance(int(x), core[window]) <= r)
            if len(near):
                edges.append((int(x), int(core[window][near[0]])))
                root[mine] = there
    return edges


def _rows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """Rows by doc_id, and their sets; equal rows once."""
    pdf = pdf.drop_duplicates(["doc_id", "grams"]).sort_values("doc_id", kind="stable")
    sets = [np.frombuffer(b, np.uint64) for b in pdf["grams"]]
    full = np.array([len(s) > 0 for s in sets], bool)
    return pdf[full], [s for s in sets if len(s)]


def _edges(a: list, b: list) -> pd.DataFrame:
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def _within(r: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, sets = _rows(pdf)
        ids, e = pdf["doc_id"].to_numpy(), forest(Region(sets), r)
        return _edges([ids[x] for x, _ in e], [ids[y] for _, y in e])

    return run


def _across(r: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The left-over documents of a region against those of one chunk: an edge to each other component so far that has a near document."""
        pdf, sets = _rows(pdf)
        ids, root = pdf["doc_id"].to_numpy(), pdf["root"].to_numpy()
        region, a, b = Region(sets), [], []
        here = np.flatnonzero(pdf["home"].to_numpy(bool))
        for k in np.flatnonzero(pdf["guest"].to_numpy(bool)):
            others = here[root[here] != root[k]]
            near = others[region.distance(k, others) <= r] if len(others) else others
            near = near[np.unique(root[near], return_index=True)[1]]
            a += [ids[k]] * len(near)
            b += list(ids[near])
        return _edges(a, b)

    return run


def _all_pairs(r: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs within r of one chunk, or of two different ones. The first row is the pivot; a pair's distances from it differ by at most r."""
        pivot, one, two = (int(pdf[c].iloc[0]) for c in ("pivot", "one", "two"))
        pdf, sets = _rows(pdf)
        ids, chunk, region = pdf["doc_id"].to_numpy(), pdf["salt"].to_numpy(), Region(sets)
        far = region.distance(int(np.flatnonzero(ids == pivot)[0]), np.arange(len(ids)))
        order = np.argsort(far, kind="stable")
        far, out = far[order], []
        for k, i in enumerate(order):
            window = order[k + 1 : np.searchsorted(far, far[k] + r, "right")]
            if one != two:
                window = window[chunk[window] != chunk[i]]
            if len(window):
                d = region.distance(int(i), window)
                out += [(min(ids[i], ids[j]), max(ids[i], ids[j]), 1 - x) for j, x in zip(window[d <= r], d[d <= r]) if ids[i] != ids[j]]
        return pd.DataFrame(out, columns=["doc_a", "doc_b", "jaccard"]).astype({"doc_a": "int64", "doc_b": "int64", "jaccard": "float64"})

    return run


class Regions:
    """The regions of a table: copies (doc_id, rep), star (pivot, doc_id, n) and sizes (pivot, m), m being the number of chunks."""

    def __init__(self, docs: DataFrame, n: int, chunk: int):
        self.n = n
        self.rows = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
        sigs = durable(self.rows.mapInArrow(signatures(n), "doc_id long, a long, b long, n long, bands array<long>"))
        sets = sigs.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n").alias("n"), F.first("bands").alias("bands"))
        self.copies = sigs.select("doc_id", "a", "b").join(sets.where("rep < last").select("a", "b", "rep"), ["a", "b"]).where("doc_id <> rep").select("doc_id", "rep")
        banded = sets.select(F.explode("bands").alias("sig"), F.col("rep").alias("doc_id"), "n").repartition("sig").sortWithinPartitions("sig", "doc_id")
        self.star = durable(banded.mapInArrow(_pivots, "pivot long, doc_id long, n long").groupBy("pivot", "doc_id").agg(F.max("n").alias("n")))
        self.sizes = durable(self.star.groupBy("pivot").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("m")))
        self.salt = F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int").alias("salt")

    def placed(self) -> DataFrame:
        """(doc_id, pivot, salt) of every document of a region; the pivot is in every chunk."""
        own = self.sizes.select(F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"))
        return self.star.join(self.sizes, "pivot").select("doc_id", "pivot", self.salt).unionByName(own)

    def sent(self, places: DataFrame) -> DataFrame:
        """places (doc_id, and what else) with the grams of each: a text is read and cut once for all its places."""
        others = [c for c in places.columns if c != "doc_id"]
        to = places.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("to"))
        cut = self.rows.join(to, "doc_id").select("doc_id", "text", "to")
        sets = cut.mapInArrow(_sets(self.n), f"doc_id long, grams binary, to {to.schema['to'].dataType.simpleString()}")
        return sets.select("doc_id", "grams", F.explode("to").alias("t")).select("doc_id", "grams", *(F.col("t")[c].alias(c) for c in others))


def groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, group_id, group_size) of every document that has a partner; group_id is the least doc_id of the group."""
    r = 1.0 - threshold + 1e-12
    reg = Regions(docs, n, chunk)
    edges = reg.sent(reg.placed()).groupBy("pivot", "salt").applyInPandas(_within(r), "a long, b long")
    edges = durable(edges.unionByName(reg.copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    of = durable(components(edges, "a", "b"))
    wide = reg.sizes.where("m > 1")
    if not wide.isEmpty():
        # Documents of chunked regions that are still apart from their pivot meet every other chunk of the region.
        lab = lambda name: of.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        member = reg.star.join(small(durable(wide)), "pivot").join(lab("doc_id"), "doc_id", "left").join(lab("pivot"), "pivot", "left")
        member = durable(member.select("doc_id", "pivot", "m", F.coalesce("doc_id_root", "doc_id").alias("root"), F.coalesce("pivot_root", "pivot").alias("pivot_root")))
        apart = durable(member.where("root <> pivot_root").select("doc_id", "pivot", "m", "root"))
        if not apart.isEmpty():
            busy = member.join(apart.select("pivot").distinct(), "pivot", "left_semi")
            home = busy.select("doc_id", "pivot", reg.salt, F.lit(True).alias("home"), F.lit(False).alias("guest"), "root")
            guest = apart.select("doc_id", "pivot", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"), F.lit(False).alias("home"), F.lit(True).alias("guest"), "root")
            both = home.unionByName(guest).groupBy("doc_id", "pivot", "salt").agg(F.max("home").alias("home"), F.max("guest").alias("guest"), F.first("root").alias("root"))
            more = reg.sent(both).groupBy("pivot", "salt").applyInPandas(_across(r), "a long, b long")
            of = durable(components(edges.unionByName(more), "a", "b"))
    size = of.groupBy("root").agg(F.count("*").alias("group_size"))
    return of.join(size, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), "group_size")


def pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, chunk: int = CHUNK) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b, of all pairs of at least the threshold. Documents with equal sets are represented by the least of them, with which each of the others makes one pair."""
    r = 1.0 - threshold + 1e-12
    reg = Regions(docs, n, chunk)
    places = reg.placed().join(reg.sizes, "pivot")
    # Every two chunks of a region meet, and each meets itself.
    meets = places.select("doc_id", "pivot", "salt", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    meets = meets.select("doc_id", "pivot", "salt", F.least("salt", "other").alias("one"), F.greatest("salt", "other").alias("two"))
    found = reg.sent(meets).groupBy("pivot", "one", "two").applyInPandas(_all_pairs(r), "doc_a long, doc_b long, jaccard double")
    copies = reg.copies.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return found.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def without_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """docs with one document of each group; rows without a doc_id or without partners stay."""
    gone = small(durable(groups(docs, threshold, n).where("doc_id <> group_id").select(F.col("doc_id").alias("gone"))))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sql_edges(table: str, threshold: float) -> str:
    """CTEs up to e(a, b, jaccard), a and b being row numbers of t. Brute force over all pairs that share a gram."""
    return f"""
t AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(text, '{LOWER[0]}', '{LOWER[1]}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table} WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS g FROM t),
n AS (SELECT i, count(*) AS n FROM g GROUP BY i),
o AS (SELECT a.i AS a, b.i AS b, count(*) AS o FROM g AS a JOIN g AS b ON a.g = b.g AND a.i < b.i GROUP BY ALL),
e AS (SELECT a, b, o / (x.n + y.n - o) AS jaccard FROM o JOIN n AS x ON x.i = a JOIN n AS y ON y.i = b WHERE o >= {threshold} * (x.n + y.n - o))"""


def sql_groups(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """CTEs up to member(doc_id, group_id), for n = 2."""
    return f"""{_sql_edges(table, threshold)},
d AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e JOIN t AS x ON x.i = e.a JOIN t AS y ON y.i = e.b WHERE x.doc_id <> y.doc_id),
s AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
walk AS (SELECT a AS doc_id, a AS group_id FROM s UNION SELECT s.b, walk.group_id FROM walk JOIN s ON s.a = walk.doc_id WHERE walk.group_id < s.b),
member AS (SELECT doc_id, min(group_id) AS group_id FROM walk GROUP BY doc_id)"""


def sql() -> str:
    return f"WITH RECURSIVE {sql_groups()} SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM member"


def sql_pairs() -> str:
    return f"""
WITH {_sql_edges("documents", THRESHOLD)},
     same AS (SELECT i, min(doc_id) OVER (PARTITION BY s) AS rep FROM (SELECT i, list(g ORDER BY g) AS s FROM g GROUP BY i) JOIN t USING (i)),
     near AS (SELECT least(x.rep, y.rep) AS doc_a, greatest(x.rep, y.rep) AS doc_b, jaccard FROM e JOIN same AS x ON x.i = e.a JOIN same AS y ON y.i = e.b),
     copy AS (SELECT rep AS doc_a, doc_id AS doc_b, CAST(1 AS DOUBLE) AS jaccard FROM same JOIN t USING (i))
SELECT DISTINCT doc_a, doc_b, round(jaccard, 9) AS jaccard FROM (SELECT * FROM near UNION ALL SELECT * FROM copy) WHERE doc_a < doc_b"""
