"""Exact top-k search as a Voronoi kNN join: every vector is a query against all others.

Pivots (their number grows as the square root of the table, up to PIVOTS) part the vectors into cells; near cells form groups of
about group_rows vectors, and a larger cell is cut into several. Each group is solved within itself first: that gives every
query k neighbours, hence a bound, and each cell its summary (radius, largest bound of its queries). A vector is then sent to
another group only if some cell there can need it by the ball and the hyperplane bound. What one group sends another is a task
of its own, which meets the queries of that group; the k best of all tasks win. So no task holds more than two groups, and
where the bounds exclude nothing, as with vectors that are all about as far apart, each vector still travels only as often as
there are groups, and groups grow with the table up to MOST_ROWS.

Distances are Euclidean; ties go to the smaller neighbour_id; a vector is no neighbour of its own vec_id. Candidates from
the matrix product, in single precision, keep a margin above its rounding error and are measured again directly, so the result is
exact.

Cases: rows with a null id, a null, empty or non-finite embedding, or another length than the commonest one (ties: the
shorter) are left out; rows with one vec_id count once, with the least embedding; equal vectors are neighbours at
distance 0; with fewer than k others a query has fewer rows; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import durable, lean, small

K = 10
PIVOTS = 2048
LEAST_ROWS, MOST_ROWS, GROUPS = 2000, 16_000, 4
#: Distances that a task holds at a time.
BLOCK_CELLS = 2_000_000
SLACK = 1e-6
SCHEMA = "vec_id long, rank int, neighbor_id long, distance double"
_FOUND = "vec_id long, near array<struct<distance:double,neighbor_id:long>>"


def _squares(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    d = q @ s.T
    d *= -2.0
    d += (q * q).sum(1)[:, None]
    d += (s * s).sum(1)[None, :]
    return np.maximum(d, 0.0, out=d)


def clean(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) fit for the join, and the length of all v."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    dims = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = dims[0]["n"] if dims else 0
    return v.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def matrix(column, dim: int) -> np.ndarray:
    """Vectors that came as bytes."""
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [np.array(x, np.float64).tobytes() for x in batch.column(1).to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], names=["vec_id", "v"])


def nearest(ids: np.ndarray, q: np.ndarray, others: np.ndarray, s: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of queries: (place of the query, neighbour ids, distances) of the k nearest within each query's bound, by query, distance and id."""
    order = np.argsort(others, kind="stable")
    others, s = others[order], s[order]
    centre = s.mean(0)
    near_q, near_s = (q - centre).astype(np.float32), (s - centre).astype(np.float32)
    size_q, size_s = ((x.astype(np.float64) ** 2).sum(1) for x in (near_q, near_s))
    top = float(size_s.max())
    bound = np.full(len(ids), np.inf) if bound is None else bound
    block = max(8, BLOCK_CELLS // len(others))
    for at in range(0, len(ids), block):
        part = slice(at, at + block)
        d = _squares(near_q[part], near_s)
        # What single precision may be off by.
        margin = (4 * (q.shape[1] + 8) * 2.0**-24) * (size_q[part] + top) + 1e-30
        own = np.searchsorted(others, ids[part])
        own_row = np.flatnonzero(others[np.minimum(own, len(others) - 1)] == ids[part])
        d[own_row, own[own_row]] = np.inf
        limit = (bound[part] + SLACK) ** 2
        free = np.flatnonzero(np.isinf(limit))
        if len(free) and len(others) > k:
            limit[free] = np.partition(d[free], k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(d <= (limit + 2 * margin)[:, None].astype(np.float32))
        ok = ids[part][row] != others[col]
        row, col = row[ok], col[ok]
        exact = ((q[part][row] - s[col]) ** 2).sum(1)
        by = np.lexsort((others[col], exact, row))
        row, col, exact = row[by], col[by], exact[by]
        first = np.searchsorted(row, np.arange(len(q[part])))
        keep = np.arange(len(row)) - first[row] < k
        yield at + row[keep], others[col[keep]], np.sqrt(exact[keep])


def _lists(rows: int, parts: list[tuple[np.ndarray, ...]]) -> tuple[list[list[dict]], np.ndarray, np.ndarray]:
    """Neighbours of each query as lists, how many, and the distance of the last."""
    at, near, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
    off = np.searchsorted(at, np.arange(rows + 1))
    pairs = [{"distance": x, "neighbor_id": i} for x, i in zip(d.tolist(), near.tolist())]
    many = np.diff(off)
    last = np.where(many > 0, d[np.maximum(off[1:] - 1, 0)], np.inf) if len(d) else np.full(rows, np.inf)
    return [pairs[a:b] for a, b in zip(off[:-1], off[1:])], many, last


def knn_join(vectors: DataFrame, k: int = K, group_rows: int | None = None) -> DataFrame:
    """(vec_id, rank from 1, neighbor_id, distance) for the k nearest others of every vector."""
    spark = vectors.sparkSession
    rows, dim = clean(vectors)
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    rows = durable(rows.mapInArrow(_packed, "vec_id long, v binary"))
    n = rows.count()
    wanted = min(PIVOTS, max(1, 2 * math.isqrt(n)))
    pivots = np.unique(matrix([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()], dim), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = matrix(part.column(1).to_pylist(), dim)
                home = _squares(v, p).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(np.sqrt(((v - p[home]) ** 2).sum(1))), part.column(0), part.column(1)], names=["cell", "d", "vec_id", "v"])

    placed = durable(rows.mapInArrow(lean(assign), "cell int, d double, vec_id long, v binary"))
    held = np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    first, many = grouped(pivots, held, group_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-n // GROUPS))))
    groups = spark.sparkContext.broadcast((first, many))
    table = spark.createDataFrame([(c, int(first[c]), int(many[c])) for c in range(len(pivots))], "cell int, first int, many int")
    # At most PIVOTS rows.
    grouped_rows = placed.join(F.broadcast(table), "cell").withColumn("g", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")).drop("first", "many")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = matrix(pdf["v"], dim), pdf["vec_id"].to_numpy()
        near, found, last = _lists(len(ids), list(nearest(ids, v, ids, v, k)))
        return pd.DataFrame({"g": pdf["g"], "cell": pdf["cell"], "d": pdf["d"], "vec_id": ids, "v": pdf["v"], "near": pd.Series(near, dtype=object), "bound": np.where(found < k, np.inf, last)})

    solved = durable(grouped_rows.groupBy("g").applyInPandas(inside, f"g int, cell int, d double, vec_id long, v binary, {_FOUND.split(', ', 1)[1]}, bound double"))
    radius, bound = np.zeros(len(pivots)), np.full(len(pivots), -math.inf)
    for r in solved.groupBy("cell").agg(F.max("d").alias("radius"), F.max("bound").alias("bound")).collect():
        radius[r["cell"]], bound[r["cell"]] = r["radius"], r["bound"]
    facts = spark.sparkContext.broadcast((radius, bound))

    def needs(v: np.ndarray, home: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether a cell can need a vector: by the ball around its pivot, and by the plane between the pivots."""
        radius, bound = facts.value
        d2 = _squares(v, shared.value)
        gap = apart[home]
        own = d2[np.arange(len(home)), home][:, None]
        # From a point of another cell to a vector of this one it is at least as far as from the plane between them.
        plane = np.where(gap > 0, (d2 - own) / (2.0 * np.where(gap > 0, gap, 1.0)), 0.0)
        return (np.sqrt(d2) - radius <= bound + SLACK) & (plane <= bound + SLACK)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(to, g, vec_id, v): the other groups that each vector is sent to."""
        first, many = groups.value
        apart = np.sqrt(_squares(shared.value, shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                g = part.column(0).to_numpy()
                wanted = needs(matrix(part.column(3).to_pylist(), dim), part.column(1).to_numpy(), apart)
                to = np.zeros((len(g), int((first + many).max())), bool)
                for j in range(int(many.max())):
                    cells = np.flatnonzero(many > j)
                    row, col = np.nonzero(wanted[:, cells])
                    to[row, first[cells[col]] + j] = True
                to[np.arange(len(g)), g] = False
                row, there = np.nonzero(to)
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(g[row]), part.column(2).take(pa.array(row)), part.column(3).take(pa.array(row))], names=["to", "g", "vec_id", "v"])

    sent = solved.select("g", "cell", "vec_id", "v").mapInArrow(lean(replicate), "to int, g int, vec_id long, v binary")
    # Which groups meet, so that queries go only where something waits for them; a row for each two groups at most.
    meets = small(durable(sent.select("to", "g").distinct()))
    asks = solved.select(F.col("g").alias("to"), "vec_id", "v", "bound").join(meets, "to").select("to", "g", "vec_id", "v", "bound")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["bound"].notna().to_numpy()
        q, s = matrix(pdf["v"][ask], dim), matrix(pdf["v"][~ask], dim)
        ids, limit = pdf["vec_id"].to_numpy()[ask], pdf["bound"].to_numpy()[ask]
        near, found, _ = _lists(len(ids), list(nearest(ids, q, pdf["vec_id"].to_numpy()[~ask], s, k, limit)))
        some = found > 0
        return pd.DataFrame({"vec_id": ids[some], "near": pd.Series([x for x, y in zip(near, some) if y], dtype=object)})

    more = sent.withColumn("bound", F.lit(None).cast("double")).unionByName(asks).groupBy("to", "g").applyInPandas(across, _FOUND)
    best = solved.select("vec_id", "near").unionByName(more).groupBy("vec_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("vec_id", F.posexplode("near").alias("at", "x")).select("vec_id", (F.col("at") + 1).cast("int").alias("rank"), "x.neighbor_id", "x.distance")


def grouped(pivots: np.ndarray, held: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the first of its groups and how many it has: near cells together up to so many rows, a cell of more rows alone in several."""
    first, many = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    big = held > rows
    many[big] = -(-held[big] // rows)
    g = 0
    for c in np.flatnonzero(big):
        first[c] = g
        g += many[c]
    left = np.flatnonzero(~big)
    while len(left):
        by = left[np.argsort(_squares(pivots[left[:1]], pivots[left])[0], kind="stable")]
        take = by[: max(1, int(np.searchsorted(np.cumsum(held[by]), rows, "right")))]
        first[take] = g
        left = np.setdiff1d(left, take)
        g += 1
    return first, many


def sql(k: int = K) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""
