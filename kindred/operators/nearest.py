"""For each set the most similar set of its block, by bounds for groups of sets that are alike.

Which set is most similar can't be told from shared rare grams where all sets share some, as names do that end in digits; so each two
tiles of a block are one task. Right sets that stand next to each other in the order of their names form a group; the grams that some
of a group have, and those that all have, bound how many grams any of them shares with a left set. Products of gram matrices give
these bounds; only groups that can hold the best set, or one as good of lesser id, are compared set by set. How many that are depends
on the names; the bounds themselves are quadratic in the sets of a block, at a nanosecond or two for each two sets. A task has bounded
memory, and the result is one row for each set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of a tile of the left and of the right side; grams of a tile, which make tiles of long sets smaller.
LEFT, RIGHT, GRAMS = 8192, 262_144, 8_000_000
#: Left and right sets of one gram matrix; right sets of a group; numbers in a gram matrix.
ROWS, PART, GROUP, CELLS = 256, 4096, 16, 16_000_000
#: Bounds are made in single precision.
_SLACK = 1e-5


def _tile(cells: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best set of the right tile for each set of the left tile, the lesser id of the best."""
    none = np.iinfo(np.int64).max

    def grams(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The grams of all sets, and how many each has."""
        g = t.column("g").combine_chunks()
        return g.flatten().to_numpy(zero_copy_only=False), np.diff(g.offsets.to_numpy()).astype(np.int64)

    def placed(g: np.ndarray, n: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of the grams that have one, and where those of each set begin."""
        at = np.minimum(np.searchsorted(columns, g), len(columns) - 1)
        known = columns[at] == g
        of = np.repeat(np.arange(len(n)), n)[known]
        return at[known], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))])

    def dense(column: np.ndarray, at: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
        """A row for each set, 1 in the column of each gram that it has."""
        out = np.zeros((last - first, width), np.float32)
        out[np.repeat(np.arange(last - first), np.diff(at[first : last + 1])), column[at[first] : at[last]]] = 1
        return out

    def packed(m: np.ndarray) -> np.ndarray:
        """The rows as bits, 64 to a number."""
        bits = np.packbits(m != 0, axis=1)
        return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "best": pa.array([], pa.int64())})
        right = right.take(pc.sort_indices(right.column("near")))
        ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
        (x, n1), (y, n2) = grams(left), grams(right)
        # A gram that one side lacks counts in sizes only.
        columns = np.intersect1d(x, y)
        if not len(columns):
            columns = x[:1]
        (x, x_at), (y, y_at) = placed(x, n1, columns), placed(y, n2, columns)
        width = len(columns)
        score, found = np.full(len(ids), -1.0), np.full(len(ids), none)
        # Right sets of one gram matrix; of those whose groups are kept, a matrix being no larger; left sets of one matrix.
        part = min(PART, max(1, cells // width // GROUP) * GROUP)
        slab, high = max(1, cells // width) * GROUP, max(1, min(ROWS, cells // width))
        for first in range(0, len(others), slab):
            last = min(first + slab, len(others))
            some, every, bits = [], [], []
            for lo in range(first, last, part):
                m = dense(y, y_at, lo, min(lo + part, last), width)
                starts = np.arange(0, len(m), GROUP)
                some.append(np.maximum.reduceat(m, starts))
                every.append(np.minimum.reduceat(m, starts))
                bits.append(packed(m))
            some, every, bits = np.concatenate(some).T, np.concatenate(every).T, np.concatenate(bits)
            starts = np.arange(0, last - first, GROUP)
            own = np.maximum.reduceat(np.diff(y_at[first : last + 1]), starts)
            free = (own - every.sum(0)).astype(np.float32)
            least, lowest = np.minimum.reduceat(n2[first:last], starts).astype(np.float32), np.minimum.reduceat(others[first:last], starts)
            sizes, names = n2[first:last], others[first:last]
            for top in range(0, len(ids), high):
                end = min(top + high, len(ids))
                m = dense(x, x_at, top, end, width)
                mine, size, s, f = packed(m), n1[top:end], score[top:end], found[top:end]

                def compare(rows: np.ndarray, groups: np.ndarray, mine=mine, size=size, s=s, f=f, bits=bits, sizes=sizes, names=names) -> None:
                    """Left sets, in ascending order, with each set of a group; s and f keep the best."""
                    at = np.minimum(groups[:, None] * GROUP + np.arange(GROUP), len(names) - 1)
                    shared = np.bitwise_count(mine[rows][:, None, :] & bits[at]).sum(2, dtype=np.int64)
                    here = 2.0 * shared / (size[rows][:, None] + sizes[at])
                    most = here.max(1)
                    who = np.where(here == most[:, None], names[at], none).min(1)
                    begin = np.flatnonzero(np.diff(rows, prepend=-1))
                    r, best_here = rows[begin], np.maximum.reduceat(most, begin)
                    who = np.minimum.reduceat(np.where(most == np.repeat(best_here, np.diff(begin, append=len(rows))), who, none), begin)
                    better = (best_here > s[r]) | ((best_here == s[r]) & (who < f[r]))
                    s[r[better]], f[r[better]] = best_here[better], who[better]

                bound = np.minimum(m @ some, m @ every + free)
                bound *= 2
                bound /= size.astype(np.float32)[:, None] + least
                compare(np.arange(end - top), bound.argmax(1))
                now = s.astype(np.float32)[:, None]
                rows, groups = np.nonzero((bound >= now * (1 - _SLACK)) & ((bound > now * (1 + _SLACK)) | (lowest < f[:, None])))
                most = max(1, cells // (8 * GROUP * bits.shape[1]))
                for k in range(0, len(rows), most):
                    compare(rows[k : k + most], groups[k : k + most])
        return pa.table({"id": ids, "score": score, "best": found})

    return best


def nearest(left: DataFrame, right: DataFrame, tiles: tuple[int, int] = (LEFT, RIGHT), grams: int = GRAMS, cells: int = CELLS) -> DataFrame:
    """(id, best, score): for each left set the right set of its block with the highest Dice coefficient; ties go to the lesser id.

    left: (block, id long, g), right: (block, id long, g, near), ids being keys and g arrays of distinct longs, none of them empty; read several times.
    near: what brings similar sets together when sorted; it has no influence on the result. Left sets whose block has no right set get no row.
    """
    count = lambda df, most, tag: df.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / most, F.sum(F.size("g")) / grams)).alias(tag))
    both = count(left, tiles[0], "ti").join(count(right, tiles[1], "tj"), "block")
    place = lambda own, other, k, every: (
        F.pmod(F.xxhash64("id"), F.col(own)).alias(k), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(every), "block", "id", "g",
    )
    x, y = left.join(both, "block").select(*place("ti", "tj", "i", "j")), right.join(both, "block").select(*place("tj", "ti", "j", "i"), "near")
    keys = ["block", "i", "j"]
    met = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_tile(cells), "id long, score double, best long")
    return met.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "best")).alias("t")).select("id", "t.best", (-F.col("t.s")).alias("score"))
