"""Mixing sources to target weights.

Every document gets a hash-random key per epoch. Rows without text are range-sorted by (source, key); each range adds
up its token counts, ranges get the sums of those before them, and running sums find the key at which a source meets
its budget. The cut is then a filter on the documents themselves, so texts are never shuffled. A source whose budget is
several times its tokens gives whole epochs first and cuts only the last.

budget(source) = floor(total * weight(source) / sum of weights). A source gives the longest run of documents, in key
order, whose tokens stay within the budget. Default weights are tokens ** alpha.

Cases: null sources form a source of their own; a null or empty text has no tokens and goes with the run it falls in;
documents with equal keys (repeated rows of one doc_id) stand or fall together, as peers of a RANGE frame do; a null
doc_id has the key of the empty string; a source without tokens has weight 0 and gives nothing; other columns pass
through mix() untouched; an empty table gives an empty result. Explicit weights leave out sources that they don't name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import column, durable, lean, small

ALPHA = 0.7
SEED = "mix-1"
NONE = "∅"


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.length(F.regexp_replace(text, "[^ \\t\\n\\r\\f\\x0B]+[ \\t\\n\\r\\f\\x0B]*", "x")) - F.when(text.rlike("^[ \\t\\n\\r\\f\\x0B]"), F.length(text) - F.length(F.regexp_replace(text, "^[ \\t\\n\\r\\f\\x0B]+", ""))).otherwise(0), F.lit(0)).cast("long")


def key(doc_id: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def budgets(slim: DataFrame, weights: Mapping[str, float] | None, alpha: float, total: int | None) -> DataFrame:
    """(s, have, budget, epochs, rest): a row for each source with tokens."""
    by = slim.groupBy("s").agg(F.sum("n_tokens").alias("have")).where("have > 0")
    if weights is None:
        by = by.withColumn("w", F.pow(F.col("have").cast("double"), F.lit(float(alpha))))
    else:
        named = by.sparkSession.createDataFrame([(NONE if k is None else k, float(v)) for k, v in weights.items() if v > 0] or [("", 0.0)], "s string, w double")
        by = by.join(named, "s")
    sums = by.agg(F.sum("w").alias("w_sum"), F.sum("have").alias("have_sum"))
    by = by.crossJoin(sums).withColumn("budget", F.floor((F.col("have_sum") if total is None else F.lit(total)) * F.col("w") / F.col("w_sum")))
    return by.select("s", "have", "budget", F.floor(F.col("budget") / F.col("have")).alias("epochs"), (F.col("budget") % F.col("have")).alias("rest"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums within a range, whose rows come sorted by (s, k); range partitioning never parts equal (s, k)."""
    last, total = None, 0
    for batch in batches:
        s, n = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
        new = np.array([a != b for a, b in zip(s, [last, *s])], bool)
        sums = np.cumsum(n)
        base = np.where(new, sums - n, 0)
        base[0] = 0 if new[0] else -total
        sums = sums - base[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        last, total = s[-1], int(sums[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums), batch.column(3)], names=["s", "k", "upto", "p"])


def cuts(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: str = SEED) -> DataFrame:
    """(s, epochs, cut): whole epochs of each source, and the last key of the epoch after them that stays within the budget; null: none does."""
    slim = docs.select(F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("s"), F.col("doc_id"), tokens(F.col("text").cast("string")).alias("n_tokens"))
    slim = durable(slim.groupBy("s", "doc_id").agg(F.sum("n_tokens").alias("n_tokens")))
    goal = budgets(slim, weights, alpha, total)
    goal = small(durable(goal))
    keyed = slim.join(goal, "s").select("s", key(F.col("doc_id"), F.col("epochs"), seed).alias("k"), "n_tokens")
    ranged = keyed.repartitionByRange("s", "k").sortWithinPartitions("s", "k").withColumn("p", F.spark_partition_id())
    run = durable(ranged.select("s", "k", "n_tokens", "p").mapInArrow(lean(_running), "s string, k string, upto long, p int"))
    # Ranges are in order, so what comes before a row of a source is what its earlier ranges hold of that source.
    earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = run.groupBy("s", "p").agg(F.max("upto").alias("held")).select("s", "p", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = run.join(before, ["s", "p"]).join(goal, "s").groupBy("s", "k").agg(F.max(F.col("before") + F.col("upto") - F.col("rest")).alias("over")).where("over <= 0").groupBy("s").agg(F.max("k").alias("cut"))
    return goal.join(within, "s", "left").select("s", "epochs", "cut")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: str = SEED, epoch: str | None = "mix_epoch") -> DataFrame:
    """The documents of the mixture with their columns and the epoch (from 0), if it is to have a name: a document stands once for each epoch that takes it. A column of docs that has the epoch's name gives way to it."""
    at = durable(cuts(docs, weights, alpha, total, seed))
    s = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    columns = [c for c in docs.columns if c != epoch]
    out = docs.select(F.struct(*(column(c) for c in columns)).alias("_d"), s.alias("_s"), F.col("doc_id").alias("_id")).join(small(at.withColumnRenamed("s", "_s")), "_s")
    n = F.col("epochs") + F.when(F.col("cut").isNotNull() & (key(F.col("_id"), F.col("epochs"), seed) <= F.col("cut")), 1).otherwise(0)
    return out.withColumn("_n", n.cast("int")).where("_n > 0").select("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_e")).select(*(F.col("_d")[c].alias(c) for c in columns), *([F.col("_e").alias(epoch)] if epoch else []))


def manifest(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, mix_epoch, n_tokens) of the mixture."""
    return mix(docs.select("doc_id", "source", "text"), weights, alpha, total, seed).select("doc_id", "source", "mix_epoch", tokens(F.col("text").cast("string")).alias("n_tokens"))


def sql(table: str = "documents", alpha: float = ALPHA, seed: str = SEED, columns: str = "d.doc_id, d.source, e.mix_epoch, d.n_tokens") -> str:
    return f"""
WITH d AS (SELECT *, coalesce(source, '{NONE}') AS s, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 0) AS n_tokens FROM {table}),
     have AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS have FROM d GROUP BY s HAVING sum(n_tokens) > 0),
     w AS (SELECT s, have, pow(CAST(have AS DOUBLE), {alpha}) AS w FROM have),
     goal AS (SELECT s, have, CAST(floor((SELECT sum(have) FROM w) * w / (SELECT sum(w) FROM w)) AS BIGINT) AS budget FROM w),
     g AS (SELECT s, budget // have AS epochs, budget % have AS rest FROM goal),
     keyed AS (SELECT d.s, d.doc_id, d.n_tokens, md5(concat('{seed}|', g.epochs, '|', coalesce(CAST(d.doc_id AS VARCHAR), ''))) AS k FROM d JOIN g USING (s)),
     run AS (SELECT s, k, sum(n_tokens) OVER (PARTITION BY s ORDER BY k) AS upto FROM keyed),
     cut AS (SELECT run.s, max(k) AS cut FROM run JOIN g USING (s) WHERE upto <= rest GROUP BY run.s),
     n AS (SELECT d.*, g.epochs + CASE WHEN md5(concat('{seed}|', g.epochs, '|', coalesce(CAST(d.doc_id AS VARCHAR), ''))) <= cut.cut THEN 1 ELSE 0 END AS n
           FROM d JOIN g USING (s) LEFT JOIN cut USING (s))
SELECT {columns} FROM n AS d, LATERAL (SELECT unnest(range(d.n)) AS mix_epoch) AS e"""
