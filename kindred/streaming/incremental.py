"""Extension: incremental detection. New names of a stream meet the grams of known records; matches go to a table, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions.similarity import jaccard, trigrams
from kindred.operators.detect import THRESHOLD
from kindred.spec import EntitySpec


def match_new(new: DataFrame, known: DataFrame, spec: EntitySpec, threshold: float = THRESHOLD) -> DataFrame:
    """(id, match_id, block, score): known records of the block whose name is similar to a new one's. Both: (id, name, block)."""
    form = spec.variants[0]
    names = known.select("block", "name").distinct().withColumn("g2", trigrams(form(F.col("name")))).withColumnRenamed("name", "n2")
    fresh = new.select("id", "block", F.col("name").alias("n1"), trigrams(form(F.col("name"))).alias("g1"))
    hit = fresh.join(names, "block").withColumn("score", jaccard(F.col("g1"), F.col("g2"))).where(F.col("score") > threshold)
    k = known.select(F.col("id").alias("match_id"), F.col("name").alias("n2"), "block")
    return hit.join(k, ["block", "n2"]).where(F.col("id") != F.col("match_id")).select("id", "match_id", "block", "score")


def watch(stream: DataFrame, known: Callable[[], DataFrame], spec: EntitySpec, out: str, checkpoint: str, threshold: float = THRESHOLD) -> StreamingQuery:
    """Write the matches of each micro-batch to out/batch=<n>. A batch that is run again overwrites its own folder, so results come once."""

    def step(batch: DataFrame, number: int) -> None:
        match_new(batch, known(), spec, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
