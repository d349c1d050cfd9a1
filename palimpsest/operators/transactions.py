"""Validation and reader bookkeeping as joins and aggregates, for many transactions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(reads: DataFrame, writes: DataFrame, span: int, key: str = "key") -> DataFrame:
    """(txn, conflict) for `reads` (txn, read_ts, commit_ts, key): 1 if a write of a key it read committed strictly between
    its read and commit times. `span` is a usual distance of the two: times are dealt in slots of that length, so a hot key's
    reads meet only the writes near them."""
    slot = lambda c: F.floor(F.col(c) / span)
    asked = reads.withColumn("_slot", F.explode(F.sequence(slot("read_ts"), slot("commit_ts"))))
    done = writes.select(key, F.col("commit_ts").alias("_at")).withColumn("_slot", F.floor(F.col("_at") / span)).distinct()
    hit = asked.join(done, [key, "_slot"]).where((F.col("_at") > F.col("read_ts")) & (F.col("_at") < F.col("commit_ts"))).select("txn").distinct()
    return reads.select("txn").distinct().join(hit.withColumn("_hit", F.lit(1)), "txn", "left").select("txn", F.coalesce("_hit", F.lit(0)).alias("conflict"))


def reader_watermark(events: DataFrame, now: int) -> DataFrame:
    """The oldest live reader at `now`, else `now` itself: `events` (ev_ts, read_ts, d) register (1) and release (-1) readers."""
    live = events.where(F.col("ev_ts") <= F.lit(now)).groupBy("read_ts").agg(F.sum("d").alias("c")).where("c > 0")
    return live.agg(F.coalesce(F.min("read_ts"), F.lit(now).cast("long")).alias("watermark"))
