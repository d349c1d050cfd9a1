"""The driver's `events` as a version log: the key is the user, the time event_id + 1, and an `error` event a delete; and that in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = {"key": "k", "ts": "ts", "value": "v"}
PROBE, LOW, HIGH, BEGIN = "00000007", "00000003", "00000052", "00000010"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    return e.select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("k"), (F.col("event_id") + 1).alias("ts"), value.alias("v"))


def times(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The read time and the watermark: 60 and 30 % of the latest time."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    last = 0 if last is None else last + 1
    return last * 6 // 10, last * 3 // 10


KV = """kv AS (SELECT lpad(CAST(user_id AS varchar), 8, '0') AS k, event_id + 1 AS ts,
 CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, ':', CAST(event_id AS varchar)) END AS v FROM events),
 p AS (SELECT CAST(max(ts) * 6 // 10 AS bigint) AS rt, CAST(max(ts) * 3 // 10 AS bigint) AS wm FROM kv)"""
VIS = "vis AS (SELECT k, max_by(v, ts) AS v, max(ts) AS ts FROM kv WHERE ts <= (SELECT rt FROM p) GROUP BY k)"
RUNS = "runs AS (SELECT *, CAST(floor((ts - 1) / 1000) AS bigint) AS run_id FROM kv)"
GC = """r AS (SELECT k, ts, v, ts <= (SELECT wm FROM p) AS old,
 row_number() OVER (PARTITION BY k, ts <= (SELECT wm FROM p) ORDER BY ts DESC) AS n FROM kv)"""
