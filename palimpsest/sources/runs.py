"""Sorted runs as Parquet files, each with its statistics."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import UNBOUNDED, VERSIONS, Bound, is_tombstone, overlaps
from ..plans.compaction import Run
from .files import Files

#: A Bloom filter of each run's keys, as large as they need; otherwise one takes 1 MB in every file.
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_runs(versions: DataFrame, files: Files, first_id: int, parts: int = 1, folder: str = "runs") -> list[Run]:
    """Write versions as `parts` runs at most: range-partitioned by key, so that a key's versions share a run, and sorted. One row
    of statistics for each run comes back. Empty input makes no run."""
    spark, name = versions.sparkSession, f"{folder}/{first_id:08d}"
    rows = versions.select(F.col("key").cast("binary"), F.col("ts").cast("long"), F.col("value").cast("binary"))
    dealt = rows.repartitionByRange(parts, "key") if parts > 1 else rows.coalesce(1)
    path = files.address(name)
    dealt.sortWithinPartitions("key", F.desc("ts")).write.mode("overwrite").options(**BLOOM).parquet(path)
    stats = (
        spark.read.schema(VERSIONS).parquet(path).withColumn("file", F.col("_metadata.file_path")).groupBy("file")
        .agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum(F.length("key") + F.length("value")).alias("size"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n"), F.count_if(is_tombstone(F.col("value"))).alias("dead"))
        .orderBy("low").collect()
    )
    return [Run(first_id + i, bytes(s.low), bytes(s.high), s["size"], s.max_ts or 0, s.n, s.dead, s.file) for i, s in enumerate(stats)]


def read_runs(spark: SparkSession, runs: list[Run], lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    """The versions of the runs whose key ranges may meet the bounds; other files are not opened. A bulk write's runs hold no times,
    as they were written before its commit: theirs is the one in the catalog."""
    met = [r for r in runs if overlaps(r.low, r.high, lower, upper)]
    plain, bulk = [r.path for r in met if not r.at], [r for r in met if r.at]
    found = [spark.read.schema(VERSIONS).parquet(*plain)] if plain else []
    if bulk:
        times = F.from_json(F.lit(json.dumps({_name(r.path): r.at for r in bulk})), "map<string,bigint>")
        rows = spark.read.schema(VERSIONS).parquet(*[r.path for r in bulk])
        found.append(rows.select("key", F.element_at(times, F.col("_metadata.file_name")).alias("ts"), "value"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], VERSIONS)


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def parts_of(size: int, target: int) -> int:
    return max(1, math.ceil(size / target))
