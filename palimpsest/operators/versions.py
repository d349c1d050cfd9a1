"""Which versions count: visibility, deduplication, merges by priority, overlays and garbage collection.

All take the names of their key, time and value columns. Times are unique for each key; every aggregate is partial before its
shuffle, and the time filter reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import UNBOUNDED, Bound, is_tombstone, within


def visible(versions: DataFrame, read_ts: int, ts: str = "ts") -> DataFrame:
    """The versions committed at `read_ts` or before."""
    return versions.where(F.col(ts) <= F.lit(read_ts))


def in_range(rows: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, key: str = "key") -> DataFrame:
    return rows.where(within(F.col(key), lower, upper))


def newest(versions: DataFrame, read_ts: int | None = None, key: str = "key", ts: str = "ts", value: str = "value") -> DataFrame:
    """The newest version of each key, of those committed at `read_ts` or before; tombstones included."""
    seen = versions if read_ts is None else visible(versions, read_ts, ts)
    best = seen.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).alias("best"))
    return best.select(key, F.col("best.v").alias(value), F.col("best.t").alias(ts))


def no_deleted(rows: DataFrame, value: str = "value") -> DataFrame:
    """Without tombstones. Only right behind `newest`: earlier, an older version would show."""
    return rows.where(~is_tombstone(F.col(value)))


def snapshot(versions: DataFrame, read_ts: int, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, key: str = "key", ts: str = "ts", value: str = "value") -> DataFrame:
    """What a reader at `read_ts` sees between the bounds; the bounds apply before anything is shuffled."""
    return no_deleted(newest(in_range(versions, lower, upper, key), read_ts, key, ts, value), value)


def seek(rows: DataFrame, begin: Bound, n: int, key: str = "key") -> DataFrame:
    """The first `n` rows from `begin` in order of keys."""
    return in_range(rows, begin, UNBOUNDED, key).orderBy(key).limit(n)


def keep_first(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    ranked = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def with_source(sources: Sequence[DataFrame], name: str = "src") -> DataFrame:
    """All rows with the number of their source."""
    return reduce(DataFrame.unionByName, [s.withColumn(name, F.lit(i)) for i, s in enumerate(sources)])


def merge(sources: Sequence[DataFrame], keys: Sequence[str] = ("key",), ts: str = "ts", src: str = "src") -> DataFrame:
    """One row for each key: from the first source that has it, there the newest. The row's source is in `src`."""
    return keep_first(with_source(sources, src), keys, F.col(src), F.desc(ts))


def two_merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("key",), ts: str = "ts", src: str = "src") -> DataFrame:
    """`merge` of two sources; `a` wins."""
    return merge([a, b], keys, ts, src)


def layered(rows: DataFrame, layer: str, key: str = "key", ts: str = "ts") -> DataFrame:
    """The row of each key in the highest layer that has it, there the newest: layers are memtables or levels, newest highest."""
    return keep_first(rows, [key], F.desc(layer), F.desc(ts))


def overlay(snapshot_rows: DataFrame, local: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A transaction's view: its own writes over a snapshot that still has its tombstones; `src` says where a row is from."""
    s = snapshot_rows.select(F.col(key).alias("sk"), F.col(value).alias("sv"))
    own = local.select(F.col(key).alias("lk"), F.col(value).alias("lv"))
    both = s.join(own, F.col("sk") == F.col("lk"), "full_outer")
    seen = both.select(F.coalesce("lk", "sk").alias(key), F.when(F.col("lk").isNotNull(), F.col("lv")).otherwise(F.col("sv")).alias(value), F.when(F.col("lk").isNull(), "lsm").otherwise("local").alias("src"))
    return no_deleted(seen, value)


def watermark_gc(versions: DataFrame, watermark: int, keep_tombstones: bool = False, key: str = "key", ts: str = "ts", value: str = "value") -> DataFrame:
    """The versions that readers at `watermark` or later can see: all later ones, and of the others each key's newest.

    That one goes if it is a tombstone, unless `keep_tombstones`: then an older version may lie below what is compacted here,
    and must not show again. Later versions are not shuffled; of a key's others each task passes on one.
    """
    later = versions.where(F.col(ts) > F.lit(watermark))
    last = keep_first(visible(versions, watermark, ts), [key], F.desc(ts))
    return later.unionByName(last if keep_tombstones else no_deleted(last, value))
