"""The engine's queries over the driver's tables, and their SQL: operators as DataFrame transformations here, the store's own in
`store_queries`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.keys import UNBOUNDED, Bound, excluded, included
from ..operators import runs as R
from ..operators import transactions as X
from ..operators import versions as V
from . import store_queries
from .events import BEGIN, GC, HIGH, KV, LOW, NAMES, PROBE, RUNS, VIS, table, times, versions


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).withColumn("run_id", F.floor((F.col("ts") - 1) / 1000))


def _scan(lower: Bound, upper: Bound) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.snapshot(versions(spark, sf_dir), times(spark, sf_dir)[0], lower, upper, **NAMES).select("k", "v")

    return query


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.snapshot(versions(spark, sf_dir), times(spark, sf_dir)[0], **NAMES)


def time_dedup_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.newest(versions(spark, sf_dir), times(spark, sf_dir)[0], **NAMES)


def seek_take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = V.snapshot(versions(spark, sf_dir), times(spark, sf_dir)[0], included(BEGIN), **NAMES)
    return V.seek(seen.select("k", "v"), included(BEGIN), 5, "k")


def no_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.no_deleted(versions(spark, sf_dir), "v")


def watermark_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.watermark_gc(versions(spark, sf_dir), times(spark, sf_dir)[1], **NAMES)


def two_merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are the upper source, all other events the lower one."""
    kv = versions(spark, sf_dir)
    upper = F.col("v").startswith("click")
    return V.two_merge(kv.where(upper), kv.where(~upper), ["k"]).select("k", "v", "src")


def memtable_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.layered(versions(spark, sf_dir).withColumn("layer", F.floor((F.col("ts") - 1) / 100)), "layer", "k").select("k", "v", "layer")


def txn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events after the read time are a transaction's own writes over what it reads."""
    kv, (rt, _) = versions(spark, sf_dir), times(spark, sf_dir)
    return V.overlay(V.newest(kv, rt, **NAMES), V.newest(kv.where(F.col("ts") > rt), None, **NAMES), "k", "v")


def occ_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a transaction that reads and writes its key, and began 100 events before it commits."""
    kv = versions(spark, sf_dir)
    reads = kv.select(F.col("ts").alias("txn"), (F.col("ts") - 100).alias("read_ts"), F.col("ts").alias("commit_ts"), "k")
    return X.conflicts(reads, kv.select(F.col("ts").alias("commit_ts"), "k"), 100, "k")


def reader_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event begins a reader of its time, which ends 50 events later."""
    kv = versions(spark, sf_dir)
    begun = kv.select(F.col("ts").alias("ev_ts"), F.col("ts").alias("read_ts"), F.lit(1).alias("d"))
    ended = kv.select((F.col("ts") + 50).alias("ev_ts"), F.col("ts").alias("read_ts"), F.lit(-1).alias("d"))
    return X.reader_watermark(begun.unionByName(ended), times(spark, sf_dir)[0])


def sst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_stats(_runs(spark, sf_dir), **NAMES)


def key_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = versions(spark, sf_dir)
    ranges = lambda g, name: kv.groupBy(g.cast("long").alias(name)).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    shares = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)  # a range of three events meets half of all ranges of keys
    return R.overlapping(ranges(F.floor((F.col("ts") - 1) / 3), "src"), ranges(F.floor(F.col("k").cast("long") / 10), "dst"), shares=shares)


def source_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("run_id") % 4
    sized = _runs(spark, sf_dir).groupBy(level.alias("lvl")).agg(F.sum(F.length("k") + F.length("v")).alias("sz")).withColumn("sz", F.col("sz") * (F.col("lvl") + 1))
    wanted = F.when(F.col("lvl") == 0, 20000).when(F.col("lvl") == 1, 90000).when(F.col("lvl") == 2, 100000).otherwise(200000)
    scored = sized.withColumn("score", F.col("sz").cast("double") / wanted.cast("double")).where("score > 1.0")
    return scored.select("lvl", F.row_number().over(W.orderBy(F.col("lvl") != 0, F.desc("score"))).cast("long").alias("priority"))  # four levels


def prefix_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prefix_sizes(_runs(spark, sf_dir), 8, key="k")


def bloom_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probed keys that are live: a Bloom filter of the live keys lets few others through to the join."""
    probe = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("k"))
    live = snapshot_scan(spark, sf_dir)
    bits, turns = bloom.shape(live.count())
    return R.members(bloom.may_contain(probe, "k", bloom.build(live, "k", bits, turns), bits, turns), live, "k")


def ycsb_update_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates arrive in the order of orders, lines, parts and suppliers, so within a key the last of that order is the newest."""
    arrived = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("v"))
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(arrived).alias("last"), F.count(F.lit(1)).alias("versions"))
    return last.select("k", "last.v", "versions")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "snapshot_scan": snapshot_scan,
    "time_dedup_with_tombstones": time_dedup_with_tombstones,
    "point_get": _scan(included(PROBE), included(PROBE)),
    "get_missing_key": _scan(included("--"), included("--")),
    "scan_incl_incl": _scan(included(LOW), included(HIGH)),
    "scan_incl_excl": _scan(included(LOW), excluded(HIGH)),
    "scan_excl_incl": _scan(excluded(LOW), included(HIGH)),
    "scan_excl_excl": _scan(excluded(LOW), excluded(HIGH)),
    "scan_incl_unbounded": _scan(included(LOW), UNBOUNDED),
    "scan_excl_unbounded": _scan(excluded(LOW), UNBOUNDED),
    "scan_unbounded_incl": _scan(UNBOUNDED, included(HIGH)),
    "scan_unbounded_excl": _scan(UNBOUNDED, excluded(HIGH)),
    "seek_take_n": seek_take_n,
    "no_deleted": no_deleted,
    "watermark_gc": watermark_gc,
    "two_merge_priority": two_merge_priority,
    "memtable_layering": memtable_layering,
    "txn_overlay": txn_overlay,
    "occ_conflict": occ_conflict,
    "reader_watermark": reader_watermark,
    "sst_stats": sst_stats,
    "key_range_overlap": key_range_overlap,
    "source_ranking": source_ranking,
    "prefix_compress": prefix_compress,
    "bloom_point_lookup": bloom_point_lookup,
    "ycsb_update_mix": ycsb_update_mix,
} | store_queries.QUERIES

def _live(test: str) -> str:
    return f"WITH {KV}, {VIS} SELECT k, v FROM vis WHERE v <> '' AND {test}"


ORACLE_SQL: dict[str, str] = {
    "snapshot_scan": f"WITH {KV}, {VIS} SELECT k, v, ts FROM vis WHERE v <> ''",
    "time_dedup_with_tombstones": f"WITH {KV}, {VIS} SELECT k, v, ts FROM vis",
    "point_get": _live(f"k = '{PROBE}'"),
    "get_missing_key": _live("k = '--'"),
    "scan_incl_incl": _live(f"k >= '{LOW}' AND k <= '{HIGH}'"),
    "scan_incl_excl": _live(f"k >= '{LOW}' AND k < '{HIGH}'"),
    "scan_excl_incl": _live(f"k > '{LOW}' AND k <= '{HIGH}'"),
    "scan_excl_excl": _live(f"k > '{LOW}' AND k < '{HIGH}'"),
    "scan_incl_unbounded": _live(f"k >= '{LOW}'"),
    "scan_excl_unbounded": _live(f"k > '{LOW}'"),
    "scan_unbounded_incl": _live(f"k <= '{HIGH}'"),
    "scan_unbounded_excl": _live(f"k < '{HIGH}'"),
    "seek_take_n": _live(f"k >= '{BEGIN}'") + " ORDER BY k LIMIT 5",
    "no_deleted": f"WITH {KV} SELECT k, ts, v FROM kv WHERE length(v) > 0",
    "watermark_gc": f"WITH {KV}, {GC} SELECT k, ts, v FROM r WHERE NOT old OR (n = 1 AND v <> '')",
    "two_merge_priority": f"""WITH {KV}, u AS (SELECT k, ts, v, CASE WHEN v LIKE 'click%' THEN 0 ELSE 1 END AS src FROM kv),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, ts DESC) AS n FROM u) SELECT k, v, src FROM r WHERE n = 1""",
    "memtable_layering": f"""WITH {KV}, lay AS (SELECT k, ts, v, CAST(floor((ts - 1) / 100) AS bigint) AS layer FROM kv),
 r AS (SELECT k, v, layer, row_number() OVER (PARTITION BY k ORDER BY layer DESC, ts DESC) AS n FROM lay) SELECT k, v, layer FROM r WHERE n = 1""",
    "txn_overlay": f"""WITH {KV}, {VIS}, loc AS (SELECT k, max_by(v, ts) AS v FROM kv WHERE ts > (SELECT rt FROM p) GROUP BY k)
 SELECT coalesce(l.k, s.k) AS k, coalesce(l.v, s.v) AS v, CASE WHEN l.k IS NULL THEN 'lsm' ELSE 'local' END AS src
 FROM vis s FULL OUTER JOIN loc l ON s.k = l.k WHERE coalesce(l.v, s.v) <> ''""",
    "occ_conflict": f"""WITH {KV}, t AS (SELECT ts AS txn, ts - 100 AS read_ts, ts AS commit_ts, k FROM kv)
 SELECT t.txn, CASE WHEN count(w.k) > 0 THEN 1 ELSE 0 END AS conflict FROM t LEFT JOIN kv w ON t.k = w.k AND w.ts > t.read_ts AND w.ts < t.commit_ts GROUP BY t.txn""",
    "reader_watermark": f"""WITH {KV}, ev AS (SELECT ts AS ev_ts, ts AS read_ts, 1 AS d FROM kv UNION ALL SELECT ts + 50, ts, -1 FROM kv),
 live AS (SELECT read_ts, CAST(sum(d) AS bigint) AS c FROM ev WHERE ev_ts <= (SELECT rt FROM p) GROUP BY read_ts)
 SELECT coalesce((SELECT min(read_ts) FROM live WHERE c > 0), (SELECT rt FROM p)) AS watermark""",
    "sst_stats": f"""WITH {KV}, {RUNS} SELECT run_id, count(*) AS n_entries, min(k) AS first_key, max(k) AS last_key, max(ts) AS max_ts,
 CAST(sum(length(k) + length(v)) AS bigint) AS approx_size, CAST(sum(CASE WHEN v = '' THEN 1 ELSE 0 END) AS bigint) AS tombstones FROM runs GROUP BY run_id""",
    "key_range_overlap": f"""WITH {KV}, s AS (SELECT CAST(floor((ts - 1) / 3) AS bigint) AS src, min(k) AS lo, max(k) AS hi FROM kv GROUP BY 1),
 d AS (SELECT CAST(floor(CAST(k AS bigint) / 10) AS bigint) AS dst, min(k) AS lo, max(k) AS hi FROM kv GROUP BY 1)
 SELECT s.src, d.dst FROM s JOIN d ON s.lo <= d.hi AND d.lo <= s.hi""",
    "source_ranking": f"""WITH {KV}, {RUNS}, lv AS (SELECT run_id % 4 AS lvl, CAST(sum(length(k) + length(v)) AS bigint) * (run_id % 4 + 1) AS sz FROM runs GROUP BY run_id % 4),
 tgt AS (SELECT 0 AS lvl, CAST(20000 AS bigint) AS t UNION ALL SELECT 1, 90000 UNION ALL SELECT 2, 100000 UNION ALL SELECT 3, 200000),
 sc AS (SELECT lv.lvl, CAST(sz AS double) / CAST(t AS double) AS score FROM lv JOIN tgt ON lv.lvl = tgt.lvl)
 SELECT lvl, CAST(row_number() OVER (ORDER BY CASE WHEN lvl = 0 THEN 0 ELSE 1 END, score DESC) AS bigint) AS priority FROM sc WHERE score > 1.0""",
    "prefix_compress": f"""WITH {KV}, {RUNS}, d AS (SELECT run_id, k, min(k) OVER (PARTITION BY run_id) AS fk FROM runs),
 c AS (SELECT *, list_max(list_transform(range(0, 9), lambda i: CASE WHEN substr(k, 1, i) = substr(fk, 1, i) THEN i ELSE 0 END)) AS pl FROM d)
 SELECT run_id, CAST(sum(pl) AS bigint) AS shared_bytes, CAST(sum(length(k) - pl) AS bigint) AS suffix_bytes FROM c GROUP BY run_id""",
    "bloom_point_lookup": f"""WITH {KV}, {VIS}, probe AS (SELECT DISTINCT lpad(CAST(o_custkey AS varchar), 8, '0') AS k FROM orders)
 SELECT p2.k FROM probe p2 WHERE EXISTS (SELECT 1 FROM vis WHERE vis.k = p2.k AND v <> '')""",
    "ycsb_update_mix": """WITH ops AS (SELECT l_orderkey AS k, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, l_quantity AS v FROM lineitem)
 SELECT k, max_by(v, seq) AS v, count(*) AS versions FROM ops GROUP BY k""",
} | store_queries.ORACLE_SQL
