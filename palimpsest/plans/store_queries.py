"""Queries that run through the store itself: its runs, logs, memtables, transactions and compactions, and their SQL.

The event log is loaded into a new store in the shared folder; small dimension tables (nation, region) stand for single writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import excluded, included
from ..operators import runs as R
from ..session import work_dir
from ..sources.commit_log import CommitLog, WriteAhead, fold
from ..sources.files import Files
from ..sources.runs import read_runs
from ..streaming.bridge import write_stream
from . import compaction as C
from .events import BEGIN, GC, HIGH, KV, LOW, PROBE, RUNS, VIS, table, times, versions
from .mvcc import CommitConflict
from .store import DELETE, PUT, Store

#: The parts, by time, in which the event log is loaded, so that runs of level 0 overlap.
PARTS = 4


def _binary(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("k").cast("binary").alias("key"), "ts", F.col("v").cast("binary").alias("value"))


def _text(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("k"), *more, F.col("value").cast("string").alias("v"))


def _new(spark: SparkSession, options: C.Options | None = None, **more) -> Store:
    return Store.open(spark, work_dir(spark, "store"), options, **more)


def _loaded(spark: SparkSession, sf_dir: str, options: C.Options | None = None, after=lambda store: None) -> Store:
    """A store with the event log, in parts by time; `after` each of them something may be done."""
    store, kv = _new(spark, options), versions(spark, sf_dir)
    last = kv.agg(F.max("ts")).first()[0] or 0
    for i in range(PARTS):
        part = kv.where((F.col("ts") > last * i // PARTS) & (F.col("ts") <= last * (i + 1) // PARTS))
        store.load(_binary(part))
        after(store)
    return store


def _reopened(store: Store) -> Store:
    return Store.open(store.spark, store.files.root, store.options)


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recovered store's runs, as of the read time."""
    return _text(_reopened(_loaded(spark, sf_dir)).scan(as_of=times(spark, sf_dir)[0]))


def store_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_loaded(spark, sf_dir).scan(excluded(LOW.encode()), included(HIGH.encode())))


def store_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_loaded(spark, sf_dir).seek(BEGIN.encode(), 5))


def store_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gets of one key and of one that isn't there, while the newest value of a third is still in a memtable."""
    store = _loaded(spark, sf_dir)
    store.put(b"~", b"in memory")
    found = [(k, store.get(k.encode())) for k in (PROBE, "--", "~")]
    return spark.createDataFrame([(k, v.decode()) for k, v in found if v is not None], "k string, v string")


def _compacted(spark: SparkSession, sf_dir: str) -> Store:
    """The store after a full compaction while a reader of the watermark's time lives."""
    store = _loaded(spark, sf_dir, C.Options("full", target_run=1 << 16))
    with store.transaction() as now:
        now.abort()
        reader = store.begin(as_of=times(spark, sf_dir)[1])
        store.compact()
        reader.abort()
    return store


def _in_levels(store: Store) -> DataFrame:
    return _text(read_runs(store.spark, [r for level in store.levels for r in level]), "ts")


def store_compaction_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full compaction leaves of the log's versions."""
    return _in_levels(_reopened(_compacted(spark, sf_dir)))


def compaction_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted log, divided into runs of a target size."""
    names = {"key": "k", "ts": "ts", "value": "v"}
    runs = R.split_runs(_in_levels(_compacted(spark, sf_dir)), 8192, **names)
    size = F.length("k") + F.length("v") + 8
    return runs.groupBy("sst_no").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.max("ts").alias("max_ts"), F.sum(size).cast("long").alias("bytes"))


def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recovered catalog's statistics of the compacted runs, and whether level 1 is free of overlaps."""
    level = _reopened(_compacted(spark, sf_dir)).levels[1]
    total = (sum(r.entries for r in level), sum(r.bytes for r in level), sum(r.tombstones for r in level), max(r.max_ts for r in level), level[0].low.decode(), level[-1].high.decode())
    apart = all(a.high < b.low for a, b in zip(level, level[1:], strict=False))
    return spark.createDataFrame([(*total, apart)], "n long, bytes long, tombstones long, max_ts long, first_key string, last_key string, apart boolean")


def store_compaction_leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest values after leveled compactions between the loads, down to the last level."""

    def settle(store: Store) -> None:
        for _ in range(8):
            if not store.compact():
                break

    store = _loaded(spark, sf_dir, C.Options("leveled", base=1 << 12, target_run=1 << 14), settle)
    return _text(_reopened(store).scan())


def store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single writes, deletes and batches, flushed, recovered and read again."""
    store = _new(spark)
    nations, regions = (table(spark, sf_dir, n).orderBy(f"{n[0]}_{n}key").collect() for n in ("nation", "region"))  # 25 and 5 rows
    for n in nations:
        store.put(f"n{n.n_nationkey:03d}".encode(), n.n_name.encode())
    store.flush_all()
    for n in nations:
        if n.n_regionkey == 2:
            store.delete(f"n{n.n_nationkey:03d}".encode())
    store.put_batch([(PUT, f"r{r.r_regionkey:03d}".encode(), r.r_name.encode()) for r in regions] + [(DELETE, b"r000", b"")])
    store.freeze()
    store.put(b"n001", b"changed")
    return _text(_reopened(store).scan())


def store_bulk_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one commit, the last of each customer counting; then another commit deletes those of low priority."""
    store, orders = _new(spark), table(spark, sf_dir, "orders")
    keyed = orders.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("key"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    store.put_frame(keyed, "o_orderkey")
    low = store.scan().where(F.col("value").cast("string").like("5%"))
    store.put_frame(low.select("key", F.lit(None).cast("binary").alias("value")))
    return _text(_reopened(store).scan())


def store_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees over the event log: its own writes and deletes first; nothing that others commit meanwhile."""
    store = _loaded(spark, sf_dir)
    txn = store.begin()
    for n in table(spark, sf_dir, "nation").collect():  # 25 rows
        key = f"{n.n_nationkey:08d}".encode()
        txn.delete(key) if n.n_regionkey == 2 else txn.put(key, n.n_name.encode())
    store.put(HIGH.encode(), b"of another")
    return _text(txn.scan())


def store_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation a serializable transaction reads its key while others write the keys of region 1: which commits fail."""
    store, out = _new(spark, serializable=True), []
    for n in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        key = f"{n.n_nationkey:03d}".encode()
        txn = store.begin()
        txn.put(b"last", txn.get(key) or b"none")
        with store.transaction(serializable=False) as other:
            other.put(key if n.n_regionkey == 1 else b"elsewhere", b"x")
        try:
            txn.commit()
            out.append((n.n_nationkey, False))
        except CommitConflict:
            out.append((n.n_nationkey, True))
    return spark.createDataFrame(out, "n_nationkey int, conflict boolean")


def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream into a store."""
    store, events = _new(spark), f"{sf_dir}/events.parquet"
    arriving = spark.readStream.schema(spark.read.parquet(events).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name one file
    value = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    keyed = arriving.select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), value.alias("value"), "event_id")
    write_stream(keyed, store, work_dir(spark, "checkpoint"), "event_id", availableNow=True).awaitTermination()
    return _text(store.scan())


def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 events as write-ahead batches, one file each, and what replaying them gives."""
    kv = versions(spark, sf_dir)
    last = kv.agg(F.max("ts")).first()[0] or 0
    files = Files(spark, work_dir(spark, "wal"))
    for r in kv.where(F.col("ts") > last - 500).collect():  # 500 rows
        WriteAhead(files, 0).append(r.ts, {r.k.encode(): r.v.encode()})
    wal = spark.createDataFrame([(k.decode(), ts, v.decode()) for ts, batch in WriteAhead(files, 0).replay() for k, v in batch.items()], "k string, ts long, v string")
    best = F.max(F.struct("ts", "v"))
    done = wal.groupBy("k").agg(best.alias("best"), F.count(F.lit(1)).alias("versions"), F.sum(F.length("k") + F.length("v")).cast("long").alias("bytes"))
    return done.select("k", "best.v", "best.ts", "versions", "bytes")


def manifest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit log of memtables, flushes and a compaction, and where each run is when it is folded."""
    log = CommitLog(Files(spark, work_dir(spark, "log")))
    runs = versions(spark, sf_dir).select(F.floor((F.col("ts") - 1) / 1000).alias("id")).distinct()
    ids = sorted(r.id for r in runs.collect())  # a row for each run of 1,000 events
    record = lambda i: {"id": i, "low": "61", "high": "62", "path": f"{i}"}
    log.append_all({"type": "NewMemtable", "id": i} for i in ids)
    log.append_all({"type": "Flush", "memtable": i, "ts": i, "runs": [record(i)]} for i in ids if i < 8)
    away = [i for i in ids if i < 5]
    log.append({"type": "Compaction", "tasks": [{"source_level": 0, "source_ids": away, "destination_level": 1, "destination_ids": [], "made": []}]})
    state = fold(CommitLog(log.files).records(), 2)
    where = {i: "imm" for i in state.memtables} | {r.id: "l0" for r in state.levels[0]}
    return spark.createDataFrame([(i, where.get(i, "gone")) for i in ids], "id long, state string")


# Plans over a catalog that the event log gives: a row for each run is what the driver sees.


def _catalog(ranges: DataFrame) -> list[C.Run]:
    return [C.Run(r.id, r.lo.encode(), r.hi.encode(), r.sz) for r in ranges.orderBy("lo", "id").collect()]


def _ranges(kv: DataFrame, by) -> DataFrame:
    return kv.groupBy(by.cast("long").alias("id")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.length("k") + F.length("v")).cast("long").alias("sz"))


def level_target_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the levels to which the log's runs are dealt, and their targets."""
    by_time = _catalog(_ranges(versions(spark, sf_dir), F.floor((F.col("ts") - 1) / 1000)))
    sizes = C.level_sizes([[r for r in by_time if r.id % 4 == level] for level in range(4)])
    return spark.createDataFrame(list(zip(range(4), sizes, C.target_sizes(sizes, 1, 1), strict=True)), "lvl int, sz long, target long")


def level_zero_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every 10 keys that a task for the log's earliest 10 events takes with it."""
    kv = versions(spark, sf_dir)
    upper = _catalog(_ranges(kv.where("ts <= 10"), F.col("ts")))
    lower = _catalog(_ranges(kv, F.floor(F.col("k").cast("long") / 10)))
    task = C.level_zero_task([upper, lower], 1)
    return spark.createDataFrame([("source", i) for i in task.source_ids] + [("destination", i) for i in task.destination_ids], "role string, id long")


def claimed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For runs of every 25 keys, the runs of every 10 keys below that each one's task claims."""
    kv = versions(spark, sf_dir)
    upper, lower = (_catalog(_ranges(kv, F.floor(F.col("k").cast("long") / n))) for n in (25, 10))
    tasks = C.other_level_tasks([[], upper, lower], 1, 2)
    return spark.createDataFrame([(t.source_ids[0], i) for t in tasks for i in t.destination_ids], "src long, dst long")


def full_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full plan's runs: those of every 1,000 events in level 0, those of every 10 keys in level 1."""
    kv = versions(spark, sf_dir)
    tasks = C.plan([_catalog(_ranges(kv, F.floor((F.col("ts") - 1) / 1000))), _catalog(_ranges(kv, F.floor(F.col("k").cast("long") / 10)))], C.Options("full"))
    return spark.createDataFrame([("source", i) for t in tasks for i in t.source_ids] + [("destination", i) for t in tasks for i in t.destination_ids], "role string, id long")


def leveled_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leveled plan: runs of every 50 keys in a level too large go one level down to those of every 10 keys that they meet."""
    kv = versions(spark, sf_dir)
    upper, lower = (_catalog(_ranges(kv, F.floor(F.col("k").cast("long") / n))) for n in (50, 10))
    lower = [replace(r, id=r.id + len(upper)) for r in lower]  # no two runs of a store have one number
    tasks = C.plan([[], upper, lower], C.Options("leveled", base=1, levels=3))
    return spark.createDataFrame([(t.source_level, t.source_ids[0], t.destination_level, i - len(upper)) for t in tasks for i in t.destination_ids], "source_level long, src long, destination_level long, dst long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        store_scan, store_range_scan, store_seek, store_point_get, store_compaction_full, compaction_full, store_catalog, store_compaction_leveled, store_writes,
        store_bulk_write, store_transaction, store_conflicts, store_stream, wal_replay, manifest_fold, level_target_sizes, level_zero_plan, claimed_runs, full_plan, leveled_plan,
    )
}

_NOW = "now AS (SELECT k, max_by(v, ts) AS v FROM kv GROUP BY k)"
_BULK = "o AS (SELECT lpad(CAST(o_custkey AS varchar), 8, '0') AS k, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1)"
_KEPT = "g AS (SELECT k, ts, v, length(k) + length(v) + 8 AS sz FROM r WHERE NOT old OR (n = 1 AND v <> ''))"


def _keyed(name: str, n: int) -> str:
    return f"{name} AS (SELECT CAST(floor(CAST(k AS bigint) / {n}) AS bigint) AS id, min(k) AS lo, max(k) AS hi FROM kv GROUP BY 1)"


ORACLE_SQL: dict[str, str] = {
    "store_scan": f"WITH {KV}, {VIS} SELECT k, v FROM vis WHERE v <> ''",
    "store_range_scan": f"WITH {KV}, {_NOW} SELECT k, v FROM now WHERE v <> '' AND k > '{LOW}' AND k <= '{HIGH}'",
    "store_seek": f"WITH {KV}, {_NOW} SELECT k, v FROM now WHERE v <> '' AND k >= '{BEGIN}' ORDER BY k LIMIT 5",
    "store_point_get": f"WITH {KV}, {_NOW} SELECT k, v FROM now WHERE v <> '' AND k IN ('{PROBE}', '--') UNION ALL SELECT '~', 'in memory'",
    "store_compaction_full": f"WITH {KV}, {GC} SELECT k, ts, v FROM r WHERE NOT old OR (n = 1 AND v <> '')",
    "compaction_full": f"""WITH {KV}, {GC}, {_KEPT},
 c AS (SELECT *, sum(sz) OVER (ORDER BY k, ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g)
 SELECT CAST(floor((cum - sz) / 8192) AS bigint) AS sst_no, count(*) AS n, min(k) AS first_key, max(k) AS last_key, max(ts) AS max_ts, CAST(sum(sz) AS bigint) AS bytes FROM c GROUP BY 1""",
    "store_catalog": f"""WITH {KV}, {GC}, {_KEPT} SELECT count(*) AS n, CAST(sum(sz - 8) AS bigint) AS bytes, count(*) FILTER (v = '') AS tombstones,
 max(ts) AS max_ts, min(k) AS first_key, max(k) AS last_key, true AS apart FROM g""",
    "store_compaction_leveled": f"WITH {KV}, {_NOW} SELECT k, v FROM now WHERE v <> ''",
    "store_writes": """SELECT concat('n', lpad(CAST(n_nationkey AS varchar), 3, '0')) AS k, CASE WHEN n_nationkey = 1 THEN 'changed' ELSE n_name END AS v FROM nation WHERE n_regionkey <> 2
 UNION ALL SELECT concat('r', lpad(CAST(r_regionkey AS varchar), 3, '0')), r_name FROM region WHERE r_regionkey <> 0""",
    "store_bulk_write": f"WITH {_BULK} SELECT k, v FROM o WHERE v NOT LIKE '5%'",
    "store_transaction": f"""WITH {KV}, {_NOW}, w AS (SELECT lpad(CAST(n_nationkey AS varchar), 8, '0') AS k, CASE WHEN n_regionkey = 2 THEN '' ELSE n_name END AS v FROM nation)
 SELECT coalesce(w.k, s.k) AS k, coalesce(w.v, s.v) AS v FROM now s FULL OUTER JOIN w ON s.k = w.k WHERE coalesce(w.v, s.v) <> ''""",
    "store_conflicts": "SELECT n_nationkey, n_regionkey = 1 AS conflict FROM nation",
    "store_stream": f"WITH {KV}, {_NOW} SELECT k, v FROM now WHERE v <> ''",
    "wal_replay": f"""WITH {KV}, wal AS (SELECT k, ts, v FROM kv WHERE ts > (SELECT max(ts) - 500 FROM kv))
 SELECT k, max_by(v, ts) AS v, max(ts) AS ts, count(*) AS versions, CAST(sum(length(k) + length(v)) AS bigint) AS bytes FROM wal GROUP BY k""",
    "manifest_fold": f"""WITH {KV}, {RUNS}, ids AS (SELECT DISTINCT run_id FROM runs), log AS (SELECT run_id AS id, 'NewMemtable' AS op FROM ids
 UNION ALL SELECT run_id, 'Flush' FROM ids WHERE run_id < 8 UNION ALL SELECT run_id, 'CompactedAway' FROM ids WHERE run_id < 5)
 SELECT id, CASE WHEN max(CASE WHEN op = 'CompactedAway' THEN 1 ELSE 0 END) = 1 THEN 'gone' WHEN max(CASE WHEN op = 'Flush' THEN 1 ELSE 0 END) = 1 THEN 'l0' ELSE 'imm' END AS state FROM log GROUP BY id""",
    "level_target_sizes": f"""WITH RECURSIVE {KV}, {RUNS}, s AS (SELECT l.lvl, coalesce(CAST(sum(length(k) + length(v)) AS bigint), 0) AS sz FROM range(4) l(lvl) LEFT JOIN runs ON run_id % 4 = l.lvl GROUP BY l.lvl),
 t(lvl, target) AS (SELECT CAST(3 AS bigint), (SELECT greatest(sz, 1) FROM s WHERE lvl = 3) UNION ALL SELECT lvl - 1, CAST(floor(target / 2) AS bigint) FROM t WHERE lvl > 0)
 SELECT CAST(s.lvl AS integer) AS lvl, sz, target FROM s JOIN t ON s.lvl = t.lvl""",
    "level_zero_plan": f"""WITH {KV}, {_keyed("d", 10)}, e AS (SELECT min(k) AS lo, max(k) AS hi FROM kv WHERE ts <= 10)
 SELECT 'source' AS role, ts AS id FROM kv WHERE ts <= 10 UNION ALL SELECT 'destination', id FROM d, e WHERE d.lo <= e.hi AND e.lo <= d.hi""",
    "claimed_runs": f"WITH {KV}, {_keyed('s', 25)}, {_keyed('d', 10)} SELECT min(s.id) AS src, d.id AS dst FROM s JOIN d ON s.lo <= d.hi AND d.lo <= s.hi GROUP BY d.id",
    "full_plan": f"WITH {KV}, {RUNS}, {_keyed('d', 10)} SELECT DISTINCT 'source' AS role, run_id AS id FROM runs UNION ALL SELECT 'destination', id FROM d",
    "leveled_plan": f"WITH {KV}, {_keyed('s', 50)}, {_keyed('d', 10)} SELECT 1 AS source_level, s.id AS src, 2 AS destination_level, d.id AS dst FROM s JOIN d ON s.lo <= d.hi AND d.lo <= s.hi",
}
