import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import bloom
from palimpsest.functions.keys import UNBOUNDED, VERSIONS, Bound, excluded, holds, included, overlaps, shared_prefix
from palimpsest.operators import runs as R
from palimpsest.operators import transactions as X
from palimpsest.operators import versions as V


def log(spark, text):
    """Rows `key=value@ts`."""
    rows = []
    for part in text.split():
        key, rest = part.split("=")
        value, ts = rest.split("@")
        rows.append((key.encode(), int(ts), value.encode()))
    return spark.createDataFrame(rows, VERSIONS)


def shown(df):
    return sorted(f"{bytes(r.key).decode()}={bytes(r.value).decode()}" + (f"@{r.ts}" if "ts" in df.columns else "") for r in df.collect())


def generated(seed, n, keys=6, dead=0.3):
    """A log of distinct times: (key, ts, value)."""
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}".encode(), ts, b"" if rng.random() < dead else f"v{ts}".encode()) for ts in rng.sample(range(1, 4 * n), n)]


def newest_of(rows, at):
    out = {}
    for k, ts, v in sorted(rows, key=lambda r: r[1]):
        if ts <= at:
            out[k] = (ts, v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_prefers_the_first_source(spark, seed):
    sources = [generated(10 * seed + i, 12) for i in range(3)]
    want = {}
    for rows in reversed(sources):
        want |= {k: v for k, (_, v) in newest_of(rows, 99).items()}
    got = V.merge([spark.createDataFrame(rows, VERSIONS) for rows in sources]).collect()
    assert {bytes(r.key): bytes(r.value) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_two_merge_and_keep_first(spark, seed):
    upper, lower = generated(seed, 9), generated(seed + 50, 20)
    got = {bytes(r.key): bytes(r.value) for r in V.two_merge(spark.createDataFrame(upper, VERSIONS), spark.createDataFrame(lower, VERSIONS)).collect()}
    assert got == {k: v for rows in (lower, upper) for k, (_, v) in newest_of(rows, 99).items()}
    placed = [(n, f"x{n * 7 % 5}", str(n)) for n in range(17)]
    kept = V.keep_first(spark.createDataFrame(placed, "place int, key string, value string"), ["key"], F.col("place")).collect()
    assert {r.key: r.value for r in kept} == {k: v for _, k, v in reversed(placed)} and len(kept) == 5


@pytest.mark.parametrize("seed", [5, 6])
def test_newest_and_no_deleted(spark, seed):
    rows = generated(seed, 40)
    df = spark.createDataFrame(rows, VERSIONS)
    for at in (0, 1, 30, 80, 200):
        want = newest_of(rows, at)
        assert {bytes(r.key): (r.ts, bytes(r.value)) for r in V.newest(df, at).collect()} == want
        assert {bytes(r.key): (r.ts, bytes(r.value)) for r in V.snapshot(df, at).collect()} == {k: x for k, x in want.items() if x[1]}


@pytest.mark.parametrize("seed", [7, 8])
@pytest.mark.parametrize("tombstones", [False, True])
def test_watermark_gc(spark, seed, tombstones):
    rows = generated(seed, 40)
    for wm in (0, 25, 90, 200):
        old = {(k, ts, v) for k, (ts, v) in newest_of(rows, wm).items() if v or tombstones}
        want = old | {r for r in rows if r[1] > wm}
        got = V.watermark_gc(spark.createDataFrame(rows, VERSIONS), wm, keep_tombstones=tombstones).collect()
        assert {(bytes(r.key), r.ts, bytes(r.value)) for r in got} == want and len(got) == len(want)


def test_gc_keeps_tombstones_over_older_runs(spark):
    assert shown(V.watermark_gc(log(spark, "a=@2 a=a@1"), 2, keep_tombstones=True)) == ["a=@2"]


def test_gc_changes_no_snapshot_from_the_watermark_on(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"k{rng.randrange(8)}".encode(), ts, rng.choice([b"", b"x", str(ts).encode()])) for ts in range(1, 120)], VERSIONS)
    for wm in (1, 40, 119):
        kept = V.watermark_gc(rows, wm)
        assert all(shown(V.snapshot(rows, ts)) == shown(V.snapshot(kept, ts)) for ts in (wm, wm + 1, 119) if ts <= 119)


KEYS = [b"", b"key1", b"key2", b"key2\x00", b"key3", b"\x80", b"\xff"]


@pytest.mark.parametrize("lower", [UNBOUNDED, included(b"key1"), excluded(b"key1"), excluded(b"\x80")])
@pytest.mark.parametrize("upper", [UNBOUNDED, included(b"key3"), excluded(b"key3")])
def test_bounds(spark, lower, upper):
    rows = spark.createDataFrame([(k, 1, b"v") for k in KEYS], VERSIONS)
    want = [k for k in KEYS if (not lower.limited or k > lower.key or (lower.included and k == lower.key)) and (not upper.limited or k < upper.key or (upper.included and k == upper.key))]
    assert sorted(bytes(r.key) for r in V.in_range(rows, lower, upper).collect()) == sorted(want) == sorted(k for k in KEYS if holds(k, lower, upper))
    assert all(overlaps(k, k, lower, upper) == holds(k, lower, upper) for k in KEYS) and isinstance(lower, Bound)


def test_bounds_reach_the_scan(spark, tmp_path):
    log(spark, "a=1@1 b=2@2").write.parquet(f"{tmp_path}/r")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = V.snapshot(spark.read.parquet(f"{tmp_path}/r"), 5, included(b"a"), excluded(b"b"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed and "LessThanOrEqual(ts,5)" in pushed


def test_overlay(spark):
    seen = V.newest(log(spark, "a=1@1 b=2@1 c=@1 d=4@1"))
    local = spark.createDataFrame([(b"b", b""), (b"c", b"3"), (b"e", b"5")], "key binary, value binary")
    rows = {bytes(r.key): (bytes(r.value), r.src) for r in V.overlay(seen, local).collect()}
    assert rows == {b"a": (b"1", "lsm"), b"c": (b"3", "local"), b"d": (b"4", "lsm"), b"e": (b"5", "local")}


def test_seek(spark):
    rows = log(spark, "a=1@1 b=2@1 c=3@1 d=4@1")
    assert [bytes(r.key) for r in V.seek(rows, included(b"b"), 2).collect()] == [b"b", b"c"]
    assert [bytes(r.key) for r in V.seek(rows, excluded(b"b"), 9).collect()] == [b"c", b"d"]


def test_run_stats_and_envelope(spark):
    rows = log(spark, "a=1@1 b=@7 c=333@2").withColumn("run_id", F.lit(4))
    s = R.run_stats(rows).first()
    assert (s.n_entries, bytes(s.first_key), bytes(s.last_key), s.max_ts, s.approx_size, s.tombstones) == (3, b"a", b"c", 7, 7, 1)
    assert tuple(map(bytes, R.envelope(R.run_stats(rows)).first())) == (b"a", b"c")


def test_overlapping_ranges_as_by_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(i, lo, lo + rng.choice([0, 1, 7, 60])) for i in range(n) for lo in [rng.randrange(200)]]
    a, b = make(60), make(50)
    tables = spark.createDataFrame(a, "src long, lo long, hi long"), spark.createDataFrame(b, "dst long, lo long, hi long")
    for slot in (lambda k: F.floor(k / 10), None, R.quantile_slots(tables[1], 5, 11)):
        got = R.overlapping(*tables, slot)
        assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted((i, j) for i, x, y in a for j, u, v in b if x <= v and u <= y)


def test_overlaps_of_one_slot_are_shared_among_tasks(spark):
    rng = random.Random(6)
    a, b = ([(i, lo, lo + rng.randrange(90)) for i in range(n) for lo in [rng.randrange(100)]] for n in (80, 20))
    tables = spark.createDataFrame(a, "src long, lo long, hi long"), spark.createDataFrame(b, "dst long, lo long, hi long")
    got = R.overlapping(*tables, lambda k: F.lit(0).cast("long"), shares=8)
    assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted((i, j) for i, x, y in a for j, u, v in b if x <= v and u <= y)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_running_size_and_split(spark):
    rng = random.Random(4)
    data = [(f"{rng.randrange(40):03d}".encode() if i % 3 else b"hot", i, b"v" * rng.randrange(9)) for i in range(300)]
    got = R.split_runs(spark.createDataFrame(data, VERSIONS), 100).collect()
    at, want = 0, []
    for k, ts, v in sorted(data, key=lambda r: (r[0], -r[1])):
        want.append((k, ts, at // 100))
        at += len(k) + len(v) + 8
    assert sorted((bytes(r.key), r.ts, r.sst_no) for r in got) == sorted(want)


def test_shared_prefixes(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", "a"), ("abc", "abc"), ("x", "y"), ("ab", "abcd")], "a string, b string")
    assert [r[0] for r in rows.select(shared_prefix(F.col("a"), F.col("b"), 8)).collect()] == [2, 0, 3, 0, 2]


def test_conflicts_as_by_brute_force(spark):
    rng = random.Random(5)
    reads = [(t, t - rng.randrange(1, 60), t, f"k{rng.randrange(3)}") for t in range(100, 200)] + [(100, 40, 100, "k9")]
    writes = [(rng.randrange(30, 200), f"k{rng.randrange(12)}") for _ in range(30)]
    got = X.conflicts(spark.createDataFrame(reads, "txn long, read_ts long, commit_ts long, key string"), spark.createDataFrame(writes, "commit_ts long, key string"), 25)
    want = {}
    for t, lo, hi, k in reads:
        want[t] = max(want.get(t, 0), int(any(lo < w < hi and k == x for w, x in writes)))
    assert {r.txn: r.conflict for r in got.collect()} == want


def test_reader_watermark(spark):
    events = spark.createDataFrame([(1, 5, 1), (2, 3, 1), (3, 3, -1), (9, 5, -1)], "ev_ts long, read_ts long, d int")
    assert [X.reader_watermark(events, t).first()[0] for t in (0, 2, 3, 9)] == [0, 3, 5, 9]


def test_bloom(spark):
    keys = spark.range(2000).select(F.format_string("key%d", "id").alias("k"))
    other = spark.range(10_000).select(F.format_string("other%d", "id").alias("k"))
    bits, turns = bloom.shape(2000)
    assert turns == 6 and 2000 * 10 <= bits < 2000 * 10 + 64
    words = bloom.build(keys, "k", bits, turns)
    assert words.count() <= bits // bloom.WORD and bloom.may_contain(keys, "k", words, bits, turns).count() == 2000
    assert 0 < bloom.may_contain(other, "k", words, bits, turns).count() < 300
    none = bloom.build(keys.limit(0), "k", bits, turns)
    assert bloom.may_contain(other, "k", none, bits, turns).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], VERSIONS)
    assert V.snapshot(none, 9).count() == V.watermark_gc(none, 9).count() == V.merge([none, none]).count() == R.split_runs(none, 10).count() == 0
