"""What the corpus operators share: work folders on shared storage, bounded Arrow batches, and numpy views of text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import made_dirs, remove, work_dir  # noqa: F401

#: Bytes of text that one vectorised step works on; its temporaries take about 60 times as much.
STEP_BYTES = 1 << 20
#: Code points of a piece of a text in which spans are replaced.
PIECE = 1024


def cleanup(spark: SparkSession, name: str = "") -> None:
    """Remove the work folders of this session, or those made under `name`, once no result that reads from them is needed any more."""
    for gone in [p for p in made_dirs(spark) if p.rpartition("/")[2].startswith(name)]:
        remove(spark, gone)


#: Remove what a query shuffled as soon as it ends, instead of when the driver's garbage is collected.
SWEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, path: str) -> DataFrame:
    """`df` as a Parquet table on shared storage: a lost executor costs a read, never the lineage. Its shuffles go as it is there."""
    with settings(df.sparkSession, SWEPT):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table of numbers or digests that every executor gets, so that the texts it is joined with don't move: about 200 MB.
FEW = 1 << 21


def few(table: DataFrame) -> DataFrame:
    """A written table for Spark to broadcast if it has at most FEW rows, whatever the session's threshold; a larger one is shuffled."""
    return F.broadcast(table) if table.count() <= FEW else table


def bounded_batches(spark: SparkSession, records: int = 512) -> None:
    """Keep Arrow batches small, so that some very long texts in one batch fit a Python worker (a session setting, read when a plan runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


#: Let Spark filter the larger side of a join by a Bloom filter of the smaller one, however large the tables are.
FILTERED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
}


@contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trimmed() -> None:
    """Give back what a Python worker's allocators keep, as a worker stays for further stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def collected(spark: SparkSession) -> None:
    """Let each executor's JVM collect its garbage and give back the heap beyond what it then needs; otherwise it keeps what the
    largest step before made it grow to, beside what Python workers take in the next one. One task for each core, no rows."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def text_or_empty(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def running(values: Column, both) -> Column:
    """`both` of all elements up to each one, by doubling: as many passes over the array as its size has binary digits."""
    passes = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    apart = F.transform(F.sequence(F.lit(0), passes), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(apart, values, lambda now, d: F.transform(now, lambda x, i: both(x, F.get(now, i - d))))


def spans_replaced(found: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """The columns inside `row` of `found`, with every one of `spans` (start, end, kind, by start) in `text_col` replaced by [KIND];
    spans that overlap are replaced together, by the first one's kind. The text is cut into pieces first, so that no cut counts
    its place from the beginning of a long text."""
    body = text_or_empty(F.col(f"row.{text_col}"))
    reach = running(F.transform("spans", lambda s: s["end"]), lambda x, before: F.greatest(x, before))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    found = found.select("row", "spans", F.char_length(body).alias("size"), reach.alias("reach"), pieces.alias("pieces"))

    def cut(a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.array_join(F.slice("pieces", first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(b <= a, "").otherwise(F.substr(some, a - first * PIECE + 1, b - a))

    def step(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("reach", i - 1), F.lit(0))
        return F.when(s["start"] < before, "").otherwise(F.concat(cut(before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))

    rest = cut(F.coalesce(F.get("reach", F.size("reach") - 1), F.lit(0)), F.col("size"))
    text = F.concat(F.array_join(F.transform("spans", step), ""), rest)
    return found.select(*[(F.when(F.col(f"row.{c}").isNotNull(), text) if c == text_col else F.col(f"row.{c}")).alias(c) for c in columns])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (one more than rows). Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes of words: digits, letters, and everything beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  one table a process
    """_BASE ** i and its inverse modulo 2 ** 64, for i below n or more."""
    if len(cache.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        cache["up"], cache["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return cache["up"], cache["down"]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each run: equal runs hash alike wherever they stand."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_runs(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word, and each row's first word (one more than rows). No word crosses rows."""
    inside = in_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def map_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], pa.Array]], out: T.DataType, keep: list[str] | None = None) -> DataFrame:
    """Columns `row` (a struct of the columns in `keep`, all by default) and `out` (what the function of `make()` returns for each text).

    The input's columns stay inside `row`, so none of their names can clash. `make` runs once a task, on the executor.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    row = F.struct(*[docs[c] for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("none")).alias("row")
    sent = docs.select(row, docs[text_col].cast("string").alias("text"))
    schema = T.StructType([sent.schema["row"], T.StructField("out", out)])
    kind = to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            of = of or make()
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), of(batch.column(1)).cast(kind)], ["row", "out"])
        trimmed()

    return sent.mapInArrow(run, schema)
