"""Benchmark decontamination: a broadcast hash set of test n-grams, against which the word windows of all documents are scanned.

Windows are compared by a 64-bit hash first; every hit is then checked word by word. The test set is broadcast in blocks of
bounded size, so a test set of any size is scanned whole; each block after the first is a pass that writes only its hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IN_WORD, LOWER, map_texts, run_hashes, running, steps, text_or_empty, utf8, word_runs, work_dir, written

#: Words of a window.
WINDOW = 10
#: Code points of test items in one broadcast: five times as many bytes in a worker, 40 MB.
BLOCK_CHARS = 8_000_000

_SPANS = "struct<n_words:long,starts:array<long>,ends:array<long>,items:array<string>>"


class WindowSet:
    """The windows of some items: for each length the sorted hashes and where the windows begin. Their words are compared on a hit."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.names = window, [item for item, _ in items]
        raw = [LOWER[np.frombuffer(text.encode(), np.uint8)] for _, text in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
        starts, ends, first = word_runs(data, offsets, IN_WORD)
        self.data, self.starts, self.ends, self.first = data.tobytes(), starts.astype(np.int32), ends.astype(np.int32), first
        words, size = run_hashes(data, starts, ends), np.diff(first)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero(size >= n if n == window else size == n)
            count = size[own] - n + 1
            at = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            hashes = run_hashes(words, at, at + n)
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = hashes[order], at[order].astype(np.int32)
        self.known: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def items(self, n: int, value: int, gram: bytes) -> set[str]:
        """The items with this window, of n words, whose hash is `value`."""
        if (n, value) not in self.known:
            hashes, at = self.windows[n]
            low, high = np.searchsorted(hashes, np.uint64(value)), np.searchsorted(hashes, np.uint64(value), side="right")
            found: dict[bytes, set[str]] = {}
            for w in at[low:high].tolist():
                words = b" ".join([self.data[a:b] for a, b in zip(self.starts[w : w + n].tolist(), self.ends[w : w + n].tolist(), strict=True)])
                found.setdefault(words, set()).add(self.names[int(np.searchsorted(self.first, w, side="right")) - 1])
            self.known[n, value] = found
        return self.known[n, value].get(gram, set())


class Scanner:
    """Hit words and items of each text of a column."""

    def __init__(self, windows: WindowSet) -> None:
        self.windows = windows
        size = max(20, int(max((len(h) for h, _ in windows.windows.values()), default=0) * 8).bit_length())
        self.shift = np.uint64(64 - size)
        self.maybe = {n: self._bits(h, size) for n, (h, _) in windows.windows.items()}

    def _bits(self, hashes: np.ndarray, size: int) -> np.ndarray:
        bits = np.zeros(1 << size, bool)
        bits[hashes >> self.shift] = True
        return bits

    def __call__(self, texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        n_words, spans, items = [], [], []
        for a, b in steps(offsets):
            n, s, i = self._scan(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
            n_words.append(n), spans.extend(s), items.extend(i)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n_words), pa.int64()), pa.array([[x[0] for x in s] for s in spans], pa.list_(pa.int64())), pa.array([[x[1] for x in s] for s in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "starts", "ends", "items"],
        )

    def _scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list, list]:
        """Words of each row; its hit words as spans of word numbers; the items whose windows it holds."""
        starts, ends, first = word_runs(data, offsets)
        rows = len(offsets) - 1
        spans: list[list] = [[] for _ in range(rows)]
        items: list[set] = [set() for _ in range(rows)]
        if len(starts):
            words = run_hashes(data, starts, ends)
            raw = data.tobytes()
            for n, (known, _) in self.windows.windows.items():
                at = np.arange(max(0, len(words) - n + 1))
                h = run_hashes(words, at, at + n)
                at = at[self.maybe[n][h >> self.shift]]
                place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                at = at[known[place] == h[at]]
                row = np.searchsorted(first, at, side="right") - 1
                inside = at + n <= first[row + 1]
                for w, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                    gram = b" ".join([raw[a:b] for a, b in zip(starts[w : w + n].tolist(), ends[w : w + n].tolist(), strict=True)])
                    if found := self.windows.items(n, int(h[w]), gram):
                        items[r] |= found
                        spans[r].append((w - int(first[r]), w - int(first[r]) + n))
        return np.diff(first), [_merged(s) for s in spans], [sorted(i) for i in items]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; only one block at a time is on the driver. An item longer than a block is one of its own."""
    block, size = [], 0
    named = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), text_or_empty(benchmark[text_col]).alias("text"))
    for item, text in named.where("text <> ''").toLocalIterator(prefetchPartitions=False):
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For every row: `row` (the columns in `keep`, all by default) and `out`: n_words, the hit words as spans of word numbers
    (`starts`, `ends`, sorted and apart), and `items`, the sorted identifiers of the items whose windows occur.

    Words are runs of digits, letters and anything beyond ASCII, with A-Z in lower case. A window is `window` consecutive words
    of an item; an item of fewer words is one window; one without words has none. Null texts have no words; a null identifier
    counts as the empty string; items with equal identifiers are one. Empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(docs, text_col, first, window, keep)
    folder = work_dir(spark, "decontam")
    names = docs.columns if keep is None else keep
    whole = F.struct(*[docs[c] for c in names]).alias("whole") if names else F.struct(F.lit(0).alias("none")).alias("whole")
    docs = written(docs.select(F.monotonically_increasing_id().alias("at"), whole, docs[text_col].cast("string").alias("body")), f"{folder}/docs")
    words = written(_pass(docs, "body", first, window, ["at"]).select("row.at", "out.*"), f"{folder}/first")
    parts = [words.where(F.size("starts") > 0)]
    for n, block in enumerate(chain([second], blocks)):
        found = _pass(docs, "body", block, window, ["at"]).where(F.size("out.starts") > 0)
        parts.append(written(found.select("row.at", "out.*"), f"{folder}/hits-{n}"))
    hits = reduce(DataFrame.unionByName, parts).select("at", "items", F.arrays_zip("starts", "ends").alias("spans"))
    merged = hits.groupBy("at").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    reach = running(F.transform("spans", lambda s: s["ends"]), lambda x, before: F.greatest(x, before))
    merged = merged.select("at", "items", F.transform("spans", lambda s: s["starts"]).alias("begins"), reach.alias("reach"))
    apart = lambda i: F.coalesce(F.get("begins", i) > F.get("reach", i - 1), F.lit(True))  # noqa: E731  whether a span begins behind all before it
    starts = F.filter("begins", lambda _, i: apart(i))
    ends = F.filter("reach", lambda _, i: apart(i + 1))
    merged = merged.select("at", starts.alias("starts"), ends.alias("ends"), "items")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = F.struct("n_words", none("starts", "array<long>"), none("ends", "array<long>"), none("items", "array<string>")).alias("out")
    return docs.select("at", "whole").join(words.select("at", "n_words"), "at").join(merged, "at", "left").select(F.col("whole").alias("row"), out)


def _pass(docs: DataFrame, text_col: str, block: list[tuple[str, str]], window: int, keep: list[str] | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(block, window))
    return map_texts(docs, text_col, lambda: Scanner(shared.value), T._parse_datatype_string(_SPANS), keep)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """`docs` without the documents that hold a window of a test item, or (`remove="spans"`) without the hit words and what stands between them."""
    found = scan(docs, benchmark, text_col, **options)
    if remove == "documents":
        return found.where(F.size("out.starts") == 0).select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    flat = found.select(*[F.col(f"row.{c}").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.to_json(F.struct("out.starts", "out.ends", F.col(f"row.{text_col}").alias("text"))).alias("job"))
    cut = map_texts(flat, "job", lambda: _cut_column, T.StringType(), [f"c{i}" for i in range(len(docs.columns))])
    return cut.select(*[(F.col("out") if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def _cut_column(jobs: pa.Array) -> pa.Array:
    import json

    return pa.array([cut_spans(j.get("text"), j["starts"], j["ends"]) for j in map(json.loads, jobs.to_pylist())], pa.string())


def cut_spans(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """`text` without its words of these numbers."""
    if text is None or not starts:
        return text
    raw = text.encode()
    a, b, _ = word_runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), IN_WORD)
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at : a[s]])
        at = int(b[e - 1])
    return b"".join([*out, raw[at:]]).decode()
