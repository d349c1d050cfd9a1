"""SimHash fingerprints of word shingles, linked through a Gray-order hierarchical index.

Fingerprints are dealt out by masked bit patterns: each mask with its pattern is an upper node, whose members agree in the
masked bits. A node's members are sorted by Gray rank and factored again into a tree of nodes, each of which holds the bits
that all below it share. A query gathers its differences on the way down and leaves a whole subtree as soon as they exceed
the radius.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILTERED, collected, few, map_texts, remove, settings, trimmed, work_dir, written
from .components import connected_components

#: Children of a node of a tree.
FANOUT = 8
#: Queries that go down the trees together.
TOGETHER = 4096
#: Members of an upper node that begin together when few are linked, and comparisons that a step of a cluster may make.
AHEAD, WORK = 16, 1 << 20
#: Rows of upper nodes that a task works on together, and nodes after which it passes on what it linked.
CHUNK, HELD = 1 << 16, 500_000
#: Members of an upper node beyond which it is divided.
MANY = 20_000
#: Shingles in one block of a candidate group; what a group of several blocks must compare across them is compared two blocks in a task.
BLOCK = 500_000
#: Rows of fingerprints, and shingles of texts, that are dealt to tasks at once at most, and those for each text and shingle of the
#: input; more are dealt in rounds, each of which leaves links alone, so that the disk which shuffles take grows with the input
#: where the comparisons of large groups don't.
ROUND, ROUND_TEXTS = (1 << 26, 32), (1 << 27, 0.25)
#: Shingles of prefixes that a task sorts together, and those that are dealt to one task.
FLUSH, DEALT = 1 << 19, 1 << 19
#: Texts with the same shingles as an earlier one whose numbers every executor gets (16 MB); more of them are joined.
REPEATED = 1 << 21

#: Further bits, as turns of `remixed`, of the fingerprints that propose groups: with the hashes' own 256 in all. So many leave unlike texts
#: apart: of 128 bits two random fingerprints are within the radius with a probability of 0.0017, of 256 with 1e-9. Chains of such
#: links would join most long texts of a large table to one group.
TURNS = (0, 2, 3)

#: Texts whose shingles say which ones are common, and in how many of them a common one is. Only the order of shingles depends on it.
ORDER_TEXTS, COMMON = 10_000, 4

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# Fingerprints.


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` words, repeats included; of the whole sequence if it is shorter; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), 42)], np.uint64)
    grams = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.fromiter((digest(g, 42) for g in grams), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    planes = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    if len(hashes) < 128:
        ones = _BYTE_BITS[planes].sum(axis=0).ravel()
    else:
        ones = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Further independent bits of the same hashes."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns `row` (the columns in `keep`, all by default) and `out`, the 64-bit fingerprint as a long. Null counts as empty, whose fingerprint is zero."""

    def column(texts: pa.Array) -> pa.Array:
        return _signed([majority(shingle_hashes(t.as_py(), words)) for t in texts])

    return map_texts(docs, text_col, lambda: column, T.LongType(), keep)


# The index.


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each pattern in Gray-code order."""
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


def _rank_column(f: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, s))
    return f


class GrayTrees:
    """Fingerprints (rows of unsigned words), sorted by upper node and Gray rank, and below each upper node a tree of nodes that
    hold the bits which all their members share. `starts` are the upper nodes' first rows."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray) -> None:
        self.prints, self.pruned = prints, 0
        n = len(prints)
        counts = np.diff(np.append(starts, n))
        self.upper = np.repeat(np.arange(len(starts)), counts)
        #: For each upper node the level at which it has one node left.
        self.top = np.zeros(len(starts), np.int64)
        first = np.asarray(starts, np.int64)
        # Masks of shared bits, their patterns, each node's first child and past-the-last row, and each upper node's first node.
        self.levels = [(np.full(prints.shape, ~np.uint64(0)), prints, np.arange(n + 1), np.arange(1, n + 1), first)]
        while (counts > 1).any():
            self.top += counts > 1
            mask, pattern, _, last, _ = self.levels[-1]
            counts = -(-counts // FANOUT)
            above = np.cumsum(counts) - counts
            at = np.repeat(first, counts) + FANOUT * (np.arange(counts.sum()) - np.repeat(above, counts))
            shared = np.bitwise_and.reduceat(mask, at) & (np.bitwise_and.reduceat(pattern, at) | ~np.bitwise_or.reduceat(pattern, at))
            ends = np.append(at[1:], len(mask))
            self.levels.append((shared, pattern[at] & shared, np.append(at, len(mask)), last[ends - 1], above))
            first = above

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i < j of all pairs below one upper node with at most `radius` differing bits, some queries at a time. A query adds
        up its differences from the shared bits on the way down; a group is left as soon as they exceed the radius."""
        tops = self.top[self.upper]
        for top in range(1, len(self.levels)):
            every = np.flatnonzero(tops == top)
            for k in range(0, len(every), TOGETHER):
                query = every[k : k + TOGETHER]
                node = self.levels[top][4][self.upper[query]]
                done, seen = np.zeros(len(query), np.int64), None
                for level in range(top, -1, -1):
                    mask, pattern, child, last, _ = self.levels[level]
                    fresh = mask[node] if seen is None else mask[node] & ~seen
                    done = done + np.bitwise_count((self.prints[query] ^ pattern[node]) & fresh).sum(axis=1)
                    ahead = last[node] > query + 1
                    near = (done <= radius) & ahead
                    if not level:
                        near &= node > query
                        query, node = query[near], node[near]
                        break
                    self.pruned += int((ahead & (done > radius)).sum())
                    query, node, done = query[near], node[near], done[near]
                    wide = child[node + 1] - child[node]
                    seen = np.repeat(mask[node], wide, axis=0)
                    query, done = np.repeat(query, wide), np.repeat(done, wide)
                    node = np.repeat(child[node] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
                yield query, node

    def _reached(self, query: np.ndarray, radius: int, left: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows (query, other) below one upper node with at most `radius` differing bits, of others that are `left`, or of those
        after the query alone. A group without such rows isn't entered either."""
        count = np.concatenate([[0], np.cumsum(left)])
        tops, found = self.top[self.upper[query]], []
        for top in np.unique(tops).tolist():
            q = query[tops == top]
            node = self.levels[top][4][self.upper[q]]
            done, seen = np.zeros(len(q), np.int64), None
            for level in range(top, -1, -1):
                mask, pattern, child, last, _ = self.levels[level]
                begin = np.where(node > 0, last[node - 1], 0)
                ahead = count[last[node]] > count[np.minimum(np.maximum(begin, q + 1), last[node]) if later else begin]
                if not ahead.all():
                    q, node, done = q[ahead], node[ahead], done[ahead]
                    seen = None if seen is None else seen[ahead]
                fresh = mask[node] if seen is None else mask[node] & ~seen
                done = done + np.bitwise_count((self.prints[q] ^ pattern[node]) & fresh).sum(axis=1)
                near = done <= radius
                if level:
                    self.pruned += len(near) - int(near.sum())
                q, node, done = q[near], node[near], done[near]
                if level:
                    wide = child[node + 1] - child[node]
                    seen = np.repeat(mask[node], wide, axis=0)
                    q, done = np.repeat(q, wide), np.repeat(done, wide)
                    node = np.repeat(child[node] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
            found.append((q, node))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def joins(self, radius: int, sizes: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of pairs that connect all rows which pairs below one upper node connect, with at most `radius` differing bits and
        sizes that allow for the similarity: from each row to those that none has reached yet, so that a dense cluster is one pass.

        Each upper node's first rows that are left go down its tree together. The first of them that reaches others begins a
        cluster, which is followed to its end; those before it are alone, and those after it wait."""
        n = len(self.prints)
        begin = self.levels[0][4]
        end = np.append(begin[1:], n)
        left, many = np.ones(n, bool), np.ones(len(begin), np.int64)

        def reached(query: np.ndarray, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
            q, t = self._reached(query, radius, left, later)
            fits = np.minimum(sizes[q], sizes[t]) >= similarity * np.maximum(sizes[q], sizes[t]) - 1e-9
            return q[fits], t[fits]

        def others() -> np.ndarray:
            count = np.concatenate([[0], np.cumsum(left)])
            return count[end] - count[begin]

        while len(open_ := np.flatnonzero((some := others()) > 1)):
            rows = np.flatnonzero(left)
            first = (np.cumsum(some) - some)[open_]
            some = np.minimum(many[open_], some[open_])
            asked = rows[np.repeat(first - np.cumsum(some) + some, some) + np.arange(some.sum())]
            q, t = reached(asked, later=True)
            seed = np.full(len(begin), n)
            np.minimum.at(seed, self.upper[q], q)
            left[asked[asked <= seed[self.upper[asked]]]] = False
            many[open_] = np.where(seed[open_] < n, 1, np.minimum(2 * many[open_], AHEAD))
            mine = q == seed[self.upper[q]]
            yield q[mine], t[mine]
            ahead = t[mine]
            left[ahead] = False
            while len(ahead):
                work = np.cumsum(others()[self.upper[ahead]])
                cut = max(1, int(np.searchsorted(work, WORK, side="right")))
                q, t = reached(ahead[:cut])
                t, at = np.unique(t, return_index=True)
                yield q[at], t
                left[t] = False
                ahead = np.concatenate([ahead[cut:], t])


class Forest:
    """Union of nodes by name; a tree's root is its smallest node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def stars(self) -> pa.RecordBatch:
        """Each node that isn't its own root, with its root."""
        found = [(x, self.root(x)) for x in list(self.up)]
        found = [x for x in found if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _join(groups: np.ndarray, names: np.ndarray, prints: np.ndarray, sizes: np.ndarray, radius: int, similarity: float, forest: Forest) -> None:
    """Join what is linked among rows sorted by upper node and Gray rank; sizes count only for a wide radius."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1])
    trees = GrayTrees(prints, starts)
    # Within a wide radius a cluster has far more pairs than it needs.
    for i, j in trees.pairs(radius) if radius * 8 < prints.shape[1] * 64 else trees.joins(radius, sizes, similarity):
        for a, b in zip(names[i].tolist(), names[j].tolist(), strict=True):
            forest.joins(a, b)


def index_links(dealt: DataFrame, radius: int, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) that connect all rows of `dealt` (node: long, prints: array<long>, size: long, bucket: long) which share a bucket
    and differ in at most `radius` bits, and whose sizes allow for the similarity: for each task, what it linked and the smallest node of it, so that their number is linear."""
    sorted_rows = dealt.select("bucket", "node", "prints", "size").repartition("bucket").withColumn("rank", _rank_column(F.col("prints")[0])).sortWithinPartitions("bucket", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, size = Forest(), [], 0
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(2).flatten().to_numpy().view(np.uint64)
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat.reshape(batch.num_rows, -1), batch.column(3).to_numpy()))
                size += batch.num_rows
            if size >= CHUNK:
                part = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(part[0], part[0][-1]))  # the last bucket may go on
                held, size = [tuple(x[whole:] for x in part)], size - whole
                if whole:
                    _join(*(x[:whole] for x in part), radius, similarity, forest)
            if len(forest.up) > HELD:
                yield forest.stars()
                forest = Forest()
        if size:
            _join(*(np.concatenate(x) for x in zip(*held, strict=True)), radius, similarity, forest)
        yield forest.stars()

    return sorted_rows.select("bucket", "node", "prints", "size").mapInArrow(run, "a long, b long")


def linked_fingerprints(prints: DataFrame, folder: str, radius: int = 2) -> DataFrame:
    """(node, root) of every fingerprint in `prints` (column `node`, distinct longs) that another one is linked to, directly or not.

    The 64 bits are divided into radius + 1 blocks. Two fingerprints with at most `radius` differing bits agree in one of them,
    so each fingerprint goes under one upper node for every block, and no link is lost. An upper node with over MANY members
    is divided in the same way by the bits outside its mask.
    """
    masks = _blocks(range(64), radius + 1)
    upper = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("node").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(masks)])).alias("upper")
    dealt = prints.select("node", upper).select("node", "upper", F.xxhash64("upper.mask", "upper.pattern").alias("bucket"))
    large = dealt.groupBy("bucket").count().where(F.col("count") > MANY).select("bucket", F.lit(True).alias("large"))
    inner = []
    for i, m in enumerate(masks):
        left = [b for b in range(64) if not (m >> b) & 1]
        inner.append(F.array(*[F.xxhash64("bucket", F.lit(i), F.lit(j), F.col("node").bitwiseAND(F.lit(x))) for j, x in enumerate(_blocks(left, radius + 1))]))
    parts = F.element_at(F.array(*inner), F.col("upper.mask") + 1)
    dealt = dealt.join(large, "bucket", "left").select("node", F.explode(F.when(F.col("large"), parts).otherwise(F.array("bucket"))).alias("bucket"), F.array("node").alias("prints"), F.lit(0).cast("long").alias("size"))
    return connected_components(index_links(dealt, radius), f"{folder}/components")


def _blocks(bits, n: int) -> list[int]:
    """The bits in n masks, as signed longs."""
    bits = list(bits)
    masks = [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """For every row: `id`, `print` (its fingerprint as a long) and `component_id`, the smallest identifier reachable over links.

    Null texts count as empty, and all texts without words share fingerprint zero, linked like any other. Repeated rows give
    repeated results; a null identifier is never the smallest unless a component has no other. No rows, no result.
    """
    folder = work_dir(docs.sparkSession, "simhash")
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = written(fingerprints(named, "text", words, ["id"]).select("row.id", F.col("out").alias("print")), f"{folder}/prints")
    distinct = written(rows.groupBy("print").agg(F.min("id").alias("least")), f"{folder}/distinct")
    roots = linked_fingerprints(distinct.select(F.col("print").alias("node")), folder, radius)
    placed = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    placed = written(placed, f"{folder}/placed")
    components = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")
    return rows.join(components, "print").select("id", "print", "component_id")


# Near duplicates by verified similarity, over a wider fingerprint.


def bit_apart(similarity: float) -> float:
    """The largest probability that a bit of the fingerprints of two sets of this Jaccard similarity differs.

    Weighted shingles of two large sets stand at an angle with cosine 2J / (1 + J), and a bit differs with probability angle / pi.
    Small sets, whose bits tie or turn at one shingle, are counted out: all unions of up to 40 shingles.
    """
    sums = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for union in range(1, 41):
        both = math.ceil(similarity * union - 1e-9)
        for only in range((union - both) // 2 + 1):
            other = union - both - only
            set_a = 2 * (np.arange(both + 1)[:, None] + np.arange(only + 1)) > both + only
            set_b = 2 * (np.arange(both + 1)[:, None] + np.arange(other + 1)) > both + other
            one, two = set_a @ sums(only), set_b @ sums(other)
            most = max(most, float(sums(both) @ (one * (1 - two) + two * (1 - one))))
    return most


def radius_of(similarity: float, bits: int, recall: float) -> int:
    """The least number of bits within which two sets of this similarity stay with this probability; bits differ independently."""
    p, within = bit_apart(similarity), 0.0
    for d in range(bits):
        within += math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
        if within >= recall:
            return d
    return bits


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set's distinct shingles, rare ones ahead, then by hash. Two sets of at least this similarity share at least
    ceil(similarity * size) shingles of either, so that the first one they share is in both prefixes: no pair is lost."""
    if not len(hashes):
        return hashes
    known, often = common
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    rank = np.where(known[at] == hashes, often[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def common_shingles(texts: DataFrame, words: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in many texts, and in how many of about ORDER_TEXTS of them: at most a few MB.

    They only order shingles; any other order gives the same links, but larger nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.uint64)]
        for batch in batches:
            found += [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(0)]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n, pa.int64())], ["h", "n"])

    cells = 1 << 30
    some = texts.where(F.pmod(F.xxhash64("at"), F.lit(cells)) < math.ceil(min(1.0, ORDER_TEXTS / max(1, rows)) * cells)).select("text")
    found = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


_WIDE = "struct<prints:array<long>,size:long,sum:long,prefix:array<long>>"


def _wide_column(words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    def column(texts: pa.Array) -> pa.Array:
        prints, sizes, sums, prefixes = [], [], [], [np.zeros(0, np.uint64)]
        for t in texts:
            h = np.unique(shingle_hashes(t.as_py(), words))
            prints.append([x - (1 << 64) if x >> 63 else x for x in (majority(h), *(majority(remixed(h, t)) for t in TURNS))])
            sizes.append(len(h))
            sums.append(remixed(h, 1).sum(dtype=np.uint64))
            prefixes.append(prefix(h, common, similarity))
        ends = pa.array(np.cumsum([len(x) for x in prefixes]), pa.int32())
        first = pa.ListArray.from_arrays(ends, _signed(np.concatenate(prefixes)))
        return pa.StructArray.from_arrays([pa.array(prints, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), _signed(sums), first], ["prints", "size", "sum", "prefix"])

    return column


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.999999, folder: str | None = None) -> DataFrame:
    """For every row: `row` (all its columns), `id`, `keep_id` and `kept`. Rows belong to one group when links of Jaccard similarity
    `similarity` or more between their sets of `words`-word shingles connect them; the smallest identifier of a group stays
    (null last; of rows that tie, exactly one).

    An exact prefix filter deals texts to the index's upper nodes, one for each shingle of a prefix, so that linked texts always
    share one. 256-bit fingerprints in them propose groups at a radius that such links keep within; then every group's shingle
    sets are compared exactly. `recall` is the least probability that a link at the very threshold is proposed, whatever the number
    of rows; closer texts are proposed more surely, and equal shingle sets always. Texts without words, null among them, are equal.
    `folder` is a work folder on shared storage, which the result reads from.
    """
    named, decided = _decided(docs, id_col, text_col, words, similarity, recall, folder or work_dir(docs.sparkSession, "near-duplicates"))
    return named.join(decided, "at").select("row", "id", "keep_id", "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, recall: float = 0.999999, folder: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Only the numbers of the others are joined, so that texts don't move
    as long as those are at most FEW."""
    folder = folder or work_dir(docs.sparkSession, "near-duplicates")
    named, decided = _decided(docs, id_col, text_col, words, similarity, recall, folder)
    gone = written(decided.where("not kept").select("at"), f"{folder}/gone")
    for part in ("sets", "repeated", "compared", "placed"):
        remove(docs.sparkSession, f"{folder}/{part}")
    return named.join(few(gone), "at", "left_anti").select("row.*")


def _decided(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows (row, id, at) and what becomes of each (at, keep_id, kept)."""
    spark = docs.sparkSession
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.monotonically_increasing_id().alias("at"))
    named = written(named, f"{folder}/rows")
    texts = named.select("id", "at", F.col(f"row.{text_col}").cast("string").alias("text"))
    wide = T._parse_datatype_string(_WIDE)
    common = spark.sparkContext.broadcast(common_shingles(texts, words, named.count()))
    rows = written(map_texts(texts, "text", lambda: _wide_column(words, similarity, common.value), wide, ["id", "at"]).select("row.*", "out.*"), f"{folder}/prints")
    collected(spark)
    same = ["prints", "size", "sum"]
    sets = rows.groupBy(*same).agg(F.min("at").alias("node"))
    placed = written(rows.select("at", "id", *same).join(sets, same).select("at", "id", "node", "prints", "size"), f"{folder}/sets")
    sets = placed.where("at = node").select("node", "prints", "size")
    repeated = written(placed.where("at <> node").select("at"), f"{folder}/repeated")

    texts_in, every, shingles = (x or 0 for x in rows.agg(F.count(F.lit(1)), F.sum("size"), F.sum(F.size("prefix"))).first())
    shared = _shared(rows.select(F.col("at").alias("node"), "prefix"), folder, shingles, repeated)
    remove(spark, f"{folder}/prints")  # two fifths of the input, and what follows reads none of it
    radius = radius_of(similarity, 64 * (1 + len(TURNS)), recall)
    turns: list[DataFrame] = []
    rounds = lambda size, most, of: math.ceil(size / max(most[0], most[1] * of))

    def near_prints(dealt: DataFrame) -> DataFrame:
        turns.append(dealt)
        links = lambda some: index_links(some.withColumnRenamed("group", "bucket").join(sets, "node"), radius, similarity)
        return _in_rounds(dealt, links, rounds(dealt.count(), ROUND, texts_in), f"{folder}/near-prints/{len(turns)}")

    proposed = _connected(shared.withColumn("size", F.lit(1)), near_prints, MANY, f"{folder}/proposed")
    remove(spark, f"{folder}/shared")
    remove(spark, f"{folder}/near-prints")
    collected(spark)

    def near_texts(dealt: DataFrame) -> DataFrame:
        dealt = written(dealt, f"{folder}/asked-{len(asked)}")
        asked.append(dealt)
        size = few(dealt).join(sets, "node").agg(F.sum("size")).first()[0] or 0
        whole = texts.select(F.col("at").alias("node"), "text")

        def links(some: DataFrame) -> DataFrame:
            some = few(some).where("node >= 0")  # which holds for all; Spark makes Bloom filters of conditions
            return _verified(some.join(whole, "node"), words, similarity)

        return _in_rounds(dealt, links, rounds(size, ROUND_TEXTS, every), f"{folder}/near-texts/{len(asked)}")

    asked: list[DataFrame] = []
    members = proposed.join(sets.select("node", "size"), "node").select(F.col("root").alias("group"), "node", "size")
    with settings(spark, FILTERED):
        groups = _connected(members, near_texts, BLOCK, f"{folder}/compared")
    for i in range(len(asked)):
        remove(spark, f"{folder}/asked-{i}")
    remove(spark, f"{folder}/near-texts")
    remove(spark, f"{folder}/proposed")
    collected(spark)

    placed = placed.join(groups, "node", "left").select("at", "id", F.coalesce("root", "node").alias("root"))
    placed = written(placed, f"{folder}/placed")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("best"))
    return named, placed.join(best, "root").select("at", F.col("best.id").alias("keep_id"), (F.col("at") == F.col("best.at")).alias("kept"))


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, first the lowest of each: the upper ones of sorted or near numbers are runs, which Spark compresses well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _shared(sets: DataFrame, folder: str, shingles: int = 1, repeated: DataFrame | None = None) -> DataFrame:
    """(group, node) for the shingles of prefixes (node, prefix), about `shingles` in all, that several nodes share, but for the nodes
    in `repeated` (at).

    Most shingles are in one prefix only, so numbers alone are dealt first, packed, and fingerprints later to what is shared. What
    a task finds shared among its own rows isn't dealt but for one row, so that a shingle of very many rows is a row for each task;
    the others go to any task, which passes them on.
    """
    parts = max(1, -(-shingles // DEALT))
    gone = np.zeros(0, np.int64)
    if repeated is not None and repeated.count() > REPEATED:
        sets = sets.join(repeated.withColumnRenamed("at", "node"), "node", "left_anti")
    elif repeated is not None:
        gone = np.sort(repeated.toArrow().column("at").to_numpy())
    skipped = sets.sparkSession.sparkContext.broadcast(np.append(gone, np.iinfo(np.int64).max))  # no place is so large

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, TaskContext.get().partitionId()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            group, node = (np.concatenate(x) for x in zip(*held, strict=True))
            group = group.view(np.uint64)
            order = np.argsort(group, kind="stable")
            group, node = group[order], node[order]
            more = np.concatenate([group[1:] == group[:-1], [False]])  # the next row has the same shingle
            rest = np.concatenate([[False], more[:-1]])
            rows = []
            dealt, of, first = group[~rest], node[~rest], more[~rest]
            cut = np.append(np.searchsorted(dealt, np.array([(p << 64) // parts for p in range(parts)], np.uint64)), len(dealt))
            for p, a, b in zip(range(parts), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if a < b:
                    rows.append((p, _planes(dealt[a:b]), _planes(of[a:b]), first[a:b].tobytes()))
            passed, of = group[rest], node[rest]
            for a in range(0, len(passed), 1 << 14):
                rows.append((turn % parts, _planes(passed[a : a + (1 << 14)]), _planes(of[a : a + (1 << 14)]), None))
                turn += 1
            for a in range(0, len(rows), 64):
                cols = list(zip(*rows[a : a + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "groups", "nodes", "more"])

        for batch in batches:
            node = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(skipped.value[np.searchsorted(skipped.value, node)] != node))
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            held.append((lists.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), n)))
            size += int(n.sum())
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()
        trimmed()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out(group: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(group), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(group[i : i + (1 << 14)]), pa.array(node[i : i + (1 << 14)])], ["group", "node"])

        for batch in batches:
            for groups, nodes, more in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                if more.is_valid:
                    held.append((_from_planes(groups), _from_planes(nodes), np.frombuffer(more.as_buffer(), bool)))
                else:
                    yield from out(_from_planes(groups), _from_planes(nodes))
        if held:
            group, node, several = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(group, kind="stable")
            group, node, several = group[order], node[order], several[order]
            same = group[1:] == group[:-1]
            several[1:] |= same
            several[:-1] |= same
            yield from out(group[several], node[several])
        trimmed()

    dealt = sets.select("node", "prefix").mapInArrow(deal, "part int, groups binary, nodes binary, more binary").repartitionById(parts, "part")
    return written(dealt.mapInArrow(match, "group long, node long"), f"{folder}/shared")


def _connected(members: DataFrame, links: Callable[[DataFrame], DataFrame], limit: int, folder: str) -> DataFrame:
    """(node, root) of the nodes that links within the groups of `members` (group, node, size) connect. `links` finds them (a, b)
    within every group of rows (group, node), which it is given in blocks of about `limit` in size.

    A group's members are searched within their blocks, each of which also gets the group's first member. What that connects
    to the first member needs no more comparisons among itself; the rest of the group, mostly little, is compared with all of
    it, block by block. So a large group of close texts costs a pass over them, and no pair is left out that could join two parts.
    """
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    spark, hash_of = members.sparkSession, F.xxhash64
    sizes = members.groupBy("group").agg(F.ceil((F.sum("size") + 1) / limit).alias("blocks"), F.min("node").alias("first"))
    sizes = written(sizes.where("blocks > 1"), f"{folder}/sizes")
    if sizes.isEmpty():
        return connected_components(links(members.select("group", "node")), f"{folder}/near")
    block = F.pmod(F.hash("node"), F.col("blocks"))
    placed = members.join(sizes, "group", "left")
    whole = F.when(F.col("blocks").isNull(), F.array("group"))
    dealt = whole.when(F.col("node") == F.col("first"), F.transform(numbers("blocks"), lambda b: hash_of("group", b))).otherwise(F.array(hash_of("group", block)))
    near = connected_components(links(placed.select(F.explode(dealt).alias("group"), "node")), f"{folder}/near")

    large = members.join(sizes, "group").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = sizes.select("group", F.col("first").alias("node")).join(near, "node", "left").select("group", F.coalesce("root", "node").alias("first_root"))
    large = written(large.join(roots, "group").withColumn("joined", F.col("root") == F.col("first_root")), f"{folder}/large")
    shares = written(large.where("not joined").groupBy("group").agg(F.ceil((F.sum("size") + 1) / limit).alias("parts")), f"{folder}/shares")
    if shares.isEmpty():
        return near
    part = F.pmod(F.hash("node", F.lit(1)), F.col("parts"))
    among = F.transform(numbers("parts"), lambda y: hash_of("group", F.lit("rest"), F.least(part, y), F.greatest(part, y)))
    against = F.transform(numbers("blocks"), lambda y: hash_of("group", F.lit("all"), part, y))
    asked = F.transform(numbers("parts"), lambda x: hash_of("group", F.lit("all"), x, block))
    dealt = large.join(shares, "group").select(F.explode(F.when(F.col("joined"), asked).otherwise(F.concat(among, against))).alias("group"), "node")
    every = near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links(dealt))
    every = connected_components(every, f"{folder}/every")
    remove(spark, f"{folder}/large")
    return every


def _in_rounds(dealt: DataFrame, links: Callable[[DataFrame], DataFrame], rounds: int, folder: str) -> DataFrame:
    """What `links` finds in `dealt` (group, node), whose groups are dealt in so many rounds; the links of each are written to `folder`."""
    if rounds <= 1:
        return links(dealt)
    of = F.pmod(F.xxhash64("group", F.lit("round")), F.lit(rounds))
    return reduce(DataFrame.unionByName, [written(links(dealt.where(of == i)), f"{folder}/{i}") for i in range(rounds)])


def _verified(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect the rows of each group (node, text, group) whose shingle sets are similar enough, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []

        def out() -> pa.RecordBatch:
            links = similar_links(sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for group, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if group != now:
                    if len(sets) > 1:
                        yield out()
                    now, sets = group, []
                sets.append((node, np.unique(shingle_hashes(text, words))))
        if len(sets) > 1:
            yield out()

    dealt = texts.select("group", "node", "text").repartition("group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(run, "a long, b long")


def similar_links(sets: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links of at least this Jaccard similarity that connect all sets which any such links connect.

    An inverted index over the shingles counts what a set shares with every other one: the first set, and then each that has not
    been joined to it. Sets without shingles are equal.
    """
    sizes = np.array([len(s) for _, s in sets])
    every, flat = np.unique(np.concatenate([s for _, s in sets]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    held = owner[np.argsort(flat, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(every)))])
    of = np.concatenate([[0], np.cumsum(sizes)])
    forest, links = Forest(), []
    for k in range(len(sets)):
        if k and forest.root(k) == 0:
            continue
        mine = flat[of[k] : of[k + 1]]
        if len(mine):
            n = first[mine + 1] - first[mine]
            places = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(held[places], minlength=len(sets))
            near = np.flatnonzero((both >= similarity * (sizes[k] + sizes - both) - 1e-9) & (both > 0))
        else:
            near = np.flatnonzero(sizes == 0)
        links += [(sets[j][0], sets[k][0]) for j in near.tolist() if forest.joins(j, k)]
    return links
