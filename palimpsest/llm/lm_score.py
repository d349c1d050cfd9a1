"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from WINDOW tokens on either side. Words are counted exactly over the whole corpus; the most frequent
have classes of their own, the others share classes by frequency. The network, position-wise embeddings under one hidden layer and
a softmax in two steps, learns in numpy: in each round every task trains on its share of the documents in minibatches, and the
tasks' weights are averaged. A document's score is the sum of its tokens' conditional log-probabilities.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, map_texts, run_hashes, steps, utf8, word_runs

#: Words whose counts every executor gets: the most frequent ones, 4 MB. All other words share what is left of the corpus equally.
VOCABULARY = 1 << 18
#: Classes that are one word each, classes that other words share, and classes in one group of the softmax.
OWN, SHARED, GROUP = 960, 64, 32
CLASSES = OWN + SHARED
#: Tokens on either side, and units of the hidden layer.
WINDOW, HIDDEN = 3, 24
#: Rounds of training, of an equal share of the documents each, but so many documents at least (a small corpus is read again): all
#: are learned from.
ROUNDS, LEAST = 4, 2_000
BATCH, RATE = 4096, 0.1
#: Tasks that add up what the others learned, and tokens that a task counts together.
SUMS, TOGETHER = 16, 1 << 21


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all rows, and each row's first word (one more than rows)."""
    data = LOWER[data]
    starts, ends, first = word_runs(data, offsets)
    return run_hashes(data, starts, ends), first


def _tokens_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = utf8(texts)
    for a, b in steps(offsets):
        yield tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the classes (from 1) of the tokens around it in its row, 0 beyond the row's edges."""
    out = np.zeros((2 * WINDOW, len(classes)), np.int16)
    if not len(classes):
        return out
    edges = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(classes))]
    for d in range(1, WINDOW + 1):
        left, right = out[WINDOW - d], out[WINDOW + d - 1]
        left[d:], right[:-d] = classes[:-d] + 1, classes[d:] + 1
        for k in range(d):  # the places whose neighbour at this distance is in another row
            left[np.minimum(edges + k, len(classes) - 1)] = np.where(edges + k < len(classes), 0, left[-1])
            right[np.maximum(edges - 1 - k, 0)] = np.where(edges - 1 - k >= 0, 0, right[0])
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word, by its hash, occurs in all documents. As many rows as the corpus has words."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(word), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(word[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["word", "n"])

        for batch in batches:
            for found, _ in _tokens_of(batch.column(0)):
                held.append(found)
                size += len(found)
                if size >= TOGETHER:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return docs.select(docs[text_col].cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _table(words: np.ndarray, bits: int) -> np.ndarray:
    """Places of words by the first bits of their hashes; a word whose cell is taken goes to the next free one."""
    table = np.full(1 << bits, -1, np.int32)
    left, cell = np.arange(len(words)), (words >> np.uint64(64 - bits)).astype(np.int64)
    while len(left):
        free = table[cell] < 0
        table[cell[free]] = left[free]
        on = table[cell] != left
        left, cell = left[on], (cell[on] + 1) & ((1 << bits) - 1)
    return table


class Vocabulary:
    """The class of each word and its log-probability within the class. `words` are sorted; any other word is one of `others`
    words that occur `rest` times together, in a class of their own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, others: int, rest: int) -> None:
        self.words = words
        self.bits = max(8, int(np.ceil(np.log2(4 * len(words) + 1))))
        self.table = _table(words, self.bits)
        order = np.argsort(-counts, kind="stable")
        classes = np.zeros(len(words), np.int16)
        classes[order[:OWN]] = np.arange(len(order[:OWN]))
        heap = [(0, c) for c in range(OWN, CLASSES - 1)]
        for w, n in zip(order[OWN:].tolist(), counts[order[OWN:]].tolist(), strict=True):
            load, c = heapq.heappop(heap)
            classes[w] = c
            heapq.heappush(heap, (load + n, c))
        total = np.bincount(classes, weights=counts, minlength=CLASSES)
        self.classes = np.append(classes, np.int16(CLASSES - 1))
        self.within = np.append(np.log(counts / np.maximum(total[classes], 1)), -np.log(max(1, others) + 1.0))
        total[-1] = rest
        self.share = (total + 1.0) / (total.sum() + CLASSES)

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of words, and their log-probabilities within them."""
        none = len(self.words)
        at = np.full(len(found), none, np.int32)
        left, cell = np.arange(len(found)), (found >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            held = self.table[cell]
            hit = (held >= 0) & (self.words[held] == found[left]) if none else held >= 0
            at[left[hit]] = held[hit]
            on = ~hit & (held >= 0)
            left, cell = left[on], (cell[on] + 1) & ((1 << self.bits) - 1)
        return self.classes[at], self.within[at]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words of all counts: those that occur at least as often as lets VOCABULARY of them in."""
    of_size = counts.groupBy(F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 16) + 1024).alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least"))
    least, words, rest, others = 1, 0, 0, 0
    for level in sorted(of_size.collect(), key=lambda r: -r.least):  # at most 2,048 rows
        if rest or words + level.words > VOCABULARY:
            rest, others = rest + level.tokens, others + level.words
        else:
            least, words = level.least, words + level.words
    found = counts.where(F.col("n") >= least).toArrow() if words else counts.limit(0).toArrow()
    word, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(word)
    return Vocabulary(word[order], n[order].astype(float), others, rest)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The softmax of rows, and the logarithm of its value at one place of each."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    one = x[rows, at]
    np.exp(x, out=x)
    total = x.sum(axis=1)
    return x / total[:, None], one - np.log(total)


def _log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at one place of each row. Logits stay far below 80, so that none overflows."""
    one = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return one - np.log(x @ np.ones(x.shape[1], np.float32))


class WindowNetwork:
    """Predicts a class from the classes around it: embeddings by position, one hidden layer, a softmax over groups of classes and
    one within the group. It begins as a unigram model."""

    def __init__(self, share: np.ndarray, seed: int = 11) -> None:
        rng, groups = np.random.default_rng(seed), CLASSES // GROUP
        # Classes are dealt so that groups are about equally frequent.
        by_group = share.reshape(GROUP, groups).T
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.weights = [
            normal(2 * WINDOW, CLASSES + 1, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, groups), np.log(by_group.sum(axis=1)).astype(np.float32),
            normal(groups, HIDDEN, GROUP), np.log(by_group / by_group.sum(axis=1, keepdims=True)).astype(np.float32),
        ]
        self.squares = [np.full(w.shape, 1e-4, np.float32) for w in self.weights]

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        tables, shift = self.weights[:2]
        total = shift + tables[0][around[0]]
        for i in range(1, len(around)):
            total += tables[i][around[i]]
        return np.tanh(total)

    @staticmethod
    def _parts(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(group.astype(np.uint8), kind="stable")
        cut = np.searchsorted(group[order], np.arange(CLASSES // GROUP + 1))
        for g in np.flatnonzero(np.diff(cut)).tolist():
            yield g, order[cut[g] : cut[g + 1]]

    def logs(self, around: np.ndarray, classes: np.ndarray, batch: int = 1 << 14) -> np.ndarray:
        """The log-probability of each class in its context."""
        out = np.zeros(len(classes))
        _, _, outer, bias, inner, inner_bias = self.weights
        groups = CLASSES // GROUP
        for a in range(0, len(classes), batch):
            hidden, group = self._hidden(around[:, a : a + batch]), classes[a : a + batch] % groups
            place = classes[a : a + batch] // groups
            part = _log_softmax(hidden @ outer + bias, group)
            for g, rows in self._parts(group):
                part[rows] += _log_softmax(hidden[rows] @ inner[g] + inner_bias[g], place[rows])
            out[a : a + batch] = part
        return out

    def learn(self, around: np.ndarray, classes: np.ndarray) -> None:
        """One step on a minibatch, by adaptive gradients; only embeddings that occur in it change."""
        tables, shift, outer, bias, inner, inner_bias = self.weights
        groups, n = CLASSES // GROUP, len(classes)
        group, place = classes % groups, classes // groups
        hidden = self._hidden(around)
        back, _ = _softmax(hidden @ outer + bias, group)
        back[np.arange(n), group] -= 1
        slope = back @ outer.T
        inner_steps = []
        for g, rows in self._parts(group):
            own, _ = _softmax(hidden[rows] @ inner[g] + inner_bias[g], place[rows])
            own[np.arange(len(rows)), place[rows]] -= 1
            slope[rows] += own @ inner[g].T
            inner_steps.append((g, hidden[rows].T @ own, own.sum(axis=0)))
        slope *= 1 - hidden**2
        self._step(1, ..., slope.sum(axis=0) / n)
        self._step(2, ..., hidden.T @ back / n)
        self._step(3, ..., back.sum(axis=0) / n)
        for g, weight, offset in inner_steps:
            self._step(4, g, weight / n)
            self._step(5, g, offset / n)
        for i in range(len(around)):
            order = np.argsort(around[i], kind="stable")
            at = np.concatenate([[0], np.flatnonzero(np.diff(around[i][order])) + 1])
            self._step(0, (i, around[i][order[at]]), np.add.reduceat(slope[order], at) / n)

    def _step(self, which: int, at, slope: np.ndarray) -> None:
        self.squares[which][at] += slope * slope
        self.weights[which][at] -= RATE * slope / np.sqrt(self.squares[which][at])

    def packed(self) -> bytes:
        return np.concatenate([x.ravel() for x in (*self.weights, *self.squares)]).tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for kept in (self.weights, self.squares):
            for i, w in enumerate(kept):
                kept[i] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
                at += w.size


class Model:
    """A vocabulary and a network over its classes."""

    def __init__(self, words: Vocabulary, network: WindowNetwork) -> None:
        self.words, self.network = words, network

    def logs(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The conditional log-probability of each token."""
        classes, within = self.words(found)
        return self.network.logs(contexts(classes, first), classes) + within

    def learn(self, found: np.ndarray, first: np.ndarray) -> int:
        """Learn from all tokens of some rows, in an order that mixes them."""
        classes, _ = self.words(found)
        around = contexts(classes, first)
        order = np.random.default_rng(len(found)).permutation(len(found))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            self.network.learn(around[:, part], classes[part])
        return len(found)

    def __call__(self, texts: pa.Array) -> pa.Array:
        n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for found, first in _tokens_of(texts):
            n.append(np.diff(first))
            total.append(np.bincount(np.repeat(np.arange(len(n[-1])), n[-1]), weights=self.logs(found, first), minlength=len(n[-1])))
        n, total = np.concatenate(n), np.concatenate(total)
        mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(total, pa.float64()), mean], ["n_tokens", "pll", "mean_pll"])


def _round(texts: DataFrame, model: Model, turn: int, share: float) -> np.ndarray | None:
    """The mean of what all tasks learn from this round's documents, weighted by their tokens; nothing without tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # 6 MB whatever the corpus
    cells = 1 << 30
    mine = texts.where(F.pmod(F.pmod(F.xxhash64("text"), F.lit(cells)) - int(turn * share * cells), F.lit(cells)) < math.ceil(share * cells))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value.words, WindowNetwork(shared.value.words.share))
        own.network.unpack(np.frombuffer(shared.value.network.packed(), np.float32))
        n = sum(own.learn(found, first) for batch in batches for found, first in _tokens_of(batch.column(0)) if len(found))
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([own.network.packed()], pa.binary())], ["task", "n", "learned"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for weight, learned in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = weight * np.frombuffer(learned.as_buffer(), np.float32).astype(np.float64)
                total, n = part if total is None else total + part, n + weight
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    learned = mine.mapInArrow(learn, "task long, n long, learned binary").repartition(SUMS, "task").sortWithinPartitions("task")
    sums = learned.mapInArrow(add, "n long, total binary").toArrow()  # at most SUMS rows
    if not sums.num_rows:
        return None
    rows = sorted(zip(sums.column("n").to_pylist(), sums.column("total").to_pylist(), strict=True))
    return sum(np.frombuffer(t, np.float64) for _, t in rows) / sum(n for n, _ in rows)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the words of all documents, then train the network on all of them, in ROUNDS shares picked by a hash of the text. Null
    texts have no words; without documents the model knows none."""
    words = vocabulary(word_counts(docs, text_col))
    model = Model(words, WindowNetwork(words.share))
    texts = docs.select(docs[text_col].cast("string").alias("text"))
    share = min(1.0, max(1 / ROUNDS, LEAST / max(1, texts.count())))
    for turn in range(ROUNDS):
        learned = _round(texts, model, turn, share)
        if learned is not None:
            model.network.unpack(learned)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row` (the columns in `keep`, all by default) and `out`: n_tokens, pll (the sum of its tokens' conditional
    log-probabilities) and mean_pll (null without tokens). Null counts as empty, with no tokens and pll 0. Equal texts score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 6 MB whatever the corpus
    out = T._parse_datatype_string("struct<n_tokens:long,pll:double,mean_pll:double>")
    return map_texts(docs, text_col, lambda: shared.value, out, keep)
