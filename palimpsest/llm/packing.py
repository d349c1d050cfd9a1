"""Packing by lexical retrieval: windows of training tokens, each filled around a seed document with its nearest neighbours.

Document frequencies and the mean length are counted over all documents. A tree of halving cuts, learned from a sample of their
weighted term vectors in few dimensions, then puts all documents in an order in which lexical neighbours stand together,
wherever they were in the input. Shards of bounded size are runs of documents in that order, and each has a BM25 inverted index:
a seed's neighbours outside its shard are not seen. A seed's unused neighbours fill its window in order of their scores; the one that
doesn't fit is cut, and its rest is the next seed. So all windows are full but a shard's last tokens, which become sequences
whose lengths are powers of two and need no padding either.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, work_dir, written

WINDOW = 2048
#: A shard is full at so many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 20
#: Full shards of tokens in a task.
TASK_SHARDS = 4
#: The token after each document.
END = 1
K1, B = 1.2, 0.75
#: Dimensions of the vectors that the order goes by.
DIMS = 64
#: Documents whose vectors the cuts are learned from: so many at least, and one in so many; at each last cut, so many are left.
CUT_DOCS, CUT_SHARE, CUT_LEAST = 20_000, 128, 16
#: Distinct parts of words whose tokens a worker remembers at a time: about 100 MB.
REMEMBERED = 500_000

# Fixed values of the tokenizer file: how text is divided, here for Latin-1, and which characters stand for bytes.
_LATIN = re.compile("[\t-\r -~\u00a1-\u00ac\u00ae-\u00ff]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\t-\r a-z0-9\u00aa\u00b5\u00ba\u00b2\u00b3\u00b9\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Parts(dict):
    """The tokens of parts of words; those of a new part are asked of the tokenizer's model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        signs = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_SIGNS)
        self[part] = ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        return ids


class Tokens:
    """Token ids of texts. A text in Latin-1 is divided into parts, which are looked up; no token crosses them. In any other text
    the same holds for each stretch between blanks, and stretches beyond Latin-1 go through the whole tokenizer."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.parts = _Parts(self.tokenizer.model)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self._ids(text or "") + END.to_bytes(4, "little"), "<u4")

    def _ids(self, text: str) -> bytes:
        if _LATIN.fullmatch(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        if " " in text:
            return b"".join(map(self._ids, text.split(" ")))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=1)
def remembering(model: str) -> Tokens:
    """The worker's tokens of a tokenizer file; a worker keeps its memory from task to task."""
    return Tokens(model)


Counts = tuple[np.ndarray, np.ndarray]  # distinct terms and how often each occurs


class Corpus:
    """What BM25 needs to know of all documents: how many there are, their tokens, and in how many of them each term occurs."""

    def __init__(self, docs: int, tokens: float, df: np.ndarray) -> None:
        self.docs, self.tokens, self.mean = docs, tokens, tokens / max(1, docs)
        self.idf = np.maximum(0.0, np.log((docs - df + 0.5) / (df + 0.5)))

    def weights(self, terms: np.ndarray, often: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[terms] * often * (K1 + 1) / (often + K1 * (1 - B + B * lengths / self.mean))

    def vectors(self, found: list[Counts]) -> np.ndarray:
        """The weights of each document's terms, of length 1, by random signs in DIMS dimensions."""
        signs = _signs(len(self.idf))
        out = np.zeros((len(found), DIMS), np.float32)
        if found:
            length = np.repeat([often.sum() for _, often in found], [len(t) for t, _ in found])
            weight = self.weights(np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]), length).astype(np.float32)
            at = 0
            for i, (terms, _) in enumerate(found):
                out[i] = weight[at : at + len(terms)] @ signs[terms]
                at += len(terms)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@lru_cache(maxsize=1)
def _signs(terms: int) -> np.ndarray:
    return np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (terms, DIMS))


class Cuts:
    """A complete tree of cuts: each halves the sample below it across the direction in which it differs most."""

    def __init__(self, sample: np.ndarray) -> None:
        self.depth = max(0, int(np.log2(max(1, len(sample)) / CUT_LEAST)))
        self.across = np.zeros(((1 << self.depth) - 1, DIMS), np.float32)
        self.at = np.full(len(self.across), np.inf, np.float32)
        node = np.zeros(len(sample), np.int64)
        for level in range(self.depth):
            order = np.argsort(node, kind="stable")
            ends = np.searchsorted(node[order], np.arange((1 << level) - 1, (2 << level)))
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if b - a > 1:
                    part = sample[order[a:b]]
                    self.across[(1 << level) - 1 + k] = across = np.linalg.eigh(np.cov(part.T))[1][:, -1]
                    self.at[(1 << level) - 1 + k] = np.median(part @ across)
            node = self._down(node, sample)

    def _down(self, node: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return 2 * node + 1 + ((vectors * self.across[node]).sum(axis=1) > self.at[node])

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, counted from the left."""
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            node = self._down(node, vectors)
        return node - ((1 << self.depth) - 1)


class Index:
    """A BM25 inverted index over the documents of a shard, with the weights of `corpus`, or of the shard alone if there is none.
    A term in over half of the documents weighs nothing, as its idf isn't positive."""

    def __init__(self, found: list[Counts], corpus: Corpus | None = None) -> None:
        n = len(found)
        terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        often = np.concatenate([c for _, c in found])
        owner = np.repeat(np.arange(n), [len(t) for t, _ in found])
        lengths = np.bincount(owner, weights=often, minlength=n)
        corpus = corpus or Corpus(n, lengths.sum(), np.bincount(terms))
        weight = corpus.weights(terms, often, lengths[owner])
        some = weight > 0
        terms, owner, weight = terms[some], owner[some], weight[some]
        self.of = np.searchsorted(owner, np.arange(n + 1))
        self.terms = terms
        order = np.argsort(terms, kind="stable")
        self.holder, self.weight = owner[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(corpus.idf)))])
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document for the terms of this one."""
        mine = self.terms[self.of[doc] : self.of[doc + 1]]
        if not len(mine):
            return np.zeros(self.n)
        count = self.first[mine + 1] - self.first[mine]
        at = np.repeat(self.first[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.holder[at], weights=self.weight[at], minlength=self.n)


Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def counts_of(ids: np.ndarray) -> Counts:
    return np.unique(ids, return_counts=True)


def pack(found: list[Counts], window: int = WINDOW, corpus: Corpus | None = None) -> list[Piece]:
    """Pieces of all documents of a shard; each token lies in one piece, each sequence is full or a power of two long."""
    pieces: list[Piece] = []
    sequence = 0
    lengths = np.array([often.sum() for _, often in found], np.int64)
    start = np.zeros(len(found), np.int64)
    for d in np.flatnonzero(lengths >= window).tolist():  # what fills windows alone
        for _ in range(lengths[d] // window):
            pieces.append((d, int(start[d]), window, sequence, 0))
            start[d] += window
            sequence += 1
    left = lengths - start
    index, open_, room = Index(found, corpus), [], window
    seed = None
    while (left > 0).any():
        if seed is None or not left[seed]:
            seed = int(np.argmax(left > 0))
        rank = np.where(left > 0, index.scores(seed), -1.0)
        rank[seed] = np.inf
        while room and (best := int(np.argmax(rank))) >= 0 and rank[best] >= 0:
            take = int(min(left[best], room))
            open_.append((best, int(start[best]), take))
            start[best] += take
            left[best] -= take
            room -= take
            rank[best] = -1.0
            seed = best
        if not room:
            pieces += _placed(open_, sequence)
            sequence, open_, room = sequence + 1, [], window
    return pieces + _powers(open_, sequence)


def _placed(parts: list[tuple[int, int, int]], sequence: int) -> list[Piece]:
    out, at = [], 0
    for d, start, length in parts:
        out.append((d, start, length, sequence, at))
        at += length
    return out


def _powers(parts: list[tuple[int, int, int]], sequence: int) -> list[Piece]:
    """The last tokens of a shard as sequences of falling powers of two."""
    out, parts = [], parts[::-1]
    total = sum(p[2] for p in parts)
    while total:
        size = room = 1 << (total.bit_length() - 1)
        mine = []
        while room:
            d, start, length = parts.pop()
            take = min(length, room)
            mine.append((d, start, take))
            room -= take
            if take < length:
                parts.append((d, start + take, length - take))
        out += _placed(mine, sequence)
        sequence += 1
        total -= size
    return out


_OUT = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _wide(terms: int) -> str:
    """The type in which token numbers are kept between the steps."""
    return "<u2" if terms <= 1 << 16 else "<u4"


def _views(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The arrays that a column of binaries holds, without a copy."""
    if not len(column):
        return []
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [every[a:b].view(kind) if a % size == 0 else np.frombuffer(every[a:b].tobytes(), kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _counts(terms: pa.Array, often: pa.Array, kind: str) -> list[Counts]:
    return list(zip(_views(terms, kind), _views(often, "<u4"), strict=True))


def _terms(tokenizer: str) -> int:
    """One more than the largest token number."""
    from tokenizers import Tokenizer

    return max([END, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()]) + 1


def corpus_of(rows: DataFrame, terms: int) -> Corpus:
    """The counts of all documents: what each task noted of its own (`df`, where it isn't null), added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            total += sum(_views(batch.column(0), "<i8"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    found = rows.where("df is not null").select("df").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms + 2, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return Corpus(int(df[-2]), int(df[-1]), df[:-2])


def _sampled(rows: DataFrame, corpus, kind: str, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and lengths of a sample of the documents, in an order that follows from them alone."""
    cells = 1 << 30
    share = max(CUT_DOCS, docs // CUT_SHARE) / max(1, docs)
    some = rows.where(F.pmod(F.xxhash64("at"), F.lit(cells)) < int(min(1.0, share) * cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _counts(batch.column(0), batch.column(1), kind)
            lengths = [int(often.sum()) for _, often in found]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in corpus.value.vectors(found)], pa.binary()), pa.array(lengths, pa.int64())], ["vector", "length"])

    found = some.select("terms", "often").mapInArrow(run, "vector binary, length long").toArrow().sort_by([("vector", "ascending"), ("length", "ascending")])
    return np.frombuffer(b"".join(found.column("vector").to_pylist()), np.float32).reshape(-1, DIMS), found.column("length").to_numpy()


def _tasks(leaf: np.ndarray, lengths: np.ndarray, leaves: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first task and its number of tasks, from the leaves' shares of a sample's tokens: neighbouring leaves
    share a task, and a leaf that holds much, such as one of a large group of copies, has several."""
    load = np.bincount(leaf, weights=lengths, minlength=leaves) + 1e-9
    load *= tasks / load.sum()
    before = np.cumsum(load) - load
    first = np.minimum(before.astype(np.int64), tasks - 1)
    return first, np.maximum(1, np.minimum(np.round(load).astype(np.int64), tasks - first))


def packed(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """For every piece: `row` (the document's columns in `keep`, all by default), start (its document's tokens before it), length,
    doc_tokens (with the end token), sequence_id, offset in the sequence, and `ids`, its tokens as little-endian 32-bit numbers.

    `tokenizer` is the path of a tokenizer file, read on the driver. Null counts as empty: such a document is its end token.
    Repeated rows are packed once each; rows are told apart by their place, so identifiers may be null or repeated. Documents are
    sorted by their leaf, then by their place; a sample's tokens say how many tasks a leaf needs, so that no group of copies makes a
    task much larger. The result reads from a work folder on shared storage. No rows, no pieces.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file, 2 MB
    terms = _terms(tokenizer)
    kind = _wide(terms)
    keep = docs.columns if keep is None else keep
    row = F.struct(*[docs[c] for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("none")).alias("row")
    sent = docs.select(row, F.monotonically_increasing_id().alias("at"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([sent.schema["row"], *T._parse_datatype_string(_OUT).fields])
    inner = T.StructType([T.StructField("row", sent.schema["row"].dataType), *T._parse_datatype_string("at long, ids binary, terms binary, often binary, df binary").fields])
    binary = pa.binary()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df, of_row = remembering(model.value), np.zeros(terms + 2, "<i8"), None
        for batch in batches:
            of_row = batch.column(0).type
            ids = [tokens(t.as_py()) for t in batch.column(2)]
            found = [counts_of(x) for x in ids]
            if ids:
                df[:-2] += np.bincount(np.concatenate([t for t, _ in found]), minlength=terms)
                df[-2:] += len(ids), sum(map(len, ids))
            binaries = [[x.astype(kind).tobytes() for x in ids], [t.astype(kind).tobytes() for t, _ in found], [c.astype("<u4").tobytes() for _, c in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, binary) for x in binaries], pa.nulls(len(ids), binary)], inner.names)
        if of_row is not None:  # the task's counts, in a row of their own
            none = pa.nulls(1, binary)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, of_row), pa.nulls(1, pa.int64()), none, none, none, pa.array([df.tobytes()], binary)], inner.names)

    folder = work_dir(spark, "packing")
    rows = written(sent.mapInArrow(read, inner), f"{folder}/ids")
    counts = corpus_of(rows, terms)
    corpus = spark.sparkContext.broadcast(counts)  # a number for each term
    rows = rows.where("at is not null")
    vectors, lengths = _sampled(rows, corpus, kind, counts.docs)
    cut = Cuts(vectors)
    cuts = spark.sparkContext.broadcast(cut)
    tasks = max(1, -(-int(counts.tokens) // (TASK_SHARDS * SHARD_TOKENS)))
    first, parts = _tasks(cut.place(vectors), lengths, 1 << cut.depth, tasks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = cuts.value.place(corpus.value.vectors(_counts(batch.column(3), batch.column(4), kind)))
            mixed = (batch.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            task = first[leaf] + (mixed % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64()), pa.array(task, pa.int32())], [*placed.names, "leaf", "task"])

    placed = T.StructType(inner.fields[:-1])
    dealt = rows.select(*placed.names).mapInArrow(place, T.StructType([*placed.fields, *T._parse_datatype_string("leaf long, task int").fields]))
    dealt = dealt.repartitionById(tasks, "task").sortWithinPartitions("leaf", "at").select("row", "ids", "terms", "often")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = TaskContext.get().partitionId() << 33
        rows: list[pa.Array] = []
        shard: list[np.ndarray] = []
        found: list[Counts] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows, shard, found, size, sequences
            pieces = pack(found, window, corpus.value)
            kept = pa.concat_arrays(rows)
            for at in range(0, len(pieces), 1024):
                part = pieces[at : at + 1024]
                cols = [kept.take(pa.array([p[0] for p in part], pa.int64()))]
                cols += [pa.array(x, pa.int64()) for x in ([p[1] for p in part], [p[2] for p in part], [len(shard[p[0]]) for p in part], [sequences + p[3] for p in part], [p[4] for p in part])]
                cols.append(pa.array([shard[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in part], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, schema.names)
            sequences += 1 + max((p[3] for p in pieces), default=0)
            rows, shard, found, size = [], [], [], 0

        for batch in batches:
            begun = 0
            counted = _counts(batch.column(2), batch.column(3), kind)
            for i, ids in enumerate(_views(batch.column(1), kind)):
                shard.append(ids)
                found.append(counted[i])
                size += len(ids)
                if len(shard) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    rows.append(batch.column(0).slice(begun, i + 1 - begun))
                    begun = i + 1
                    yield from out()
            if begun < batch.num_rows:
                rows.append(batch.column(0).slice(begun))
        if shard:
            yield from out()

    return dealt.mapInArrow(run, schema)
