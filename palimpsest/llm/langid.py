"""Language identification as mixture inference.

Byte trigrams of labelled texts give each language a distribution. A document is a mixture of languages: expectation-maximisation
estimates its proportions from the likelihoods of its trigrams, and the set of its languages is the one whose likelihood,
less a penalty for each language, is highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_texts

BUCKETS = 1 << 15
#: Labelled documents that the model is fitted on: a sample of this expected size, by a hash of the identifier, for each language.
TRAINING_DOCS = 20_000
#: Languages that the model may have; more raise an error.
LANGUAGES = 200
#: Trigrams overlap, so a text counts as this share of its trigrams when a further language is weighed.
INDEPENDENT = 1 / 3
ROUNDS, STILL = 40, 1e-4
SMOOTH = 0.5

_KEEP = np.arange(256, dtype=np.uint32)
_KEEP[[b for b in range(128) if not chr(b).isalpha()]] = 32


def has_letter(text: str) -> bool:
    """Whether some character is a letter in Unicode's sense: digits, fractions and other number signs are none."""
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text in lower case; all but ASCII letters and bytes beyond ASCII count as blanks."""
    b = _KEEP[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its identifier as text, modulo 5, is 0. A null identifier counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Trigram distributions by language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        rows = [(counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * BUCKETS) for x in self.languages]
        self.chance = np.array(rows, np.float64).reshape(len(rows), BUCKETS)

    def proportions(self, text: str | None) -> tuple[dict[str, float], float]:
        """The languages of a text with their proportions, and by how much their penalised likelihood exceeds that of no language,
        whose trigrams are equally likely. None if the text has no letter or nothing was learned."""
        if text is None or not self.languages or not has_letter(text):
            return {}, 0.0
        seen = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        counts, chance = seen[at].astype(np.float64), self.chance[:, at]
        weights, _ = expectation_maximisation(chance, counts)
        order = np.argsort(-weights, kind="stable")
        fee = 0.5 * np.log(max(2.0, counts.sum() * INDEPENDENT))
        single = np.log(chance) @ counts
        chosen, best = [int(np.argmax(single))], single.max()
        share = np.ones(1)
        for x in order.tolist():
            if x in chosen:
                continue
            w, likelihood = expectation_maximisation(chance[[*chosen, x]], counts)
            if (likelihood - best) * INDEPENDENT <= fee:
                break
            chosen, best, share = [*chosen, x], likelihood, w
        above = (best + counts.sum() * np.log(BUCKETS)) * INDEPENDENT - fee * (len(chosen) - 1)
        return {self.languages[x]: float(s) for x, s in zip(chosen, share, strict=True)}, float(above)

    def predict(self, text: str | None) -> tuple[str, float, str, bool]:
        """The language with the greatest proportion (of equal ones the first by name) or `und`, that proportion, all of them, and
        whether the text is in some language at all: no mixture of languages explains line noise better than chance does."""
        found, above = self.proportions(text)
        found = sorted(found.items(), key=lambda x: (-x[1], x[0]))
        if not found:
            return "und", 0.0, "", False
        return found[0][0], min(1.0, found[0][1]), ",".join(f"{k}:{v:.3f}" for k, v in found), above > 0

    def __call__(self, texts: pa.Array) -> pa.Array:
        found = [self.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.bool_()))], ["lang_pred", "score", "mixture", "known"])


def expectation_maximisation(chance: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (rows of `chance`) in trigrams seen `counts` times, and their log-likelihood."""
    n, weights = counts.sum(), np.full(len(chance), 1 / len(chance))
    for _ in range(ROUNDS):
        after = weights * (chance @ (counts / (weights @ chance))) / n
        moved = np.abs(after - weights).max()
        weights = after
        if moved < STILL:
            break
    return weights, float(np.log(weights @ chance) @ counts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training_docs: int = TRAINING_DOCS) -> Model:
    """A model of the texts with a language whose document isn't held out; of at most about `training_docs` of them, of which every
    language has an equal part, or all that it has."""
    bounded_batches(docs.sparkSession)
    labelled = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    labelled = labelled.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    cells = 1 << 30
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    part = training_docs / max(1, len(sizes))
    for lang, n in sizes.items():
        if n > part:
            labelled = labelled.where((F.col("lang") != lang) | (F.pmod(F.xxhash64("id"), F.lit(cells)) < int(part / n * cells)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    seen.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    sums = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for lang, bucket, n in sums.toLocalIterator():  # at most LANGUAGES x BUCKETS rows
        counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] = n
    return Model(counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row: `row` (the columns in `keep`, all by default) and `out`: lang_pred, score (0 to 1), mixture (all languages with
    their proportions), known (whether they explain the text better than chance). Only the text is read: null texts and texts
    without a letter are `und` with score 0. An empty table
    gives an empty result; a model of no texts knows no language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES x BUCKETS x 8 bytes, 1 MB for four languages
    out = T._parse_datatype_string("struct<lang_pred:string,score:double,mixture:string,known:boolean>")
    return map_texts(docs, text_col, lambda: shared.value, out, keep)
