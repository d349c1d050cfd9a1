import itertools
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import langid
from palimpsest.llm.queries import op1_language_id

from .fixtures import SCHEMA, awkward, edge_texts

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{BIG}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = op1_language_id(spark, BIG).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(tested) > 100 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in tested]) > 0.98


def test_mixtures(spark, model):
    by = {}
    for r in spark.read.parquet(f"{BIG}/documents.parquet").where("n_chars between 1500 and 2500").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text)
    mixed = model.proportions(by["en"][:1400] + " " + by["de"][:700])[0]
    assert set(mixed) == {"en", "de"} and abs(mixed["en"] - 2 / 3) < 0.1
    alone = model.proportions(by["fr"])[0]
    assert max(alone, key=alone.get) == "fr" and alone["fr"] > 0.95


def test_expectation_maximisation_finds_the_highest_likelihood():
    rng = np.random.default_rng(1)
    chance = rng.dirichlet(np.ones(50), 2)
    counts = np.bincount(rng.choice(50, 5000, p=[0.3, 0.7] @ chance), minlength=50).astype(float)
    weights, best = langid.expectation_maximisation(chance, counts)
    grid = [np.log(np.array([w, 1 - w]) @ chance) @ counts for w in np.linspace(0.001, 0.999, 999)]
    assert best >= max(grid) - 1 and abs(weights[0] - 0.3) < 0.06


def _penalised(model, text, names):
    """The best likelihood of a mixture of these languages, by many rounds from an even start, less the fee for each after the first."""
    seen = np.bincount(langid.grams(text), minlength=langid.BUCKETS)
    at = np.flatnonzero(seen)
    counts, chance = seen[at].astype(float), model.chance[[model.languages.index(x) for x in names]][:, at]
    w = np.full(len(names), 1 / len(names))
    for _ in range(300):
        w = w * (chance @ (counts / (w @ chance))) / counts.sum()
    fee = 0.5 * np.log(max(2.0, counts.sum() * langid.INDEPENDENT))
    return np.log(w @ chance) @ counts * langid.INDEPENDENT - fee * (len(names) - 1)


def test_the_set_of_languages_as_by_all_sets(spark, model):
    """Of all sets of languages the chosen one has the highest penalised likelihood, for whole texts and for mixed ones."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and langid.has_letter(r.text)]
    rng = random.Random(1)
    texts = [t[:3000] for t in texts[:60]] + [" ".join(rng.choice(texts)[: rng.choice([60, 200, 800])] for _ in range(rng.randrange(2, 4))) for _ in range(60)]
    several = 0
    for t in texts:
        chosen, _ = model.proportions(t)
        every = {names: _penalised(model, t, names) for k in range(1, 5) for names in itertools.combinations(model.languages, k)}
        assert every[tuple(sorted(chosen))] >= max(every.values()) - 0.5, t
        several += len(chosen) > 1
    assert several > 10


def test_line_noise_is_no_language(spark, model):
    rng = random.Random(2)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ+/=0123456789") for _ in range(400)) for _ in range(20)] + ["漢字" * 50, "xqjzvkw"]
    assert not any(model.predict(t)[3] for t in noise) and all(model.predict(t)[0] in model.languages for t in noise)
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("lang is not null and text is not null").collect()
    plain = [r for r in docs if langid.has_letter(r.text) and sum(map(str.isalpha, r.text)) > 0.6 * len(r.text)]
    assert all(model.predict(r.text)[3] for r in plain)


def test_a_rare_language_is_learned_from_all_that_it_has(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(3000)] + [(5000 + i, f"xy{i} zzyx wuxi", "rare") for i in range(40)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), training_docs=200)
    assert m.languages == ["en", "rare"]
    bucket = langid.grams("zzyx")[0]
    kept = sum(zlib.crc32(str(5000 + i).encode()) % 5 != 0 for i in range(40))
    total = sum(len(langid.grams(f"xy{i} zzyx wuxi")) for i in range(40) if zlib.crc32(str(5000 + i).encode()) % 5)
    assert np.isclose(m.chance[1, bucket], (kept + langid.SMOOTH) / (total + langid.SMOOTH * langid.BUCKETS))


def test_learns_only_from_labelled_texts_that_are_not_held_out(spark):
    rows = [(i, ("aaa bbb " if i % 2 else "xxx yyy ") * 20, "A" if i % 2 else "X") for i in range(200)]
    lies = [(i, t, "Z" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows] + [(None, "q", "Z"), (500, "q q", None), (502, None, "N")]
    m = langid.fit(spark.createDataFrame(lies, "doc_id long, text string, lang string"))
    assert [x for x in m.languages if x != "N"] == ["A", "X"]


def test_awkward_rows(spark, model):
    texts = [*edge_texts(), "123 !?", "é", "漢字", "½ ² Ⅷ ①"]
    docs = awkward(spark, texts)
    rows = {r.doc_id: r for r in langid.identify(docs, model).select("row.doc_id", "out.*").collect()}
    for i, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
        else:
            assert rows[i].lang_pred in model.languages and 0 < rows[i].score <= 1
    empty = spark.createDataFrame([], SCHEMA)
    nothing = langid.fit(empty)
    assert nothing.languages == [] and langid.identify(empty, nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, nothing).select("out.*").collect()} == {"und"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)
