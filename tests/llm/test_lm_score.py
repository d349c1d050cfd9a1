import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import lm_score
from palimpsest.llm.queries import op10_lm_scoring

from .fixtures import SCHEMA, awkward, edge_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def number(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(lm_score.tokens(data, np.array([0, len(data)]))[0][0])


def _softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def brute(model, text):
    """Words, and the sum over them of the network's logarithms, one token at a time."""
    tables, shift, outer, bias, inner, inner_bias = (w.astype(float) for w in model.network.weights)
    found = np.array([number(w) for w in words(text)], np.uint64)
    classes, within = model.words(found)
    groups, reach, total = lm_score.CLASSES // lm_score.GROUP, lm_score.WINDOW, 0.0
    for i, c in enumerate(classes.tolist()):
        hidden = shift.copy()
        for p, j in enumerate([j for j in range(i - reach, i + reach + 1) if j != i]):
            hidden += tables[p, classes[j] + 1 if 0 <= j < len(classes) else 0]
        hidden = np.tanh(hidden)
        g, place = c % groups, c // groups
        total += math.log(_softmax(hidden @ outer + bias)[g]) + math.log(_softmax(hidden @ inner[g] + inner_bias[g])[place]) + within[i]
    return len(found), total


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return lm_score.fit(docs)


def test_scores_as_by_brute_force(spark, model):
    texts = edge_texts() + ["The cat of the house and the dog in the garden"]
    for r in lm_score.score(awkward(spark, texts), model).select("row.doc_id", "out.*").collect():
        n, total = brute(model, texts[r.doc_id])
        assert r.n_tokens == n and abs(r.pll - total) < 1e-4 * max(1, n) and (r.mean_pll is None) == (n == 0)


def test_query_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, model = {r.doc_id: r.text for r in table.collect()}, lm_score.fit(table)
    rows = op10_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows[:30]:
        n, total = brute(model, texts[r.doc_id])
        assert r.n_tokens == n and abs(r.pll - total) < 1e-3 * max(1, n)


def test_probabilities_sum_to_one(model):
    around = np.random.default_rng(1).integers(0, lm_score.CLASSES + 1, (2 * lm_score.WINDOW, 5)).astype(np.int16)
    every = np.array([model.network.logs(around, np.full(5, c, np.int16)) for c in range(lm_score.CLASSES)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    inside = np.bincount(model.words.classes[:-1], weights=np.exp(model.words.within[:-1]), minlength=lm_score.CLASSES)
    assert np.allclose(inside[:-1][inside[:-1] > 0], 1)


def test_words_are_counted_over_the_whole_corpus(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "TOGETHER", 1000)
    want = Counter(w for r in docs.collect() for w in words(r.text))
    counts = lm_score.word_counts(docs)
    assert {r.word % (1 << 64): r.n for r in counts.collect()} == {number(w): n for w, n in want.items()}
    monkeypatch.setattr(lm_score, "VOCABULARY", 500)
    some = lm_score.vocabulary(counts)
    least = min(want[w] for w in want if number(w) in set(some.words.tolist()))
    assert 300 < len(some.words) <= 500 and len(some.words) == sum(n >= least for n in want.values())
    rare = [n for n in want.values() if n < least]
    assert math.isclose(some.within[-1], -math.log(len(rare) + 1)) and math.isclose(some.share[-1] * (sum(want.values()) + lm_score.CLASSES), sum(rare) + 1)


def test_contexts_stay_in_their_rows():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(0, 6, rng.integers(1, 8))
        first = np.concatenate([[0], np.cumsum(lengths)])
        classes = rng.integers(0, 1000, first[-1]).astype(np.int16)
        if not len(classes):
            continue
        got, reach = lm_score.contexts(classes, first), lm_score.WINDOW
        for a, b in zip(first[:-1], first[1:], strict=True):
            for i in range(a, b):
                assert got[:, i].tolist() == [int(classes[j]) + 1 if a <= j < b else 0 for j in range(i - reach, i + reach + 1) if j != i]


def test_steps_follow_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    network = lm_score.WindowNetwork(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    around, classes = rng.integers(0, 40, (2 * lm_score.WINDOW, 64)).astype(np.int16), rng.integers(0, lm_score.CLASSES, 64).astype(np.int16)
    seen = []
    network._step = lambda which, at, slope: seen.append((which, at, slope))
    network.learn(around, classes)
    for which, at, slope in seen[:6] + seen[-3:]:
        w = network.weights[which]
        place = np.unravel_index(np.argmax(np.abs(slope)), slope.shape)
        where = place if at is ... else (at, *place) if isinstance(at, int) else (at[0], at[1][place[0]], place[1])
        was, loss = w[where], []
        for d in (1e-2, -1e-2):
            w[where] = was + d
            loss.append(-network.logs(around, classes).mean())
        w[where] = was
        assert abs((loss[0] - loss[1]) / 2e-2 - slope[place]) < 2e-3 + 0.05 * abs(slope[place])


def test_held_out_text_is_predicted_better_than_by_a_unigram_and_a_one_neighbour_model(spark, monkeypatch):
    """Words depend on two words on the left and one on the right, which neither of the simpler models can see."""
    rng = np.random.default_rng(4)

    def text():
        w = rng.integers(0, 12, 60).tolist()
        for i in range(2, 60, 3):
            w[i - 1] = (w[i - 2] + 3 * (w[i] % 2)) % 12
        return " ".join(f"w{x}" for x in w)

    train, test = [text() for _ in range(4000)], [text() for _ in range(100)]
    monkeypatch.setattr(lm_score, "BATCH", 256)
    model = lm_score.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    got = sum(r["pll"] for r in model(pa.array(test)).to_pylist()) / 6000
    one, two, first = Counter(), Counter(), Counter()
    for t in train:
        w = t.split()
        one.update(w), two.update(zip(w, w[1:], strict=False)), first.update(w[:-1])
    unigram = sum(math.log(one[x] / sum(one.values())) for t in test for x in t.split()) / 6000
    neighbour = sum(math.log((two[a, b] + 1) / (first[a] + 12)) if a else math.log(1 / 12) for t in test for a, b in zip([None, *t.split()], t.split(), strict=False)) / 6000
    assert got > neighbour + 0.05 and got > unigram + 0.05


def test_real_text_is_predicted_better_than_by_a_unigram_and_shuffled_text(docs, model):
    texts = [r.text for r in docs.where("n_chars > 1000").limit(60).collect()]
    rng = np.random.default_rng(5)
    plain, shuffled, unigram = 0.0, 0.0, 0.0
    for t in texts:
        w = t.split()
        a, b = model(pa.array([" ".join(w), " ".join(rng.permutation(w))])).to_pylist()
        classes, within = model.words(np.array([number(x) for x in words(t)], np.uint64))
        plain, shuffled, unigram = plain + a["pll"], shuffled + b["pll"], unigram + (np.log(model.words.share[classes]) + within).sum()
    assert plain > shuffled and plain > unigram


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0


def test_rounds_learn_from_all_documents(spark, monkeypatch):
    shares = []
    monkeypatch.setattr(lm_score, "LEAST", 1)
    monkeypatch.setattr(lm_score, "_round", lambda texts, model, turn, share: shares.append(share))
    lm_score.fit(spark.createDataFrame([(i, f"some words {i}") for i in range(200)], "doc_id long, text string"))
    assert sum(shares) >= 1
