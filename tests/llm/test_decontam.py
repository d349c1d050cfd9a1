import hashlib
import random
import re

import pytest

from palimpsest.llm import decontam
from palimpsest.llm.queries import op9_decontamination

from .fixtures import SCHEMA, awkward, edge_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(found)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item é"), (10, "one"), (None, "no name here"), (4, None), (5, "..."), (2, "x y z"), (7, "a a a a a a a a a a a a")]


def _documents(seed):
    rng = random.Random(seed)
    long = words(ITEMS[0][1])
    out = [ITEMS[0][1], "pre " + ITEMS[0][1].upper() + ", post", "short ITEM  é!", "é short item", "a " * 30, "a " * 9, "alpha beta gamma delta epsilon zeta eta theta iota"]
    for _ in range(150):
        cut = rng.randrange(len(long))
        out.append(" ".join(rng.choice(["one", "x y z", "no name here", "filler", " ".join(long[cut : cut + rng.randrange(13)]), "short item"]) for _ in range(rng.randrange(8))))
    return edge_texts() + out


def _check(found, texts):
    for r in found.select("row.doc_id", "out.*").collect():
        n, hit, items = brute(texts[r.doc_id], ITEMS)
        spans = list(zip(r.starts, r.ends, strict=True))
        assert r.n_words == n and [p for a, b in spans for p in range(a, b)] == hit and list(r["items"]) == items, texts[r.doc_id]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_hits_as_by_brute_force(spark, bench):
    texts = _documents(1)
    _check(decontam.scan(awkward(spark, texts), bench), texts)


def test_a_test_set_in_blocks_is_scanned_whole(spark, bench):
    texts = _documents(2)
    _check(decontam.scan(awkward(spark, texts), bench, keep=["doc_id", "text"], block_chars=20), texts)


def test_no_word_crosses_rows_or_steps(spark, bench, monkeypatch):
    from palimpsest.llm import common

    scanner = decontam.Scanner(decontam.WindowSet([("1", "short item")], 10))
    import pyarrow as pa

    monkeypatch.setattr(common.steps, "__defaults__", (8,))
    out = scanner(pa.array(["short", "item", "a short", "item short item", None, "short item"])).to_pylist()
    assert [x["items"] for x in out] == [[], [], [], ["1"], [], ["1"]] and [x["n_words"] for x in out] == [1, 1, 2, 3, 0, 2]


def test_removal(spark, bench):
    docs = awkward(spark, [None, "", "clean text", "é before short item é, after!", "one"])
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    cut = decontam.decontaminated(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert [r.text for r in cut.orderBy("doc_id").collect()] == [None, "", "clean text", "é before , after!", ""]


def test_empty_tables(spark, bench):
    docs = awkward(spark, ["one"])
    none = spark.createDataFrame([], bench.schema)
    assert decontam.decontaminated(docs, none).count() == 1
    assert decontam.scan(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_query_on_the_table(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_decontamination(spark, sf_dir).where("doc_id % 7 = 0 or contaminated").collect():
        n, hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
