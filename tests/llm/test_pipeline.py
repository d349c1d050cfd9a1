import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid

from .test_decontam import brute as hits
from .test_packing import _whole
from .test_simhash import _edited, _jaccard, components, shingles

LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(400))


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The driver's documents with planted cases; identifiers of those begin at 10 ** 6."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    planted = [None, "", " ", "123 456", *["an exact copy of some words"] * 3, "an  exact copy\tof some words", *_edited(1, 30, LONG), f"It is said that {item} and so on."]
    extra = spark.createDataFrame([(10**6 + i, t, None, "planted", 0) for i, t in enumerate(planted)], docs.schema)
    docs.unionByName(extra).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    out = [spark.read.parquet(f"{tables}/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for name, f in corpus_pipeline.STAGES:
        f(spark, out[-1], tables).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_language_id_rejects_what_is_in_no_language(spark, tables, stages):
    """Rejected texts have no letter, or their trigrams are less likely in each mixture tried than by chance."""
    docs, after = stages[0], _texts(stages[1])
    before, model = _texts(docs), langid.fit(docs)
    assert set(after) <= {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
    for d, t in before.items():
        if d not in after and t and langid.has_letter(t):
            seen = np.bincount(langid.grams(t), minlength=langid.BUCKETS)
            n = len(model.languages)
            for w in [*np.eye(n), np.full(n, 1 / n)]:
                with np.errstate(divide="ignore"):
                    assert np.log(w @ model.chance) @ seen < -seen.sum() * np.log(langid.BUCKETS) + 10, t[:200]
    assert all(d in after for d in before if d >= 10**6 and d not in (10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3))


def test_one_of_each_group_of_copies_stays(stages):
    before, after = _texts(stages[1]), _texts(stages[2])
    best = {}
    for d, t in before.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), d))
    assert set(after) == {d for _, d in best.values()}


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = _texts(stages[2]), _texts(stages[3])
    ids = sorted(before)
    sets = [set(shingles(before[d], 5)) for d in ids]
    root = components(len(ids), lambda i, j: min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and _jaccard(sets[i], sets[j]) >= 0.8)
    assert set(after) == {ids[r] for r in set(root)}


def test_documents_with_benchmark_windows_go(spark, tables, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = _texts(stages[3]), _texts(stages[4])
    assert set(after) == {d for d, t in before.items() if not hits(t, items)[1]}


def test_all_that_is_left_is_packed(spark, tables, stages):
    left = sorted(_texts(stages[4]))
    rows = stages[5].collect()
    lengths = {r.doc_id: r.doc_tokens for r in rows}
    assert sorted(lengths) == left
    _whole([(left.index(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in rows], [lengths[d] for d in left], 2048)
    whole = corpus_pipeline.run(spark, tables)
    assert whole.agg(F.sum("length")).first()[0] == sum(lengths.values())
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == set(left)
