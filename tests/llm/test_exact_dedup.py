import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup

from .fixtures import SCHEMA, awkward, edge_texts


def brute(rows):
    """rows: (doc_id, text). For each: keep_id, group size, digest; and how many rows of a group stay."""
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for i, p in enumerate(plain):
        groups[p].append(i)
    best = {p: min(g, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0)) for p, g in groups.items()}
    return [(d, rows[best[p]][0], len(groups[p]), hashlib.sha256(p.encode()).hexdigest()) for (d, _), p in zip(rows, plain, strict=True)]


def _spread(seed):
    rng = random.Random(seed)
    base = ["alpha beta", "é 漢 😀", "", "same words here", "x"]
    return [(i, "".join(c + rng.choice(["", " ", "\t", "\n", " "]) for c in rng.choice(base))) for i in range(200)]


def _check(found, rows):
    got = found.collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted((str(a), str(b), n, h) for a, b, n, h in brute(rows))
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(kept.values()) <= {1}


def test_groups_as_by_brute_force(spark):
    rows = list(enumerate(edge_texts())) + [(i + 100, t) for i, t in _spread(1)]
    docs = awkward(spark, [t for _, t in rows]).withColumn("doc_id", F.when(F.col("doc_id") < len(edge_texts()), F.col("doc_id")).otherwise(F.col("doc_id") + 100 - len(edge_texts())))
    _check(exact_dedup.exact_dedup(docs), rows)


def test_colliding_digests_are_told_apart_by_full_texts(spark):
    rows = _spread(2)
    weak = lambda text: F.char_length(text).cast("string")
    _check(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak), rows)


def test_large_groups_are_checked_by_salted_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_A_SALT", 7)
    rows = _spread(3)
    _check(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_repeated_rows_and_null_identifiers(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a  b"), (None, "ab"), (2, None), (2, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _check(exact_dedup.exact_dedup(docs), rows)
    kept = exact_dedup.deduplicated(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) in ([(0, "a  b"), (2, "")],)


def test_empty_table_columns_and_no_python(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.deduplicated(empty).count() == 0
    docs = awkward(spark, ["a", "b"])
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_state_is_kept_for_further_batches(spark, tmp_path):
    """Later batches meet the state of earlier ones; a repeated call adds nothing."""
    batches = [[(1, "a b"), (2, "c"), (3, None)], [(4, "ab"), (5, "a  b"), (6, "d")], [(7, "c "), (8, ""), (9, "c")]]
    folder, so_far = str(tmp_path / "state"), []
    for n, rows in enumerate(batches):
        so_far += rows
        for _ in range(2):
            found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), folder=folder, batch=n).collect()
            assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in found) == sorted(_groups(so_far))
    again = exact_dedup.deduplicated(spark.createDataFrame(batches[2], "doc_id long, text string"), folder=folder, batch=2)
    assert sorted(r.doc_id for r in again.collect()) == sorted(i for i, _, _, kept in _groups(so_far) if kept)


def _groups(rows):
    out = []
    for i, t in rows:
        same = [(-len(u or ""), j) for j, u in rows if "".join((u or "").split()) == "".join((t or "").split())]
        out.append((i, min(same)[1], len(same), min(same)[1] == i))
    return out
