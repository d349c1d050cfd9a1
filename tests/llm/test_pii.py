import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, pii
from palimpsest.llm.queries import op4_pii

from .fixtures import SCHEMA, awkward, edge_texts, fuzz

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    out = [(m.start(), i, m.end(), k) for i, (k, r) in enumerate(RULES.items()) for m in re.finditer(r, text or "") if _holds(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TEXTS = [
    "mail a.b@c.de, a@b.c_d@e.f and x@y now", "é😀 +49 (30) 1234567 😀 call", "1.2.3.4.5 256.1.1.1 0255.000.1.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "000000000000", "+1-1 +1)(2 +12 ( 34567890", "GB82 WEST 1234 5698 7654 32 bank account", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "code 123-45-6789",
    "a" * 5000 + "@" + "b." * 3000 + "c", "1.2.3." * 4000, "4 " * 9000, "@@a@b.c@d.e",
]


@pytest.fixture(scope="module")
def texts():
    return edge_texts() + TEXTS + fuzz(1, "ab1@._-+ é", 400, 40) + fuzz(2, "0123456789 -.+()", 400, 60) + fuzz(3, "4111 -", 300, 40)


def test_base_spans_as_by_brute_force(spark, texts):
    docs = awkward(spark, texts)
    docs.createOrReplaceTempView("d")
    found = pii.find_pii(docs)
    for r in found.select("row.text", pii.span_list(found.spans).alias("s")).collect():
        want = base_spans(r.text)
        assert [x for x in r.s.split(",") if x and x.split(":")[0] in RULES] == want, r.text


def test_added_spans_need_a_checksum_or_context(spark):
    docs = awkward(spark, TEXTS)
    got = {r.text: [(s.kind, s.value) for s in r.spans if s.kind in ("iban", "ssn")] for r in pii.find_pii(docs).select("row.text", "spans").collect()}
    assert got[TEXTS[6]] == [("iban", "GB82 WEST 1234 5698 7654 32")] and got[TEXTS[7]] == []
    assert got[TEXTS[8]] == [("ssn", "123-45-6789")] and got[TEXTS[9]] == []


def test_context_raises_the_score(spark):
    docs = awkward(spark, ["call +49 30 1234567", "code +49 30 1234567"])
    near, far = [r.spans[0].score for r in pii.find_pii(docs).orderBy("row.doc_id").collect()]
    assert near > far


def test_query_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in RULES]


def test_redacted_keeps_rows_columns_and_nulls(spark):
    docs = awkward(spark, [None, "", "write a@b.cd, 1.2.3.4", "x"])
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [None, "", "write [EMAIL], [IP]", "x"]


def test_redacted_texts_hold_no_span(spark, texts, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 7)
    docs = awkward(spark, texts)
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find_pii(docs).select("row.doc_id", "spans").collect()}
    for r in pii.redacted(docs).collect():
        text, out, at = texts[r.doc_id], [], 0
        for a, b, k in spans[r.doc_id]:
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert r.text == (None if text is None else "".join(out) + text[at:])


@pytest.mark.parametrize("made", [lambda n: "a@b.c " * n, lambda n: "1.2.3.4 " * n, lambda n: "+1 234 567 890, " * n, lambda n: "4111111111111111x" * n])
def test_long_texts_full_of_matches(spark, made):
    """Megabytes of matches take seconds; the places are right to the last one."""
    n = 150_000
    docs = spark.createDataFrame([(1, made(n))], "doc_id long, text string")
    began = time.monotonic()
    found = pii.find_pii(docs).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).first()
    assert found.n == n and made(n)[found.last.start : found.last.end] == found.last.value and found.last.end > len(made(n)) - 3
    text = pii.redacted(docs).first().text
    assert text.count("[") == n and not re.search("[0-9@]", text)
    assert time.monotonic() - began < 90


def test_empty_table_and_no_python(spark):
    found = pii.find_pii(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
