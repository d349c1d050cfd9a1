import base64
import gzip
import hashlib
import json
import os
import random

import pytest

from palimpsest.llm import warc
from palimpsest.llm.queries import op5_warc

SCHEMA = "page_id long, url string, html string, payload string, kind string, shard long"
ROWS = [(i, f"http://x/{i}", f"<p>{i % 7} é😀</p>" * (i % 50), "p", "k", 1) for i in range(300)]
ODD = [(None, None, None, None, None, None), (1000, "u\r\nv", "", None, None, 3), (1001, None, None, "p", "k", 1), (5, "again", ROWS[5][2], "p", "k", 1), (5, "again", ROWS[5][2], "p", "k", 1), (2000, "long", "x" * 200_000, None, None, 1), (None, "n", "only here", None, None, 1)]


def brute(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r[0])
    seen = set()
    for page_id, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        first, response = min(ids, default=None), (html or "") not in seen
        seen.add(html or "")
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS + ODD, SCHEMA)


def _read(spark, folder):
    return warc.read_archive(spark, folder)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages, folder, shard_bytes=20_000, roll_bytes=700)
    rows = _read(spark, folder).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == brute(ROWS + ODD)
    texts = {r[0]: r[2] or "" for r in ROWS + ODD if r[0] is not None}
    assert all(r.payload == texts[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    assert len({r.record_id for r in rows}) == len(rows)
    names = sorted(os.listdir(f"{tmp_path}/a"))
    assert "_temporary" not in names and sum(n.endswith(".warc.gz") for n in names) > sum(n.startswith("shard") and n.endswith(".json") for n in names) > 3


def test_files_are_the_same_each_time_and_roll_by_size(spark, pages, tmp_path):
    for name, parts in (("a", 2), ("b", 5)):
        warc.write_archive(pages.repartition(parts), f"file://{tmp_path}/{name}", shard_bytes=20_000, roll_bytes=700)
    a, b = (sorted(os.listdir(f"{tmp_path}/{n}")) for n in "ab")
    assert a == b
    for f in a:
        assert open(f"{tmp_path}/a/{f}", "rb").read() == open(f"{tmp_path}/b/{f}", "rb").read()
    for manifest in (f for f in a if f.startswith("shard") and f.endswith(".json")):
        listed = json.load(open(f"{tmp_path}/a/{manifest}"))
        assert all(x["bytes"] >= 700 for x in listed[:-1])
        for x in listed:
            data = open(f"{tmp_path}/a/{x['file']}", "rb").read()
            assert len(data) == x["bytes"] and hashlib.sha256(data).hexdigest() == x["sha256"]
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_identifiers_rise_within_and_across_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), folder, shard_bytes=20_000)
    ids = []
    for shard in json.load(open(f"{tmp_path}/a/manifest.json")):
        for one in json.load(open(f"{tmp_path}/a/{shard['manifest']}")):
            with open(f"{tmp_path}/a/{one['file']}", "rb") as f:
                ids += [warc.parse(x)["page_id"] for x in warc.members(f, 37)]
    assert ids == list(range(300))


def test_damage_and_unnamed_files(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages, folder, shard_bytes=20_000)
    with open(f"{tmp_path}/a/shard-9999999-0000.warc.gz", "wb") as f:
        f.write(b"left by a lost task")
    assert _read(spark, folder).count() == len(ROWS) + len(ODD)
    data = bytearray(warc.record(1, "u", b"payload", "0" * 64, 0, None, False))
    data[data.index(b"payload")] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bytes(data))


def test_one_identifier_or_payload_for_all(spark, tmp_path):
    rows = [(1, "u", str(i), None, None, 1) for i in range(400)]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", shard_bytes=200)
    assert len(json.load(open(f"{tmp_path}/a/manifest.json"))) > 3
    assert _read(spark, f"file://{tmp_path}/a").where("record_type = 'response'").count() == 400
    same = [(i, "u", "same", None, None, 1) for i in range(400)]
    warc.write_archive(spark.createDataFrame(same, SCHEMA), f"file://{tmp_path}/b", shard_bytes=200)
    assert _read(spark, f"file://{tmp_path}/b").where("record_type = 'revisit' and refers_to = 0").count() == 399


def test_a_shard_of_empty_payloads_ends_and_a_second_run_finds_its_files(spark, tmp_path):
    rows = [(i, "u", None, None, None, 1) for i in range(400)]
    for _ in range(2):
        warc.write_archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/a", shard_bytes=100 * warc.RECORD_BYTES)
        assert len(json.load(open(f"{tmp_path}/a/manifest.json"))) == 4
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in _read(spark, f"file://{tmp_path}/a").collect()) == brute(rows)


def _shard_ids(folder):
    out = []
    for shard in json.load(open(f"{folder}/manifest.json")):
        ids = []
        for one in json.load(open(f"{folder}/{shard['manifest']}")):
            with open(f"{folder}/{one['file']}", "rb") as f:
                ids += [warc.parse(x)["page_id"] for x in warc.members(f)]
        out.append(ids)
    return out


@pytest.mark.parametrize("ids", [
    [1, 2, 3, 4, 2**62], [-(2**63), -5, 0, 7, 2**63 - 1], list(range(60)) + [2**40 + i for i in range(60)], [i**9 - 10**12 for i in range(120)], [7] * 100 + [8, 9],
])
@pytest.mark.parametrize("most", [1 << 15, 3])
def test_shards_are_ranges_however_identifiers_lie(spark, tmp_path, monkeypatch, ids, most):
    """An outlying identifier, both ends of long, crowds, one identifier for nearly all; and more data than the shards there may be."""
    monkeypatch.setattr(warc, "SHARDS", most)
    rows = [(i, "u", f"text {n} of {i}", None, None, 1) for n, i in enumerate(ids)]
    random.Random(1).shuffle(rows)
    folder = f"{tmp_path}/a"
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{folder}", shard_bytes=2 * warc.RECORD_BYTES)
    shards = _shard_ids(folder)
    assert [x for s in shards for x in s] == sorted(ids)
    assert len(shards) <= most and (len(shards) == most or max(map(len, shards)) <= 4)
    assert max(map(len, shards)) <= 2 + 2 * len(ids) / len(shards)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in _read(spark, f"file://{folder}").collect()) == brute(rows)


def test_bounds_of_a_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE", 100)
    rows = [(i * i, "u", f"<p>{i}</p>", None, None, 1) for i in range(3000)]
    names = []
    for name, parts in (("a", 2), ("b", 5)):
        warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(parts), f"file://{tmp_path}/{name}", shard_bytes=3000 * warc.RECORD_BYTES // 8)
        names.append(sorted((f, open(f"{tmp_path}/{name}/{f}", "rb").read()) for f in os.listdir(f"{tmp_path}/{name}")))
    assert names[0] == names[1]
    shards = _shard_ids(f"{tmp_path}/a")
    assert [x for s in shards for x in s] == [i * i for i in range(3000)] and 8 <= len(shards) <= 9 and max(map(len, shards)) < 3 * 3000 / 8


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/a")
    assert _read(spark, f"file://{tmp_path}/a").count() == 0


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = op5_warc(spark, sf_dir).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(rows)
