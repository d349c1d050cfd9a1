"""A deterministic sharded WARC writer, and a reader that checks what it reads.

Records are range-sorted by identifier, then by payload digest, into shards whose bounds are quantiles that follow from the data
alone. A task writes a shard's files one after the other, rolls to the next by compressed size, and names a file only when it is
whole. A shard counts once its manifest has its name, an archive once the top manifest has; a task that runs again writes the
same bytes under the same names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_or_empty

#: Payload bytes of a shard and compressed bytes of a file.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: What a record counts towards its shard besides its payload, so that a shard of empty payloads has an end too.
RECORD_BYTES = 512
#: Most shards, each a task's work; an archive too large for those has larger shards, of more files.
SHARDS = 1 << 15
#: Records whose places say where shards begin: so many at least, and so many for each shard. The driver sees those.
SAMPLE, SHARD_SAMPLE = 20_000, 16
#: All records carry one date, so that equal input gives equal archives.
DATE = "2020-01-01T00:00:00Z"
#: Record identifiers are name-based in this space.
_SPACE = uuid.UUID("6f6c7c5e-2d1f-5a39-9c59-1a5b0b9d1c11")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, record_type string, record_id string, refers_to long, uri string, payload_bytes long, payload_digest string, payload string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, sha256: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {sha256} {copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha256: str, copy: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the response that has it."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id, sha256, copy)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_name(refers_to, sha256, 0)}"]
        head += [f"Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, without time or name."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Folder:
    """Files of an archive, on any file system that the address names; whole files get their names at once."""

    def __init__(self, address: str) -> None:
        self.files, self.path = pyarrow.fs.FileSystem.from_uri(address)
        self.files.create_dir(f"{self.path}/_temporary", recursive=True)

    def temporary(self) -> str:
        return f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def name(self, temporary: str, final: str) -> None:
        """Give a whole file its name. One that has it already is from an earlier run of this task, with the same bytes."""
        final = f"{self.path}/{final}"
        if self.files.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
            self.files.move(temporary, final)
        else:
            self.files.delete_file(temporary)

    def put(self, data: bytes, final: str) -> None:
        path = self.temporary()
        with self.files.open_output_stream(path, compression=None) as f:
            f.write(data)
        self.name(path, final)


class _ShardWriter:
    """One shard's files and manifest."""

    def __init__(self, folder: _Folder, shard: int, roll_bytes: int) -> None:
        self.folder, self.shard, self.roll = folder, shard, roll_bytes
        self.files: list[dict] = []
        self.out = None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.path = self.folder.temporary()
            self.out, self.size, self.records, self.digest = self.folder.files.open_output_stream(self.path, compression=None), 0, 0, hashlib.sha256()
        data = member(data)
        self.out.write(data)
        self.digest.update(data)
        self.size, self.records = self.size + len(data), self.records + 1
        if self.size >= self.roll:
            self._close()

    def _close(self) -> None:
        self.out.close()
        name = f"shard-{self.shard:07d}-{len(self.files):04d}.warc.gz"
        self.folder.name(self.path, name)
        self.files.append({"file": name, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest()})
        self.out = None

    def finish(self) -> tuple[str, int]:
        if self.out is not None:
            self._close()
        name = f"shard-{self.shard:07d}.json"
        self.folder.put(json.dumps(self.files, indent=1).encode(), name)
        return name, sum(f["records"] for f in self.files)


def _bounds(rows: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """The places (key, part) at which shards after the first begin: quantiles by size over a sample that a hash of the rows picks,
    so that equal rows have equal bounds however they are divided into partitions."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, min(SHARDS, -(-total // shard_bytes)))
    if shards == 1:
        return []
    cells = 1 << 30
    share = min(1.0, max(SAMPLE, SHARD_SAMPLE * shards) / n)
    picked = F.pmod(F.xxhash64("page_id", "url", "payload"), F.lit(cells)) < int(share * cells)
    found = (rows.where(picked) if share < 1 else rows).groupBy("key", "part").agg(F.sum("size").alias("size")).toArrow()
    key, part, size = (found.column(c).to_numpy() for c in ("key", "part", "size"))
    order = np.lexsort((part, key))
    before = np.cumsum(size[order]) - size[order]
    at = np.unique(np.searchsorted(before, before[-1] * np.arange(1, shards) / shards + 1)) if len(order) else np.zeros(0, np.int64)
    at = order[at[at < len(order)]]
    return list(zip(key[at].tolist(), part[at].tolist(), strict=True))


def _shard(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds a row's place is not before, by binary search."""
    keys, parts = (F.from_json(F.lit(json.dumps([b[i] for b in bounds])), "array<bigint>") for i in (0, 1))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        key, part = F.get(keys, at + width - 1), F.get(parts, at + width - 1)
        behind = (key < F.col("key")) | ((key == F.col("key")) & (part <= F.col("part")))
        return F.when(behind, at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if bounds else F.lit(0)


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> None:
    """Write a record for every row of `pages` into the new folder `folder`, an address that all executors reach.

    The payload is the text of `payload_col` in UTF-8 (null: empty). Of rows with equal payloads the one with the smallest
    identifier (null last; of rows that tie, one) becomes a response, the others revisits of it. Rows without an identifier
    or address have records without those headers. Other columns are not written. An empty table gives an archive of no shards.
    Rows of one identifier are divided by their payloads; only rows equal in both always share a shard.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 128)
    payload = text_or_empty(pages[payload_col])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    sha256 = F.sha2(F.col("payload").cast("binary"), 256)
    rows = rows.withColumns({
        "sha256": sha256, "size": (F.octet_length("payload") + RECORD_BYTES).cast("long"),
        "key": F.coalesce("page_id", F.lit((1 << 63) - 1)), "part": F.conv(F.substring(sha256, 1, 15), 16, 10).cast("long"),
    })
    bounds = _bounds(rows, shard_bytes)
    rows, n = rows.withColumn("shard", _shard(bounds)), len(bounds) + 1
    # Where payloads repeat, a note with the first identifier goes ahead of a shard's records. Notes come from what each shard says of
    # a payload, counted before the shuffle, so a payload that most rows share is a row for each shard and not for each page.
    told = rows.groupBy("sha256", "shard").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    same = W.partitionBy("sha256")
    notes = told.select("sha256", "shard", F.min("least").over(same).alias("first_id"), F.sum("n").over(same).alias("copies")).where("copies > 1")
    none = F.lit(None).cast("string")
    notes = notes.select(F.lit(None).cast("long").alias("page_id"), none.alias("url"), none.alias("payload"), "sha256", "shard", "first_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"))
    records = rows.select("page_id", "url", "payload", "sha256", "shard", F.lit(None).cast("long").alias("first_id"), F.lit(1).alias("kind"), "key")
    # A task for each shard, by number: no hash can lay several into one.
    dealt = records.unionByName(notes).repartitionById(n, "shard").sortWithinPartitions("shard", "kind", "key", "sha256", F.asc_nulls_last("page_id"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, writer, done, last, copy, firsts = _Folder(folder), None, [], None, 0, {}
        for batch in batches:
            for page_id, url, text, sha256, shard, first_of, kind in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if writer is None or writer.shard != shard:
                    done += [(writer.shard, *writer.finish())] if writer else []
                    writer, last, firsts = _ShardWriter(place, shard, roll_bytes), None, {}
                if kind == 0:
                    firsts[sha256] = first_of
                    continue
                copy = copy + 1 if (page_id, sha256) == last else 0
                last, first_id = (page_id, sha256), firsts.get(sha256)
                revisit = sha256 in firsts and (first_id != page_id or copy > 0)
                writer.write(record(page_id, url, text.encode(errors="replace"), sha256, copy, first_id, revisit))
        done += [(writer.shard, *writer.finish())] if writer else []
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["shard", "manifest", "records"])

    shards = sorted(tuple(r) for r in dealt.mapInArrow(run, "shard long, manifest string, records long").collect())  # at most SHARDS rows
    place = _Folder(folder)
    place.put(json.dumps([{"shard": s, "manifest": m, "records": r} for s, m, r in shards], indent=1).encode(), "manifest.json")
    place.files.delete_dir(f"{place.path}/_temporary")


def parse(data: bytes) -> dict:
    """What a record says, after a check of its digests against its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(said["Content-Length"])]
    if said["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged block in {said['WARC-Record-ID']}")
    digest, size, body = said["WARC-Payload-Digest"].removeprefix("sha1:"), int(said["Payload-Length"]), None
    if said["WARC-Type"] == "response":
        body = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(body) != digest or len(body) != size:
            raise ValueError(f"damaged payload in {said['WARC-Record-ID']}")
        size, digest = len(body), base32_sha1(body)
    number = lambda k: int(said[k]) if k in said else None
    return {"page_id": number("Page-ID"), "record_type": said["WARC-Type"], "record_id": said["WARC-Record-ID"], "refers_to": number("Refers-To-Page-ID"), "uri": said.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "payload": body}


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    squeeze, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(squeeze.decompress(data))
            data = b""
            if squeeze.eof:
                yield b"".join(out)
                data, squeeze, out = squeeze.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the stream ends within a record")


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive; without `payloads` these are checked but left out. Files that no manifest names are not read."""
    place = _Folder(folder)
    with place.files.open_input_stream(f"{place.path}/manifest.json", compression=None) as f:
        shards = json.loads(f.read())
    place.files.delete_dir(f"{place.path}/_temporary")
    schema = T._parse_datatype_string(_RECORD)
    if not shards:
        return spark.createDataFrame([], schema)
    manifests = [s["manifest"] for s in shards]  # at most SHARDS names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with files.open_input_stream(f"{path}/{manifests[i]}", compression=None) as f:
                    listed = json.loads(f.read())
                for one in listed:
                    with files.open_input_stream(f"{path}/{one['file']}", compression=None) as f:
                        n = 0
                        for n, data in enumerate(members(f), 1):
                            row = parse(data)
                            row["payload"] = row["payload"].decode() if payloads and row["payload"] is not None else None
                            rows.append(row)
                            size += len(row["payload"] or "") + 200
                            if size > 4 << 20:
                                yield _batch(rows)
                                rows, size = [], 0
                    if n != one["records"]:
                        raise ValueError(f"{one['file']} has {n} records, its manifest {one['records']}")
        if rows:
            yield _batch(rows)

    return spark.range(0, len(manifests), 1, len(manifests)).mapInArrow(run, schema)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = {"page_id": long, "record_type": text, "record_id": text, "refers_to": long, "uri": text, "payload_bytes": long, "payload_digest": text, "payload": text}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))
