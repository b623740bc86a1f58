"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id and payload digest. The bounds of the shards are quantiles of a sample that hashes choose, so they depend on
the rows and the number of shards alone; a task takes one shard after the other and starts a new file when one reaches `roll_bytes`
compressed. A file is written under a temporary name; its row in the manifest (a Parquet table, which Spark commits as a whole) makes
it count; files of the manifest then get their final names, and what else lies under temporary names is deleted. A repeated or lost
task leaves at most a temporary file that no manifest names. `write` goes on where an earlier one stopped: with a whole manifest it only finishes the
names, without one it writes anew. Until then `read` finds the files under either name.

Headers and digests are made anew from the page. Of records with equal payloads of REVISIT_BYTES
or more, that with the largest page_id is the response and all others revisit it.

Defined cases: a null html is an empty payload; a null url gives no target header; pages with a null id
are written, never revisited and, having no id, always responses; repeated rows give repeated
records, numbered from 0, next to each other in one shard; an empty table gives no file and an empty result; further columns are ignored. A
page's html is held whole by its task, a few times over while it is compressed; all other records pass by one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, new_path, read_table, small_batches

REVISIT_BYTES = 1_000
ROLL_BYTES = 64 << 20
LEVEL = 4
#: Pages carry no time of capture, and a clock would make runs differ.
DATE = "1970-01-01T00:00:00Z"
#: Rows of the sample that the shards' bounds come from, about, and parts into which the pages of one payload are dealt to be told what they revisit.
SAMPLE, SALT = 20_000, 16
MANIFEST = "name string, temporary string, bytes long, records long, sha1 string"


def _b32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(kind: str, page_id: int | None, nth: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. digest: the payload's SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}:{digest}:{nth}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []), f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}:0>"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Roller:
    """Files of one task."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.files, self.out = shard, roll_bytes, 0, None
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)

    def add(self, data: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.files:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None), hashlib.sha1(), 0, 0
            info = b"software: quarrygraph\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self._put(_member(head.encode() + info + b"\r\n\r\n"))
        self._put(_member(data))
        self.records += 1
        if self.bytes >= self.roll_bytes:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> Iterator[dict]:
        if self.out is not None:
            self.out.close()
            self.out, self.files = None, self.files + 1
            yield {"name": self.name, "temporary": self.temporary, "bytes": self.bytes, "records": self.records, "sha1": self.sha.hexdigest()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string())]))


def bounds(pages: DataFrame, shards: int) -> list[tuple[int, str]]:
    """The last (page_id, digest) of every shard but the last: quantiles of the keys whose hash falls into the sample, counted with their rows."""
    key = pages.select(_key(), "digest")
    total = key.count()
    chosen = key.filter(F.pmod(F.xxhash64("key", "digest"), F.lit(max(1, total // SAMPLE))) == 0).groupBy("key", "digest").agg(F.count("*").alias("n"))
    rows = sorted(chosen.collect())  # about SAMPLE rows, whatever the table's size
    each, so_far, out = sum(r["n"] for r in rows) / shards, 0, []
    for r in rows:
        so_far += r["n"]
        while so_far >= each * (len(out) + 1) and len(out) < shards - 1:
            out.append((r["key"], r["digest"]))
    return out


def _key() -> Column:
    """page_id for sorting, null first."""
    return F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("key")


def _shard(limits: list[tuple[int, str]], low: int = 0, high: int | None = None) -> Column:
    """The number of the first bound that a row doesn't pass, by halving."""
    high = len(limits) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    key, digest = limits[mid]
    below = (F.col("key") < key) | ((F.col("key") == key) & (F.col("digest") <= digest))
    return F.when(below, _shard(limits, low, mid)).otherwise(_shard(limits, mid + 1, high))


def write(spark: SparkSession, pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write page_id, url, html of pages below folder; the manifest, read back. What an earlier call left in folder is finished."""
    small_batches(spark)
    manifest = f"{folder}/manifest.parquet"
    if not _exists(spark, f"{manifest}/_SUCCESS"):
        _write(spark, pages, folder, manifest, roll_bytes, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return finish(spark, folder)


def _write(spark: SparkSession, pages: DataFrame, folder: str, manifest: str, roll_bytes: int, shards: int) -> None:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    long = pages.filter((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    kept = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    # Pages of one payload may be very many: they are dealt out by id, and what they revisit is copied to each part.
    dealt = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    revisits = long.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(dealt, ["digest", "salt"]).filter("page_id <> refers_to")
    revisits = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    # The note that a page revisits another travels with the page: one shuffle of the payloads.
    every = revisits.unionByName(pages.withColumn("refers_to", F.lit(None).cast("long"))).withColumn("key", _key())
    every = every.withColumn("shard", _shard(bounds(pages, shards))).repartitionById(shards, "shard")
    every = every.sortWithinPartitions("shard", "key", "digest", F.col("refers_to").asc_nulls_last(), "url").select("shard", "page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, nth, note = None, None, 0, None
        for batch in batches:
            rows = []
            for shard, page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if roller is None or shard != roller.shard:
                    rows += roller.close() if roller else []
                    roller = _Roller(folder, shard, roll_bytes)
                if (shard, page_id, digest) != last:
                    last, nth, note = (shard, page_id, digest), 0, None
                if refers_to is not None:
                    note = refers_to
                    continue
                rows += roller.add(record("revisit" if note is not None else "response", page_id, nth, url, payload, digest, note))
                nth += 1
            yield _batch(rows)
        yield _batch(list(roller.close()) if roller else [])

    every.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)


def finish(spark: SparkSession, folder: str) -> DataFrame:
    """Give the files of folder's manifest their final names and delete what else lies under temporary ones; the manifest."""
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if where.get_file_info(f"{path}/{name}").type == fs.FileType.File:
                    continue
                where.move(f"{path}/{temporary}", f"{path}/{name}")
            yield batch

    found.mapInArrow(rename, MANIFEST).write.format("noop").mode("overwrite").save()
    delete_path(spark, f"{folder}/_temporary")
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def members(stream: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed; memory holds one."""
    d, parts = zlib.decompressobj(31), []
    for chunk in stream:
        while chunk:
            parts.append(d.decompress(chunk))
            chunk = b""
            if d.eof:
                chunk = d.unused_data
                yield b"".join(parts)
                d, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string"


def _number(uri: str) -> int | None:
    part = uri.strip("<>").split(":")[2]
    return None if part == "None" else int(part)


def read(spark: SparkSession, folder: str, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The response and revisit records of the manifest's files; with payload also the bytes (null for revisits)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                rows, held = [], 0
                name = name if where.get_file_info(f"{path}/{name}").type == fs.FileType.File else temporary
                with where.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for data in members(iter(lambda f=f: f.read(1 << 20), b"")):
                        head, block = parse(data)
                        if head["warc-type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(head["warc-payload-digest"].split(":")[1]).hex()
                        if head["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        row = {"page_id": _number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "payload_bytes": int(http.rpartition(b"Content-Length:")[2]), "payload_digest": digest}
                        rows.append(row | {"refers_to": _number(head["warc-refers-to"]) if "warc-refers-to" in head else None, "file": name.rpartition("/")[2]} | ({"payload": body if head["warc-type"] == "response" else None} if payload else {}))
                        held += len(data) * payload
                        if len(rows) >= 2_000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "temporary").repartition(files, "name").mapInArrow(run, RECORDS + ", payload binary" * payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write(spark, read_table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The same in DuckDB.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN d.page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN d.page_id <> keep THEN keep END AS refers_to, url
FROM d LEFT JOIN m ON m.payload_digest = d.payload_digest
"""
