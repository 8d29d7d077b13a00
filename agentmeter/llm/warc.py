"""A deterministic sharded WARC writer, and its reader.

Pages are ordered by page_id, url and digest. Exact prefix sums of their sizes over that order cut it into shards of about
SHARD_BYTES, so the cuts depend on the pages alone, not on how Spark has dealt them. A task writes a shard in order, one gzip
member a record, and begins a new file when the compressed one reaches ROLL_BYTES. Headers, digests and record ids are worked out anew
from the page and its place in the file; equal pages therefore give equal files, byte for byte.

Of pages with equal payloads the first in the order is a response and the others are revisits that refer to it. What is to be a
revisit is known before payloads move: decisions, made on rows without payloads, are sorted in front of the pages that they are about.

A task attempt writes under names of its own and returns manifest rows. Spark keeps the rows of one attempt of each task; only their files
are renamed to their final names, and the manifest table is written last. An archive without a manifest was not finished, and files of
lost attempts are never seen. Renaming again what has been renamed does nothing.

Scale: payloads are shuffled once. Digests, sizes and decisions are rows without payloads. The driver holds the first page_id of each shard,
MAX_SHARDS at most (shards grow beyond that). A task holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.llm.common import shared_dir, written

SHARD_BYTES, ROLL_BYTES, MAX_SHARDS = 32 << 20, 8 << 20, 65_536
#: What a record counts for besides its payload; the date of all records (pages have none); compression level.
OVERHEAD, DATE, LEVEL = 512, "2000-01-01T00:00:00Z", 6

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_MANIFEST = "name string, temp string, shard int, part int, file int, records long, bytes long, sha256 string"
_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, file string, offset long, payload binary"


def _rows(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))


def _order(*more: str) -> list[Column]:
    """Pages by page_id, url and digest, nulls last."""
    return [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("digest"), *map(F.col, more)]


def decisions(slim: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, digest, first_id, first_url) of pages whose payload is repeated; first_...: the page that is the response.

    slim: page_id, url, digest, bytes. Payloads of fewer than least bytes aren't looked at. Equal rows share a decision.
    """
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("url").isNull().alias("nowhere"), "url")
    repeated = slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    distinct = slim.select("page_id", "url", "digest").distinct()
    return distinct.join(repeated, "digest").select("page_id", "url", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))


def cuts(slim: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, dict[int | None, int]]:
    """The first page_id of each shard but the first, and into how many parts the shard of a too large page_id is split."""
    spark = slim.sparkSession
    ids = slim.groupBy("page_id").agg(F.sum(F.col("bytes") + OVERHEAD).alias("bytes"))
    ranged = ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("page_id").asc_nulls_last())
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "warc-ids")
    sums = ranged.groupBy("range").agg(F.sum("bytes").alias("sum"))
    before = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))  # a row for each range
    total = sums.agg(F.sum("sum")).first()[0] or 0
    size = max(shard_bytes, -(-total // MAX_SHARDS))
    start = F.sum("bytes").over(Window.partitionBy("range").orderBy(F.col("page_id").asc_nulls_last())) - F.col("bytes") + F.col("before")
    placed = ranged.join(F.broadcast(before), "range").select("page_id", "bytes", start.alias("start")).withColumn("shard", F.expr(f"start div {size}"))
    firsts = placed.where("page_id IS NOT NULL").groupBy("shard").agg(F.min("page_id").alias("page_id")).orderBy("page_id").toArrow()["page_id"].to_numpy()
    large = {r["page_id"]: -(-r["bytes"] // size) for r in placed.where((F.col("bytes") > size) | F.col("page_id").isNull()).collect()}
    return firsts[1:].astype(np.int64), large


def _placed(rows: DataFrame, firsts: np.ndarray, large: dict[int | None, int]) -> DataFrame:
    """rows with shard and part; a page_id that fills shards of its own is split by url and digest."""
    named = np.array(sorted(i for i in large if i is not None), np.int64)
    counts = np.array([large[i] for i in named.tolist()] + [1], np.int64)

    @F.pandas_udf("shard int, parts int")
    def place(page_id: pd.Series) -> pd.DataFrame:
        ids = page_id.to_numpy()
        at = np.searchsorted(named, ids)
        there = (np.append(named, 0)[at] == ids) & (at < len(named))
        return pd.DataFrame({"shard": np.searchsorted(firsts, ids, side="right").astype("int32"), "parts": np.where(there, counts[at], 1).astype("int32")})

    last = F.struct(F.lit(len(firsts) + 1).alias("shard"), F.lit(large.get(None, 1)).alias("parts"))  # of pages without an id
    placed = rows.withColumn("place", F.when(F.col("page_id").isNull(), last).otherwise(place(F.coalesce("page_id", F.lit(0)))))
    return placed.withColumn("shard", F.col("place.shard")).withColumn("part", F.pmod(F.xxhash64("url", "digest"), F.col("place.parts")).cast("int")).drop("place")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, record_id: str, headers: dict[str, str | int | None], block: bytes) -> bytes:
    """One record: its version, headers in the given order, block digest and length, and the block."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(*parts: object) -> str:
    """A name-based id, of version 5's form, of what a record is about."""
    return str(uuid.UUID(bytes=hashlib.sha1("\0".join(map(repr, parts)).encode("utf-8", "surrogatepass")).digest()[:16], version=5))


def _target(url: str | None, page_id: int | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'' if page_id is None else page_id}"


def page_record(page_id, url, payload: bytes, digest: bytes, first: tuple | None, turn: int, date: str = DATE) -> bytes:
    """The record of a page. first: (page_id, url) of the response that a revisit refers to; turn: how many equal pages came before."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Target-URI": _target(url, page_id), "WARC-Date": date, "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{base32(digest)}"}
    own = record_id("page", page_id, url, digest, turn)
    if first is None:
        return record("response", own, headers | {"Content-Type": "application/http; msgtype=response"}, http + payload)
    refers = {
        "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{record_id('page', *first, digest, 0)}>", "WARC-Refers-To-Target-URI": _target(first[1], first[0]),
        "WARC-Refers-To-Date": date, "WARC-Refers-To-Page-ID": first[0], "Content-Type": "application/http; msgtype=response",
    }
    return record("revisit", own, headers | refers, http)


def member(data: bytes, level: int = LEVEL) -> bytes:
    """data as a gzip member without a time or name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roll:
    """The files of one shard. finish() closes the open one and returns its manifest row."""

    def __init__(self, root: str, prefix: str, shard: int, part: int, roll_bytes: int):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)
        self.prefix, self.shard, self.part, self.roll_bytes, self.file = prefix, shard, part, roll_bytes, -1
        self.out = None

    def open(self) -> None:
        self.file += 1
        self.name = f"{self.prefix}-{self.shard:06d}-{self.part:04d}-{self.file:05d}.warc.gz"
        self.temp = f"_attempts/{uuid.uuid4().hex}/{self.name}"
        self.fs.create_dir(f"{self.root}/{self.temp}".rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
        self.records, self.bytes, self.sum = 0, 0, hashlib.sha256()
        self.put(record("warcinfo", record_id("file", self.name), {"WARC-Date": DATE, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))

    def put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.sum.update(packed)
        self.bytes, self.records = self.bytes + len(packed), self.records + 1

    def add(self, data: bytes) -> list[tuple]:
        if self.out is None:
            self.open()
        self.put(data)
        return self.finish() if self.bytes >= self.roll_bytes else []

    def finish(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        return [(self.name, self.temp, self.shard, self.part, self.file, self.records, self.bytes, self.sum.hexdigest())]


def _writer(root: str, prefix: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, ruled, last, turn, first = None, None, None, 0, None
        for batch in batches:
            done: list[tuple] = []
            shards, parts, ids, urls, digests, kinds, first_ids, first_urls = (batch.column(c).to_pylist() for c in ("shard", "part", "page_id", "url", "digest", "kind", "first_id", "first_url"))
            payloads = batch.column("payload")
            for i, key in enumerate(zip(ids, urls, digests, strict=True)):
                if roll is None or (roll.shard, roll.part) != (shards[i], parts[i]):
                    done += roll.finish() if roll else []
                    roll, last = Roll(root, prefix, shards[i], parts[i], roll_bytes), None
                if not kinds[i]:
                    ruled, first = key, (first_ids[i], first_urls[i])
                    continue
                turn, last = (turn + 1 if key == last else 0), key
                again = ruled == key and (first != key[:2] or turn > 0)
                done += roll.add(page_record(*key[:2], payloads[i].as_py(), key[2], first if again else None, turn, date))
            yield _as_batch(done)
        yield _as_batch(roll.finish() if roll else [])

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _MANIFEST.split(", ")])


def _commit(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, temp, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temp", "bytes")), strict=True):
                there = fs.get_file_info(f"{top}/{name}")
                if there.type == pyarrow.fs.FileType.NotFound:
                    fs.move(f"{top}/{temp}", f"{top}/{name}")
                elif there.size != size:
                    raise OSError(f"{name} is there already, with {there.size} bytes")
            yield batch

    return run


def write(pages: DataFrame, root: str | None = None, prefix: str = "pages", least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> str:
    """Writes pages (page_id, url, html; other columns are ignored) as WARC files under root, a new folder of the shared one by default. Returns root.

    Null html is an empty payload, a null url becomes urn:page:<page_id>; null page_ids come last. Pages equal in all three columns have
    a record each: the first is a response, the others revisit it. Of payloads of least bytes or more only the first page's is written. An
    empty table gives an archive without files. A root that holds an archive already is refused.
    """
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark)}/agentmeter-warc-{uuid.uuid4().hex}"
    fs, top = pyarrow.fs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{top}/manifest").type != pyarrow.fs.FileType.NotFound:
        raise ValueError(f"{root} holds an archive already")
    rows = _rows(pages).withColumn("digest", F.unhex(F.sha1("payload")))
    slim = written(rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("bytes")), "warc-slim")
    firsts, large = cuts(slim, shard_bytes)
    ruled = decisions(slim, least).withColumn("payload", F.lit(None).cast("binary")).withColumn("kind", F.lit(0))
    whole = rows.withColumn("kind", F.lit(1)).withColumn("first_id", F.lit(None).cast("long")).withColumn("first_url", F.lit(None).cast("string"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(firsts) + sum(large.values()) + 1)
    dealt = _placed(whole.unionByName(ruled), firsts, large).repartition(tasks, "shard", "part")
    draft = written(dealt.sortWithinPartitions("shard", "part", *_order("kind")).mapInArrow(_writer(root, prefix, roll_bytes, date), _MANIFEST), "warc-draft")
    draft.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_commit(root), _MANIFEST).drop("temp").write.parquet(f"{root}/manifest")
    if fs.get_file_info(f"{top}/_attempts").type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(f"{top}/_attempts")
    return root


def manifest(spark, root: str) -> DataFrame:
    """The files of a finished archive: name, shard, part, file, records, bytes, sha256."""
    return spark.read.schema(_MANIFEST.replace("temp string, ", "")).parquet(f"{root}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member of a stream."""
    offset, buffer = 0, b""
    while True:
        buffer = buffer or stream.read(chunk)
        if not buffer:
            return
        packer, parts, size = zlib.decompressobj(31), [], 0
        while not packer.eof:
            buffer = buffer or stream.read(chunk)
            if not buffer:
                raise ValueError(f"the member at {offset} has no end")
            parts.append(packer.decompress(buffer))
            size, buffer = size + len(buffer) - len(packer.unused_data), packer.unused_data
        yield offset, b"".join(parts)
        offset += size


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block of a record, whose length and block digest must be right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    wanted = headers.get("warc-block-digest", "").removeprefix("sha1:")
    if wanted and wanted != base32(hashlib.sha1(block).digest()):
        raise ValueError("a block's digest is wrong")
    return headers, block


def _page(headers: dict[str, str], block: bytes, file: str, offset: int, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(headers[name]) if name in headers else None
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest != base32(hashlib.sha1(payload).digest()):
        raise ValueError("a payload's digest is wrong")
    size = len(payload) if kind == "response" else int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    url = headers["warc-target-uri"]
    kept = payload if with_payload and kind == "response" else None
    return number("warc-page-id"), None if url.startswith("urn:page:") else url, kind, size, digest, number("warc-refers-to-page-id"), headers["warc-record-id"][1:-1], file, offset, kept


class _Summed:
    """A stream that adds up what is read from it."""

    def __init__(self, stream):
        self.stream, self.sum = stream, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.sum.update(data)
        return data


def _reader(root: str, with_payload: bool):
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(root)
        for files in batches:
            for name, sha256 in zip(files.column("name").to_pylist(), files.column("sha256").to_pylist(), strict=True):
                rows, held = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    summed = _Summed(stream)
                    for offset, data in members(summed):
                        headers, block = parsed(data)
                        if headers["warc-type"] in ("response", "revisit"):
                            rows.append(_page(headers, block, name, offset, with_payload))
                            held += len(data)
                        if len(rows) >= 10_000 or with_payload and held >= 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                if summed.sum.hexdigest() != sha256:
                    raise ValueError(f"{name} isn't what the manifest says")
                yield batch(rows)

    return run


def read(spark, root: str, with_payload: bool = False) -> DataFrame:
    """The pages of a finished archive, each file's, block's and payload's digest checked: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to (page_id of a revisit's response), record_id, file, offset, payload (of responses, with_payload). A revisit's payload_bytes is what its HTTP header says."""
    files = manifest(spark, root)
    tasks = max(1, min(files.count(), 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(tasks).mapInArrow(_reader(root, with_payload), _READ)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes pages (see write()) and reads the files back: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset."""
    return read(pages.sparkSession, write(pages, **options)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH rows AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, row_number() OVER () AS r
  FROM pages),
ordered AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST, r) AS place FROM rows)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (((strpos('0123456789abcdef', substr(h, i * 5 // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, i * 5 // 4 + 2, 1)) - 1) >> (3 - i * 5 % 4)) & 31 AS BIGINT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_value(page_id) OVER (PARTITION BY h ORDER BY place) END AS refers_to
FROM ordered
"""
