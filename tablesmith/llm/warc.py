"""Deterministic sharded WARC writer, and the reader for what it wrote.

Shards are ranges of page ids whose borders follow from counts alone, so the same table gives the same files, byte
for byte. A task sorts its shards, writes every record as a gzip member of its own and starts a new file when the
compressed size reaches ``file_bytes``. Files are written under a temporary name of the attempt and renamed when they
are complete; a manifest, committed by Spark, lists them. Readers follow the manifest, so what lost or repeated
attempts leave behind is never seen.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesmith.session import checkpoint_dir

from .common import pick, small_batches, table, with_size_bound

#: Payload bytes of a shard, and compressed bytes at which a file is full.
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
#: Heavy shards up to this number are sent to every task; more are joined.
SENT_SHARDS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard string, records long, bytes long, sha256 string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """A response, or with a ``keeper`` the revisit of that page, which has the HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    headers = [
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if keeper is None:
        return warc_record("response", headers, http + payload)
    return warc_record("revisit", [*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(keeper)), ("X-Refers-To-Page-ID", str(keeper))], http)


class _Files:
    """The files of one task: opens, rolls and commits them, and keeps their manifest rows."""

    def __init__(self, folder: str, file_bytes: int, date: str) -> None:
        self.system, self.root = _filesystem(folder)
        context = TaskContext.get()
        self.scratch = f"{self.root}/_temporary/{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        self.system.create_dir(self.scratch, recursive=True)
        self.file_bytes, self.date = file_bytes, date
        self.stream, self.shard, self.number, self.rows = None, None, 0, []

    def add(self, shard: str, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.stream is None:
            self.name = f"{shard}-{self.number:05d}.warc.gz"
            self.stream = self.system.open_output_stream(f"{self.scratch}/{self.name}", compression=None)
            self.records, self.size, self.sum = 0, 0, hashlib.sha256()
            info = b"software: tablesmith\r\nformat: WARC File Format 1.1\r\n"
            self._put(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'file:' + self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def _put(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
        data = packer.compress(record) + packer.flush()
        self.stream.write(data)
        self.size += len(data)
        self.sum.update(data)

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.system.move(f"{self.scratch}/{self.name}", f"{self.root}/{self.name}")  # the same bytes, whoever comes last
        self.rows.append((self.name, self.shard, self.records, self.size, self.sum.hexdigest()))
        self.stream, self.number = None, self.number + 1

    def listed(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(c) for c in zip(*self.rows)], ["file", "shard", "records", "bytes", "sha256"])
            self.rows = []


def _write(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, page, keepers = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard, sub, page_id, digest, keeper, url, html, marker = (batch.column(c)[i].as_py() for c in range(8))
                files = files or _Files(folder, file_bytes, date)
                if page_id != page:
                    page, keepers = page_id, {}
                if marker:
                    keepers[digest] = keeper
                else:
                    files.add(f"pages-{shard:08d}-{sub:05d}", page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), keepers.get(digest), date))
            if files:
                yield from files.listed()
        if files:
            files.close()
            yield from files.listed()

    return run


def _shard_columns(pages: DataFrame, shard_bytes: int) -> tuple[Column, Column, DataFrame | None]:
    """Expressions for a page's shard and the part of it; the table of shards that are cut into parts, if any.

    Ids are dealt out as if bytes were spread evenly over them; a shard that got more than twice its share is cut
    into equal ranges once more.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 1
    low, high, total = pages.agg(F.min("page_id"), F.max("page_id"), F.sum(size)).first()
    low, high, total = low or 0, high or 0, total or 1
    width = max(1, -(-(high - low + 1) * shard_bytes // total))
    # In doubles ids far apart don't overflow, and larger ids still get the same shard or a later one.
    place = F.coalesce((F.col("page_id").cast("double") - float(low)) / float(width), F.lit(0.0))
    shard = F.floor(place)
    heavy = pages.groupBy(shard.alias("heavy_shard")).agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > 2 * shard_bytes)
    heavy = heavy.select("heavy_shard", F.ceil(F.col("bytes") / shard_bytes).alias("cuts"))
    within = F.floor((place - F.floor(place)) * F.coalesce("cuts", F.lit(1)))
    return shard, within, None if heavy.isEmpty() else heavy


def write_archives(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files and a manifest under ``folder``.

    Pages with equal payloads of at least ``min_bytes`` bytes: the one with the largest page_id is a response, the
    others are revisits of it. Rows that share that page_id too are all responses. A null html is an empty payload, a
    null url is about:blank, a null page_id sorts first. Further columns are ignored. An empty table writes an empty manifest.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    light = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= min_bytes)
    keepers = light.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("digest", "keeper")
    revisits = light.join(keepers, "digest").filter("page_id < keeper or page_id is null and keeper is not null").select("page_id", "digest", "keeper").distinct()

    shard, within, heavy = _shard_columns(pages, shard_bytes)
    columns = ["page_id", "digest", "keeper", "url", "html", "marker"]
    rows = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.lit(None).cast("long").alias("keeper"), "url", "html", F.lit(False).alias("marker"))
    marks = revisits.select("page_id", "digest", "keeper", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(True).alias("marker"))
    rows = rows.unionByName(marks).withColumn("shard", shard)
    if heavy is None:
        rows = rows.withColumn("cuts", F.lit(None).cast("long"))
    else:
        rows = rows.join(F.broadcast(heavy) if with_size_bound(heavy, SENT_SHARDS) else heavy, F.col("shard") == F.col("heavy_shard"), "left")
    rows = rows.withColumn("sub", within).select("shard", "sub", *columns)
    ordered = rows.repartition("shard", "sub").sortWithinPartitions("shard", "sub", F.col("page_id"), F.col("marker").desc(), "digest", "url")
    ordered.mapInArrow(_write(folder, file_bytes, date), _MANIFEST).write.parquet(f"{folder}/_manifest")
    system, root = _filesystem(folder)
    if system.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        system.delete_dir(f"{root}/_temporary")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in a stream of WARC text."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if headers.get("warc-block-digest", "").removeprefix("sha1:") != sha1_base32(block):
            raise ValueError(f"block digest of {headers.get('warc-record-id')} doesn't fit")
        yield headers, block


_READ = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str, with_payload: bool):
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def rows(name: str) -> Iterator[tuple]:
        system, root = _filesystem(folder)
        with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for headers, block in _records(stream):
                kind = headers["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(line.partition(b":")[2]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (size != len(payload) or digest != sha1_base32(payload)):
                    raise ValueError(f"payload of {headers['warc-record-id']} doesn't fit its headers")
                html = payload.decode("utf-8", "surrogatepass") if with_payload and kind == "response" else None
                yield number(headers["x-page-id"]), headers["warc-target-uri"], html, size, digest, kind, number(headers.get("x-refers-to-page-id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if n in ("url", "html", "payload_digest", "record_type") else pa.int64()) for n in names])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                for row in rows(name):
                    held.append(row)
                    size += 200 + len(row[2] or "")
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Pages from the files that the manifest under ``folder`` lists; digests and lengths are checked on the way.

    ``html`` is null for revisits, whose payload is that of ``refers_to``.
    """
    small_batches(spark)
    listed = spark.read.parquet(f"{folder}/_manifest").select("file")
    # A number of tasks that is asked for stays: the manifest is tiny, the files behind its rows are not.
    listed = listed.repartition(max(1, listed.count()), "file")
    return listed.mapInArrow(_read(folder, with_payload), _READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op2_warc": (op2_warc, None)}
