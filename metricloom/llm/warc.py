"""Web pages as WARC files: written in shards, committed by a manifest, and read back.

Pages are range-sorted by id into shards of about ``shard_bytes`` of payload; the bounds follow from the pages alone, so the
same pages give the same files on any cluster. A task writes its shards one record after another, each a gzip member of its
own, and begins a new file when the compressed size reaches ``file_bytes``. Headers, record ids and digests are made anew
from the record. Files get temporary names; the names that successful tasks return are moved into place, and the manifest
that lists them is written last. A lost task leaves only a temporary file that nothing refers to, and a path without a
manifest is not an archive.

Of records with equal payloads the one with the largest page id is a response, the others are revisits of it; payloads of
fewer than ``least`` bytes are never revisits. Inputs: a null html is an empty payload, a null url becomes ``urn:page:<id>``;
pages without an id come first and are revisits if any page with an id has the same payload, else responses. Rows with
the same id and payload are records of their own and equally response or revisit. Line breaks in urls are percent-encoded.
Other columns are ignored. The target file system is any that Arrow opens by its address.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metricloom.llm.ranks import running_sum
from metricloom.llm.tables import settle

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for gzip members; their time stamp is 0
HEADER_BYTES = 512
MANIFEST = "shard int, roll int, name string, temporary string, records bigint, bytes bigint, sha1 string"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def target(page_id: int | None, url: str | None) -> str:
    return (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")


def lines(*pairs: tuple[str, object]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in pairs if value is not None).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, str | None] | None, date: str) -> bytes:
    """One WARC record, not compressed; ``refers`` is the id and url of the page that a revisit points to."""
    digest, uri = base32(hashlib.sha1(payload).digest()), target(page_id, url)
    http = b"HTTP/1.1 200 OK\r\n" + lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload)))
    block = http + b"\r\n" + (b"" if refers else payload)
    about = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(page_id, uri, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Page-Id", page_id),
    ]
    if refers:
        there = target(*refers)
        about += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers[0], there, digest)),
            ("WARC-Refers-To-Target-URI", there),
            ("WARC-Refers-To-Date", date),
            ("Refers-To-Page-Id", refers[0]),
        ]
    about += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + lines(*about) + b"\r\n" + block + b"\r\n\r\n"


def first_record(name: str, date: str) -> bytes:
    block = lines(("software", "metricloom"), ("format", "WARC File Format 1.1"))
    about = lines(
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", date),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    )
    return b"WARC/1.1\r\n" + about + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes one shard after another to temporary files, and begins a new file when one is full."""

    def __init__(self, path: str, file_bytes: int, level: int, date: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path)
        self.limit, self.level, self.date = file_bytes, level, date
        self.shard, self.roll, self.stream = -1, 0, None
        self.done: list[dict] = []

    def _put(self, data: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, GZIP)
        member = packer.compress(data) + packer.flush()
        self.stream.write(member)
        self.digest.update(member)
        self.row["bytes"] += len(member)

    def add(self, shard: int, data: bytes) -> None:
        if self.stream is not None and (shard != self.shard or self.row["bytes"] >= self.limit):
            self.close()
        if self.stream is None:
            self.roll = self.roll + 1 if shard == self.shard else 0
            self.shard = shard
            name = f"part-{shard:06d}-{self.roll:05d}.warc.gz"
            self.row = {"shard": shard, "roll": self.roll, "name": name, "records": 0, "bytes": 0}
            self.row["temporary"] = f"_temporary/{uuid.uuid4().hex}"
            self.digest = hashlib.sha1()
            self.stream = self.files.open_output_stream(f"{self.root}/{self.row['temporary']}")
            self._put(first_record(name, self.date))
        self._put(data)
        self.row["records"] += 1

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append({**self.row, "sha1": self.digest.hexdigest()})
            self.stream = None


def _revisits(narrow: DataFrame, least: int) -> DataFrame:
    """page_id, digest, refers_to and its url, for pages whose payload a page with a larger id has."""
    many = narrow.filter(F.col("size") >= least).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("times")
    )
    many = many.filter("times > 1 and last.page_id is not null").select("digest", "last")
    pairs = narrow.select("page_id", "digest").join(many, "digest")
    pairs = pairs.filter(~F.col("page_id").eqNullSafe(F.col("last.page_id")))
    return pairs.select("page_id", "digest", F.col("last.page_id").alias("ref"), F.col("last.url").alias("ref_url")).distinct()


def _shard_starts(narrow: DataFrame, shard_bytes: int) -> list[int]:
    """The smallest id of every shard but the first: one number for each ``shard_bytes`` of pages, ascending."""
    sizes = narrow.filter("page_id is not null").groupBy("page_id").agg(F.sum(F.col("size") + HEADER_BYTES).alias("size"))
    placed = running_sum(sizes, [], ["page_id"], F.col("size"), "before")
    shards = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min("page_id").alias("start"))
    return sorted(r["start"] for r in shards.collect())[1:]


def _shard(page_id: Column, starts: list[int]) -> Column:
    """How many of the ascending ``starts`` are not above the id, by halving: one step per power of two."""
    if not starts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(starts).bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        fits = F.coalesce(F.get(bounds, found + step - 1) <= page_id, F.lit(False))
        return found + F.when(fits, step).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), halve)


def write(
    pages: DataFrame,
    path: str,
    shard_bytes: int = 64 << 20,
    file_bytes: int = 32 << 20,
    least: int = 0,
    level: int = 6,
    date: str = DATE,
) -> None:
    """Write page_id, url and html to a new archive at ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    narrow = settle(narrow, "page-digests")
    starts = _shard_starts(narrow, shard_bytes)
    # what is known about a revisit travels before its page, so the pages move only once
    nothing = F.lit(None)
    about = _revisits(narrow, least).select(
        "page_id", "digest", F.lit(0).alias("order"), nothing.cast("string").alias("url"),
        nothing.cast("binary").alias("payload"), "ref", "ref_url",
    )
    body = rows.select(
        "page_id", "digest", F.lit(1).alias("order"), "url", "payload",
        nothing.cast("bigint").alias("ref"), nothing.cast("string").alias("ref_url"),
    )
    both = about.union(body).withColumn("shard", _shard(F.col("page_id"), starts))
    both = both.repartitionById(len(starts) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "order", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, refers = Roller(path, file_bytes, level, date), None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, digest, order, url, data, ref, ref_url, shard = row
                if order == 0:
                    known, refers = (page_id, digest), (ref, ref_url)
                else:
                    mine = refers if known == (page_id, digest) else None
                    out.add(shard, record(page_id, url, data, mine, date))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_pylist(out.done, SCHEMA)

    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(f"{root}/_temporary")
    _commit(settle(both.mapInArrow(run, MANIFEST), "warc-manifest"), path)


SCHEMA = pa.schema([
    ("shard", pa.int32()), ("roll", pa.int32()), ("name", pa.string()), ("temporary", pa.string()),
    ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()),
])


def _commit(manifest: DataFrame, path: str) -> None:
    """Move the files of successful tasks into place, then write the manifest; can be repeated after a loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if files.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
                elif files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{temporary}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    manifest.select("name", "temporary").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    manifest.drop("temporary").write.parquet(f"{path}/_manifest")
    files, root = fs.FileSystem.from_uri(path)
    files.delete_dir(f"{root}/_temporary")


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The records of a file, one gzip member each."""
    unpacker, parts, begun = zlib.decompressobj(GZIP), [], False
    while chunk := stream.read(1 << 16):
        while chunk:
            begun = True
            parts.append(unpacker.decompress(chunk))
            chunk = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts, begun = zlib.decompressobj(GZIP), [], False
    if begun:
        raise ValueError("the file ends within a record")


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields after the first line, by small letters, and what follows them."""
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {p[0].lower(): p[1] if len(p) > 1 else "" for p in pairs}, rest


def parse(data: bytes) -> dict | None:
    """A page's record, its digests checked; None for other records."""
    about, rest = headers(data)
    if about["warc-type"] not in ("response", "revisit"):
        return None
    block = rest[: int(about["content-length"])]
    if base32(hashlib.sha1(block).digest()) != about["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {about['warc-record-id']}")
    http, payload = headers(block)
    digest = about["warc-payload-digest"].removeprefix("sha1:")
    if about["warc-type"] == "response" and base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"payload digest of {about['warc-record-id']}")
    number = about.get("page-id"), about.get("refers-to-page-id")
    return {
        "page_id": None if number[0] is None else int(number[0]),
        "url": about["warc-target-uri"],
        "record_type": about["warc-type"],
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "refers_to": None if number[1] is None else int(number[1]),
        "payload": payload if about["warc-type"] == "response" else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All page records of a committed archive; ``payloads`` adds the payload of responses."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    tasks = max(1, min(manifest.count(), 10_000))  # a task per file, or more files to a task
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payloads
    schema = pa.schema(list(zip(names, kinds + [pa.binary()] * payloads)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        if (row := parse(data)) is not None:
                            rows.append({n: row[n] for n in names})
                            held += len(data) if payloads else 0
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    listed = manifest.select("name").repartition(tasks, "name")
    return listed.mapInArrow(run, RECORD + ", payload binary" * payloads)
