"""Deterministic sharded WARC archives: one compressed record per page.

Records are range-sorted by id, files roll by their compressed size, headers and digests are
made anew, and files appear under temporary names that a manifest then commits. What a reader
sees is what the manifest lists; files of failed or repeated tasks are in no manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Steps, range_borders, shuffle_partitions

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of names that are URLs

LEAST_SHARED = 100  # bytes; equal payloads below this are all kept whole
FILE_BYTES = 128 << 20
SHARD_BYTES = 512 << 20  # of payloads; a shard is one task
MOST_SHARDS = 16_384  # their borders are in the plan; beyond that tasks, which stream, get longer
READ = 1 << 20
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "shard int, roll int, temporary string, file string, bytes bigint, sha256 string, records bigint"
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, file string, position bigint"
)


def revisits(rows: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, digest and `refers_to` of the pages that repeat a payload of a smaller page_id.

    Takes page_id, digest and payload_bytes. The smallest id of a digest is found with map-side
    combine, and the join has one row per digest on one side, so a hot one can be split.
    """
    slim = rows.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    shared = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    return (
        slim.distinct().join(shared.filter("refers_to < last").drop("last"), "digest")
        .filter("page_id > refers_to").select("page_id", "digest", "refers_to")
    )


def header_text(text: str) -> bytes:
    """A header value in one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text).encode()


def record_id(page_id: int | None, digest: str) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>".encode()


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + record_id(page_id, digest),
        b"WARC-Date: " + date.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + header_text(url))
    if page_id is not None:
        head.append(b"Page-Id: %d" % page_id)
    if refers_to is not None:
        head += [
            b"WARC-Profile: " + REVISIT_PROFILE,
            b"WARC-Refers-To: " + record_id(refers_to, digest),
            b"Refers-To-Page-Id: %d" % refers_to,
        ]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as a URI with its store: a plain path is in the store that Spark would write it to.

    That store may be a file system mounted on all executors, as Spark's own tables need it then.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    return path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def shard_count(rows: DataFrame, least: int, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for the bytes in the column payload_bytes, at least as many as asked for."""
    total = rows.agg(F.sum("payload_bytes")).first()[0] or 0
    return min(max(least, -(-total // shard_bytes)), MOST_SHARDS)


def shard_of(borders: list[int], value: Column) -> Column:
    """How many of the sorted borders a value has reached, found by halving; 0 for null."""
    if not borders:
        return F.lit(0)
    steps = [1 << k for k in range(len(borders).bit_length() - 1, -1, -1)]
    all_borders = F.lit(borders).cast("array<bigint>")
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda n, step: F.when(F.get(all_borders, n + step - 1) <= value, n + step).otherwise(n),
    )


def opened(folder: str):
    """File system and path of a folder, given as a plain path or a URI."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class _File:
    """One archive file under its temporary name."""

    def __init__(self, store, folder: str, shard: int, roll: int, attempt: str):
        self.name = f"pages-{shard:05d}-{roll:04d}.warc.gz"
        self.temporary = f"_temporary/{attempt}-{self.name}"
        self.shard, self.roll, self.size, self.records = shard, roll, 0, 0
        self.digest = hashlib.sha256()
        self.out = store.open_output_stream(f"{folder}/{self.temporary}")

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.roll, self.temporary, self.name, self.size, self.digest.hexdigest(), self.records


def _written(folder: str, file_bytes: int, date: str):
    schema = pa.schema([
        ("shard", pa.int32()), ("roll", pa.int32()), ("temporary", pa.string()), ("file", pa.string()),
        ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        current, refers, done = None, None, []
        for batch in batches:
            for shard, page_id, digest, refers_to, is_page, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_page:  # comes right before the pages of its id and digest
                    refers = (page_id, digest, refers_to)
                    continue
                target = refers[2] if refers and refers[:2] == (page_id, digest) else None
                member = compressed(record(page_id, url, text, digest, target, date))
                if current and (current.shard != shard or current.size + len(member) > file_bytes):
                    done.append(current.close())
                    current = _File(store, root, shard, current.roll + 1 if current.shard == shard else 0, attempt)
                current = current or _File(store, root, shard, 0, attempt)
                current.add(member)
        if current:
            done.append(current.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def _renamed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = opened(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                if store.get_file_info(f"{root}/{temporary}").type == fs.FileType.File:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise OSError(f"{temporary} is gone and {name} is not there")
            yield batch

    return run


def write_warc(
    pages: DataFrame, folder: str, shards: int | None = None, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES,
    id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = DATE,
) -> DataFrame:
    """Write one record per row below `folder` and return the manifest: one row per file.

    Of records with equal payloads of at least 100 bytes, that with the smallest id is a response
    and the others revisit it; rows that repeat the smallest id, and rows with a null id, are
    responses. A null payload is empty, a null url gives no target header. An empty table gives
    an empty manifest. Other columns are not read. The same rows and shards always give the same bytes.
    Shards are as many as the payloads need, and at least the session's shuffle partitions. What failed
    tasks left under temporary names goes once the manifest is written.

    Pages are shuffled once: the small table of revisits goes through the same shuffle and comes
    right before the pages of its id and digest.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.sha2(text, 256).alias("digest"),
        F.octet_length(text).alias("payload_bytes"), F.lit(None).cast("bigint").alias("refers_to"),
        F.lit(True).alias("is_page"), F.col(url_col).cast("string").alias("url"), text.alias("text"),
    )
    shards = shards or shard_count(rows, shuffle_partitions(spark), shard_bytes)
    borders = range_borders(pages, id_col, shards)
    found = revisits(rows).select(
        "page_id", "digest", "refers_to", F.lit(False).alias("is_page"),
        F.lit(None).cast("string").alias("url"), F.lit("").cast("binary").alias("text"),
    )
    both = rows.drop("payload_bytes").unionByName(found)
    dealt = (
        both.select(shard_of(borders, F.col("page_id")).alias("shard"), *both.columns)
        .repartition(len(borders) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    )
    steps = Steps(spark)
    manifest = steps.write(dealt.mapInArrow(_written(folder, file_bytes, date), MANIFEST), "warc-written")
    named = manifest.repartition(F.col("file")).mapInArrow(_renamed(folder), MANIFEST)
    named.write.parquet(f"{folder}/_manifest")
    steps.remove(f"{folder}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _members(store, path: str) -> Iterator[tuple[int, bytes]]:
    """Position and content of each gzip member of a file, read in pieces."""
    with store.open_input_stream(path) as source:
        unpacker, parts, position, read, rest = zlib.decompressobj(31), [], 0, 0, b""
        while True:
            chunk = rest or source.read(READ)
            if not chunk:
                if parts:
                    raise OSError(f"{path} ends within a record")
                return
            read += 0 if rest else len(chunk)
            parts.append(unpacker.decompress(chunk))
            rest = unpacker.unused_data
            if unpacker.eof:
                yield position, b"".join(parts)
                unpacker, parts, position = zlib.decompressobj(31), [], read - len(rest)


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP headers and payload of a record; its block digest must hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a record of this version")
    headers = dict(line.decode().split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if tail != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _read(folder: str, with_payload: bool):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "file", "position"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def one(name: str, position: int, member: bytes) -> tuple:
        headers, http, payload = parsed(member)
        whole = int(http.rpartition(b"Content-Length: ")[2])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload) != whole or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
        number = lambda key: int(headers[key]) if key in headers else None
        return (
            number("Page-Id"), headers.get("WARC-Target-URI"), kind, number("Refers-To-Page-Id"), whole, digest,
            payload if with_payload and kind == "response" else None, name, position,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                for position, member in _members(store, f"{root}/{name}"):
                    rows.append(one(name, position, member))
                    held += 200 + len(rows[-1][6] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the committed files, with digests checked; a file is read by one task.

    `payload` is null for revisits, and for all if it is not asked for.
    """
    folder = qualified(spark, folder)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    return files.repartition(F.col("file")).mapInArrow(_read(folder, with_payload), RECORD)
