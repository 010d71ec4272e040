"""WARC archives: writing them, normalising whole-file gzip, reading them by an offset index.

A monolithic archive is one gzip member around all its records: to reach the last record, all before
it must be inflated. The normaliser inflates such a stream once, in chunks, rewrites every record as
a gzip member of its own and writes a sidecar index with each member's offset and length, so that a
reader can seek to one record. Archives are cut at ARCHIVE_BYTES of records, so a task's memory does
not depend on the input.

Files go to the folder given, through the file system of its URI. Every attempt of a task writes under
names of its own, and what is read later are only the names in the staged table of archives, which holds
those of the attempts that Spark committed: what a lost or doubled attempt leaves is never read.

Cases: null html is an empty payload; a null page_id or url is written as an empty header and read
back as null; rows that repeat a page_id get a record each; an empty table gives no archive and an
empty result; other columns are ignored."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, stage

#: Payloads under this length are never revisits.
LEAST_BYTES = 1000
#: An archive is closed when its records exceed this.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def place(uri: str):
    """The file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def _put(uri: str, name: str, data: bytes) -> None:
    system, folder = place(uri)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
        out.write(data)


def compose(record: dict) -> bytes:
    """The bytes of one record. A revisit has the head of the response and no payload."""
    body = HTTP_HEAD + (record["payload"] if record["type"] == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record['type']}",
        f"WARC-Record-ID: <urn:page:{record['id']}>",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(record['sha1']).decode()}",
        f"X-Payload-Length: {record['length']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if record["type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{record['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The fields of one record."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    number = lambda x: int(x) if x else None
    payload = body.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    whole = fields["WARC-Type"] != "response" or hashlib.sha1(payload).digest() == digest and len(payload) == int(fields["X-Payload-Length"])
    return {
        "page_id": number(fields["WARC-Record-ID"][len("<urn:page:") : -1]),
        "url": fields["WARC-Target-URI"] or None,
        "record_type": fields["WARC-Type"],
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest.hex(),
        "refers_to": number(fields.get("WARC-Refers-To", "<urn:page:>")[len("<urn:page:") : -1]),
        "payload": payload if fields["WARC-Type"] == "response" else None,
        "whole": whole,
    }


def records_of(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with payload, its SHA-1 and length, record type and the page that a revisit refers to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.withColumns({"sha1": F.unhex(F.sha1("payload")), "length": F.octet_length("payload").cast("long")})
    groups = keyed.filter(F.col("length") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = stage(groups.filter("n > 1"), "payloads")
    kept = attach(keyed, groups, ["sha1"], "n", ["page_id"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")) & (F.col("length") >= least)
    return kept.select("page_id", "url", "payload", "sha1", "length", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("last")).alias("refers_to"))


def _writer(folder: str):
    def run(batches):
        attempt, number, held, size = uuid.uuid4().hex[:16], 0, [], 0

        def close():
            name = f"part-{TaskContext.get().partitionId():06d}-{attempt}-{number:04d}.warc.gz"
            _put(folder, name, gzip.compress(b"".join(held), 6, mtime=0))
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(held)], pa.int64())})

        empty = lambda x: "" if x is None else x
        for batch in batches:
            for page, url, payload, sha1, length, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                clean = empty(url).replace("\r", "%0D").replace("\n", "%0A")
                held.append(compose({"id": empty(page), "url": clean, "payload": payload, "sha1": sha1, "length": length, "type": kind, "refers_to": empty(refers)}))
                size += len(held[-1])
                if size > ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as monolithic .warc.gz files; returns a row for each archive."""
    return stage(records.mapInArrow(_writer(folder), "archive string, records bigint"), "archives")


def archives_in(folder: str, spark) -> DataFrame:
    """The names of all archives that lie in a folder, for archives from elsewhere."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"))


def _dealt(archives: DataFrame) -> DataFrame:
    """The names, few to a task: a name is small, but what it names isn't."""
    spark = archives.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(max(1, min(archives.count(), tasks)), "archive")


def split_stream(chunks):
    """The records of a gzip stream given in chunks, inflated once and a chunk at a time."""
    inflate, held, need, scanned = zlib.decompressobj(31), bytearray(), None, 0

    def pieces():
        nonlocal inflate
        for data in chunks:
            while data:
                yield inflate.decompress(data, CHUNK)
                if inflate.eof:  # members one after another are one stream as well
                    data, inflate = inflate.unused_data, zlib.decompressobj(31)
                else:
                    data = inflate.unconsumed_tail
        yield inflate.flush()

    for piece in pieces():
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", max(0, scanned - 3))
                if end < 0:
                    scanned = len(held)
                    break
                need = end + 8 + int(bytes(held[:end]).rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need, scanned = None, 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def _chunks(system, path: str):
    with system.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            yield data


def _normaliser(source: str, folder: str):
    def run(batches):
        system, at = place(source)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                out, index = bytearray(), []
                for record in split_stream(_chunks(system, f"{at}/{archive}")):
                    member = gzip.compress(record, 6, mtime=0)
                    fields = parse(record)
                    index.append({"offset": len(out), "length": len(member), "page_id": fields["page_id"], "digest": fields["payload_digest"], "type": fields["record_type"]})
                    out += member
                name = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:16]}.warc.gz"
                _put(folder, name, bytes(out))
                _put(folder, name.removesuffix(".warc.gz") + ".idx", "".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([len(out)], pa.int64())})

    return run


def normalise(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrites the named archives of the folder source, one member a record, with sidecar indexes; a row for each new archive."""
    return stage(_dealt(archives).mapInArrow(_normaliser(source, folder), "archive string, records bigint, bytes bigint"), "normalised")


KINDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "whole": pa.bool_()}


def _reader(folder: str):
    def run(batches):
        system, at = place(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{at}/{archive.removesuffix('.warc.gz')}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                with system.open_input_file(f"{at}/{archive}") as f:
                    for i in range(0, len(entries), 200):
                        rows = [parse(gzip.decompress(f.read_at(x["length"], x["offset"]))) for x in entries[i : i + 200]]
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in KINDS.items()})

    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the named normalised archives, each inflated on its own at the offset that the index gives."""
    return _dealt(archives).mapInArrow(_reader(folder), "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, whole boolean")


def roundtrip(pages: DataFrame, least: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Writes pages to archives, normalises them and reads the records back."""
    spark = pages.sparkSession
    folder = folder or fresh(spark, "warc")
    archives = write_archives(records_of(pages, least), f"{folder}/monolithic")
    return verified(read_archives(normalise(archives, f"{folder}/monolithic", f"{folder}/records"), f"{folder}/records"))


def verified(records: DataFrame) -> DataFrame:
    """records; fails on a response whose payload, as read, hasn't the length and digest of its header."""
    broken = F.raise_error(F.concat(F.lit("payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" was altered")))
    return records.withColumn("payload_digest", F.when(F.col("whole"), F.col("payload_digest")).otherwise(broken.cast("string")))
