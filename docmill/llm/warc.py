"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (page_id, payload digest). Shard borders come from a histogram of page_id by
bytes, not from a sample, so that the same table gives the same files, byte for byte, however it is
partitioned; a page_id that is too heavy for a shard is dealt to several by digest. Within a shard, files roll at a compressed size. Every record is a gzip member of its own with
headers and digests made anew from its payload. Of records with equal payloads of ``REVISIT_BYTES`` or more,
the one with the largest page_id is a response and the others are revisits that name it.

A task writes each file under a temporary name and reports it; Spark commits the reports of the attempts that
counted. A second step renames those files and commits the manifest, which alone says what the archive
holds. A lost executor leaves temporary files behind at most.

The payload travels through one shuffle. Which record a revisit names is found on narrow rows, which meet
their payload by sorting next to it, so that a payload that many pages share gathers nowhere.

Defined cases: null html is an empty payload; a null url is written as ``urn:page:ID``; rows without page_id
come first, and are revisits of a shared payload if any row that has it has a page_id, else responses; of rows that
repeat the largest page_id of a payload, the first by url is the response and the others revisit it; an
empty table writes no file; further columns are ignored. The folder must be one that pyarrow.fs opens.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.shared import new_path, save

#: Payload bytes of a shard at least, and how many shards there may be, which makes them larger.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 100_000
#: Compressed size at which a file is closed.
ROLL_BYTES = 64 << 20
REVISIT_BYTES = 1000
CELLS, FINER_CELLS = 16_384, 1024
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20

MANIFEST = "shard int, name string, n_records long, n_bytes long, sha1 string"
ATTEMPTS = "shard int, name string, temporary string, n_records long, n_bytes long, sha1 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def borders(rows: DataFrame, least: int = SHARD_BYTES) -> list[tuple[int | None, int]]:
    """First page_id of each run of shards (null for rows without one, which come first) and how many shards it has,
    from rows (page_id, n_bytes). Only a page_id that alone is heavy has several, which its digests are dealt to.
    """
    low, high, total, unnamed = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("n_bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("n_bytes")))).first()
    target = max(least, -(-(total or 0) // MOST_SHARDS))
    parts = lambda n: max(1, -(-n // target))
    out: list[tuple[int | None, int]] = [] if unnamed is None else [(None, parts(unnamed))]
    if low is None:
        return out
    width = max(1, -(-(high - low + 1) // CELLS))
    spans: list[tuple[int, int, int]] = []
    open_ = rows.filter(F.col("page_id").isNotNull()).select("page_id", "n_bytes", F.lit(low).cast("long").alias("low"), F.lit(width).cast("long").alias("width"))
    while True:
        at = F.floor((F.col("page_id") - F.col("low")) / F.col("width")).cast("long")
        # A bounded histogram: CELLS, and then some for each shard.
        cells = open_.groupBy("low", "width", at.alias("cell")).agg(F.sum("n_bytes").alias("n")).toArrow().to_pylist()
        heavy = [r for r in cells if r["n"] > 2 * target and r["width"] > 1]
        spans += [(r["low"] + r["cell"] * r["width"], r["width"], r["n"]) for r in cells if not (r["n"] > 2 * target and r["width"] > 1)]
        if not heavy:
            break
        finer = rows.sparkSession.createDataFrame(
            [(r["low"], r["width"], r["cell"], r["low"] + r["cell"] * r["width"], max(1, -(-r["width"] // min(FINER_CELLS, 4 * parts(r["n"]))))) for r in heavy],
            "low long, width long, cell long, new_low long, new_width long",
        )
        open_ = open_.withColumn("cell", at).join(F.broadcast(finer), ["low", "width", "cell"]).select(
            "page_id", "n_bytes", F.col("new_low").alias("low"), F.col("new_width").alias("width")
        )
    held = 0
    for first, width, n in sorted(spans):
        alone = width == 1 and n > 2 * target
        if alone or not held or held + n > target:
            out.append((first, parts(n) if alone else 1))
            held = 0
        held = target if alone else held + n
    return out


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    head += f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit if ``refers_to`` names a response, as a gzip member."""
    digest = hashlib.sha1(payload).hexdigest()
    target = f"urn:page:{page_id}" if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|^{}\"<>\\`")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to is None:
        return _record(headers, http + payload)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(refers_to, digest)),
        ("X-Refers-To-Page-Id", refers_to),
    ]
    return _record(headers, http)


class _Roll:
    """The files of one shard, one after another."""

    def __init__(self, file_system: pafs.FileSystem, folder: str, shard: int, most: int):
        self.fs, self.folder, self.shard, self.most, self.nth, self.out = file_system, folder, shard, most, 0, None

    def write(self, member: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(member) > self.most:
            yield self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.nth:04d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.count, self.sha1, self.nth = 0, 0, hashlib.sha1(), self.nth + 1
            info = f"software: docmill\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
            self.count = 0
        self._put(member)

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha1.update(member)
        self.size += len(member)
        self.count += 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        return self.shard, self.name, self.temporary, self.count, self.size, self.sha1.hexdigest()


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "n_records": pa.int64(), "n_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to WARC files in ``folder``; returns the manifest as committed."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")}
    )
    narrow = save(wide.select("page_id", "digest", "n_bytes"), "warc-narrow")
    runs = spark.sparkContext.broadcast(borders(narrow, shard_bytes))
    n_shards = sum(parts for _, parts in runs.value) or 1

    @F.pandas_udf("int")
    def shard(ids: pd.Series, unnamed: pd.Series, place: pd.Series) -> pd.Series:
        named = [(first, parts) for first, parts in runs.value if first is not None]
        ahead = sum(parts for first, parts in runs.value if first is None)
        parts = np.array([ahead, *(p for _, p in named)], dtype=np.int64)
        nth = np.where(unnamed, 0, np.searchsorted(np.array([f for f, _ in named], dtype=np.int64), ids.to_numpy(), "right"))
        return pd.Series((np.cumsum(parts) - parts)[nth] + place.to_numpy() * parts[nth] // 65_536).astype("int32")

    # Where a digest stands among all: its first 16 bits.
    place = F.conv(F.left("digest", F.lit(4)), 16, 10).cast("int")
    number = shard(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), place)
    shared = narrow.filter(F.col("n_bytes") >= REVISIT_BYTES)
    named = shared.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
    marks = shared.join(named.drop("n"), "digest").filter(F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True))).distinct()
    # A mark sorts in front of the record that it makes a revisit.
    both = wide.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    )
    order = ["shard", F.col("page_id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first()]
    sorted_ = both.withColumn("shard", number).repartition(n_shards, "shard").sortWithinPartitions(*order)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, path = pafs.FileSystem.from_uri(folder)
        file_system.create_dir(f"{path}/_temporary", recursive=True)
        roll, mark, names = None, (None, None, None), [c.split()[0] for c in ATTEMPTS.split(", ")]
        last = (None, None)  # of the response before
        for batch in batches:
            done = []
            columns = [batch.column(c) for c in ("shard", "page_id", "digest", "kind", "url", "payload", "refers_to")]
            for i in range(len(batch)):
                number, page_id, digest, kind, url, content, refers_to = (c[i].as_py() for c in columns)
                if not kind:
                    mark = (page_id, digest, refers_to)
                    continue
                if roll is None or roll.shard != number:
                    if roll is not None:
                        done.append(roll.close())
                    roll = _Roll(file_system, path, number, roll_bytes)
                again = last == (page_id, digest) and page_id is not None and len(content) >= REVISIT_BYTES
                refers_to = mark[2] if mark[:2] == (page_id, digest) else page_id if again else None
                done += roll.write(page_record(page_id, url, content, refers_to))
                last = (page_id, digest)
            if done:
                yield _batch(done, names)
        if roll is not None:
            yield _batch([roll.close()], names)

    attempts = save(sorted_.mapInArrow(written, ATTEMPTS), "warc-attempts")

    def committed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{path}/{row['temporary']}", f"{path}/{row['name']}"
                if file_system.get_file_info(source).type == pafs.FileType.File:
                    file_system.move(source, target)
                elif file_system.get_file_info(target).size != row["n_bytes"]:  # else an earlier attempt has renamed it
                    raise OSError(f"neither {source} nor a whole {target} is there")
            yield batch

    manifest = f"{folder}/_manifest"
    _dealt(attempts).mapInArrow(committed, ATTEMPTS).drop("temporary").write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _dealt(files: DataFrame) -> DataFrame:
    """One file a partition, up to MOST_SHARDS; by number, so that they aren't merged again."""
    return files.repartition(max(1, min(files.count(), MOST_SHARDS)))


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    opened, parts = None, []
    while chunk := stream.read(READ_BYTES):
        while chunk:
            if opened is None:
                opened, parts = zlib.decompressobj(31), []
            parts.append(opened.decompress(chunk))
            if not opened.eof:
                break
            chunk = opened.unused_data
            opened = None
            yield b"".join(parts)
    if opened is not None:
        raise OSError("a gzip member ends early")


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(member: bytes) -> tuple | None:
    """A row of ``RECORDS`` without its file; None for a warcinfo. Digests are made anew and must agree."""
    head, rest = member.split(b"\r\n\r\n", 1)
    h = _headers(head)
    block = rest[: int(h["Content-Length"])]
    if h["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
    if h["WARC-Type"] == "warcinfo":
        return None
    number = lambda k: int(h[k]) if k in h else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    size = number("X-Payload-Length")
    if h["WARC-Type"] == "response":
        payload = block.split(b"\r\n\r\n", 1)[1]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {h['WARC-Record-ID']} has another payload")
        size = len(payload)
    return number("X-Page-Id"), size, digest, h["WARC-Type"], number("X-Refers-To-Page-Id"), h["WARC-Target-URI"]


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row of ``RECORDS`` for each page record of the files that the manifest names."""
    files = _dealt(spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("name"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, path = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with file_system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        if record := parse_record(member):
                            rows.append((*record, name))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a fresh folder of the shared folder, and read the archive back."""
    folder = new_path(pages.sparkSession, "warc")
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder)
