"""WARC archives: a deterministic sharded writer and a reader.

Write. Records are dealt to shards by ranges of their id, whose borders follow from exact byte counts of the table (not
from a sample), so that the same rows make the same files whatever the partitions were. Each shard is one task's work: it is
sorted by id and written into files rolled by compressed size, each record a gzip member of its own, headers and digests
made anew. A file is written under a temporary name of the task attempt and renamed when it is whole; as its bytes depend on
the rows alone, a repeated attempt replaces it by itself.

Each run writes into a folder of its own, a generation, beside its manifest (one row per file). Last of all the file CURRENT
is replaced by one that names the new generation: readers take the files that its manifest names and no others, and a
reader of the former generation still finds it whole.

Deduplication. Of records with equal payloads of `revisit_bytes` or more, the one with the largest id is the response.
These decisions are made on digests alone; they travel to the shards as rows of their own, sorted just before the record
that they are about, so the payload is shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
MANIFEST = "shard int, part int, path string, records long, bytes long, first_id long, last_id long, sha1 string"


def _filesystem(uri: str):
    """(file system, path) for a URI, by pyarrow: file, s3, gs, and hdfs where its library is there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}" if uri.startswith(("file:", "/")) else f"file://{os.path.abspath(uri)}")


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit with the head alone."""
    key = "" if record_id is None else str(record_id)
    target = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]") or "urn:x-none:"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{key} {digest} {target}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}",
        f"X-Record-Key: {key}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Key: {refers_to}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """The files of one shard; each closes when it holds `limit` compressed bytes."""

    def __init__(self, folder: str, shard: int, limit: int, level: int):
        self.fs, self.folder = _filesystem(folder)
        self.shard, self.limit, self.level, self.part, self.out, self.made = shard, limit, level, 0, None, []
        self.temporary = f".tmp-{TaskContext.get().taskAttemptId()}"

    def add(self, key: int | None, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/shard-{self.shard:05d}-{self.part:05d}.warc.gz"
            self.out, self.sha, self.bytes, self.n, self.first = self.fs.open_output_stream(self.name + self.temporary, compression=None), hashlib.sha1(), 0, 0, key
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes, self.n, self.last = self.bytes + len(member), self.n + 1, key
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.name + self.temporary, self.name)
            self.made.append((self.shard, self.part, self.name.rpartition("/")[2], self.n, self.bytes, self.first, self.last, self.sha.hexdigest()))
            self.out, self.part = None, self.part + 1


def shard_borders(sizes: DataFrame, target: int, buckets: int = 1024) -> list[int]:
    """Ids at which shards begin (without the first), from exact sums over ranges of ids; ranges above the target are cut again.

    sizes: key long, bytes long. The driver gets, as Arrow columns, at most `buckets` sums of 16 bytes for each heavy range, a
    number that follows from bytes / target. One id that outweighs the target keeps a shard to itself.
    """
    known = sizes.where("key IS NOT NULL")
    low, high, total = known.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if low is None:
        return []
    buckets = max(buckets, 4 * (int(total) // target + 1))
    shift = max(0, (int(high) - int(low)).bit_length() - buckets.bit_length())
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        sums = known.groupBy(F.shiftright("key", shift).alias("b")).agg(F.sum("bytes").alias("bytes")).toArrow()
        b, n = sums["b"].to_numpy(), sums["bytes"].to_numpy()
        heavy = (n > target) & bool(shift)
        pieces.append((b[~heavy] << shift, n[~heavy]))
        if not heavy.any():
            break
        rows = sizes.sparkSession.createDataFrame(pa.table({"b": b[heavy]}))
        known = known.withColumn("b", F.shiftright("key", shift)).join(F.broadcast(rows), "b", "left_semi").drop("b")
        shift = max(0, shift - 10)
    lows, bytes_ = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(lows)
    borders, held = [], 0
    for lo, n in zip(lows[order].tolist(), bytes_[order].tolist()):
        if held and held + n > target:
            borders.append(lo)
            held = 0
        held += n
    return borders


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = 64 << 20,
    roll_bytes: int = 16 << 20,
    revisit_bytes: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 6,
) -> DataFrame:
    """Writes `pages` to WARC files under `folder` and returns the manifest, one row per file; an archive that is there already is replaced as a whole.

    A null payload is empty; a null url is written as urn:x-none:. A null id goes to the first shard and is read back as
    null. Rows that share the largest id of a payload are all responses; of rows with equal payloads and no id, each is a
    response. Repeated rows are records of their own. No rows: no files and an empty manifest. shard_bytes counts
    payload before compression. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    small = rows.select("key", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    borders = shard_borders(small.select("key", (F.col("bytes") + 400).alias("bytes")), shard_bytes)
    shard = _bucketed(borders)

    largest = small.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL")
    revisits = small.where(F.col("bytes") >= revisit_bytes).join(largest, "digest").where("key IS NULL OR key <> response").select("key", "digest", "response").distinct()
    wire = "shard int, key long, turn int, url string, payload binary, digest string, response long"
    decided = revisits.select(shard.cast("int").alias("shard"), "key", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "response")
    payloads = rows.select(shard.cast("int").alias("shard"), "key", F.lit(1).alias("turn"), "url", "payload", F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("response"))
    dealt = decided.unionByName(payloads).repartitionById(len(borders) + 1, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "turn", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, decisions, at = None, {}, None
        made: list[tuple] = []
        for batch in batches:
            for s, key, turn, url, payload, digest, response in zip(*(c for c in batch.columns)):
                s, key, digest = s.as_py(), key.as_py(), digest.as_py()
                if roll is None or roll.shard != s:
                    if roll is not None:
                        roll.close()
                        made += roll.made
                    roll = _Roll(target, s, roll_bytes, level)
                    decisions = {}
                if at != key:
                    decisions, at = {}, key
                if not turn.as_py():
                    decisions[digest] = response.as_py()
                else:
                    roll.add(key, record_bytes(key, url.as_py(), payload.as_py(), digest, decisions.get(digest), date))
        if roll is not None:
            roll.close()
            made += roll.made
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in MANIFEST.split(", ")), m)) for m in made], schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha1", pa.string())]))

    generation = f"run-{uuid.uuid4().hex}"
    target = f"{folder.rstrip('/')}/{generation}"
    files, path = _filesystem(target)
    files.create_dir(path, recursive=True)
    dealt.select(*[F.col(x.split()[0]) for x in wire.split(", ")]).mapInArrow(write, MANIFEST).write.json(f"{target}/manifest")
    for left in files.get_file_info(_selector(path)):
        if ".tmp-" in left.base_name:  # of attempts that failed
            files.delete_file(left.path)
    base = path.rpartition("/")[0]
    with files.open_output_stream(f"{path}/CURRENT", compression=None) as f:
        f.write(generation.encode())
    files.move(f"{path}/CURRENT", f"{base}/CURRENT")
    return spark.read.schema(MANIFEST).json(f"{target}/manifest")


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def generation(folder: str) -> str:
    """The folder of the archive that was written to `folder` last."""
    files, path = _filesystem(folder)
    with files.open_input_stream(f"{path}/CURRENT", compression=None) as f:
        return f"{folder.rstrip('/')}/{f.read().decode()}"


def drop_former(folder: str) -> None:
    """Deletes the generations that CURRENT doesn't name; to be called when nobody reads them."""
    files, path = _filesystem(folder)
    kept = generation(folder).rpartition("/")[2]
    for info in files.get_file_info(_selector(path)):
        if info.base_name.startswith("run-") and info.base_name != kept:
            files.delete_dir(info.path)


def _bucketed(borders: list[int]) -> Column:
    """The shard of F.col("key"): nested halves, so that a row is compared with log2(n) borders; many borders go to numpy. Without an id: the first."""
    if len(borders) > 512:

        @F.pandas_udf("int")
        def place(key: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(borders, key.to_numpy(np.int64), "right"))

        # nulls would turn the batch's ids into floats
        return F.when(F.col("key").isNull(), 0).otherwise(place(F.coalesce("key", F.lit(0).cast("long"))))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") < F.lit(borders[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col("key").isNull(), 0).otherwise(tree(0, len(borders)))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive's bytes, one gzip member after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("a WARC file ends within a record")
            fed = view[at : at + (64 << 10)]
            parts.append(unpacker.decompress(fed))
            at += len(fed) - len(unpacker.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = rest[: int(headers["content-length"])]
        if "sha1:" + _b32(hashlib.sha1(block).hexdigest()) != headers["warc-block-digest"]:
            raise ValueError(f"block digest of {headers['warc-record-id']} differs")
        yield headers, block


READ = "record_key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archive that was written to `folder` last; each digest is checked, and a wrong one fails the task.

    payloads: False leaves the column payload null (for a revisit it is always null). Files are read by one task each.
    """
    folder = generation(folder)
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                out, held = [], 0
                for h, block in parse_records(data):
                    head, _, body = block.partition(b"\r\n\r\n")
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = h["warc-type"] == "response"
                    if response and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                    out.append((int(h["x-record-key"]) if h["x-record-key"] else None, h["warc-target-uri"], h["warc-type"], int(h["x-refers-to-key"]) if "x-refers-to-key" in h else None, length, digest, body if payloads and response else None))
                    held += len(body)
                    if held >= 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    # each file is a unit of work; rows of the manifest are few and small
    return manifest.select("path").repartition(max(1, min(10_000, manifest.count())), "path").mapInArrow(read, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])

