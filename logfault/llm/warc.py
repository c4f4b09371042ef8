"""Deterministic sharded WARC writer and its reader.

Records are sorted by key and cut into shards of neighbouring keys at places
that depend on the data alone: byte counts per range of keys, refined where a
range is too heavy. Each shard is one sorted run; its task rolls to a new file
when the compressed size is reached, a sixteenth of the shard's payload, so
most shards are several files. Headers, digests and ids are made from
the record, so a second run writes the same bytes.

A task writes under a temporary name that no other attempt shares and reports
what it wrote; Spark keeps the report of one successful attempt per shard as
the manifest. The commit renames the files of the manifest and can be
repeated; files of lost attempts are never named there. Readers follow the
manifest.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the
largest key is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise, scratch_path
from .common import NO_ID

REVISIT_BYTES = 1000
#: Payload bytes of a shard; a file is rolled at so many compressed bytes, a share of what its shard is to hold.
SHARD_BYTES, ROLL_SHARE = 16 << 20, 16
#: Compressed bytes that one task reads, about.
READ_BYTES = 4 << 20
#: More shards than this are made larger instead, as every task is told where they start.
MAX_SHARDS = 100_000
#: Ranges that each round of counting cuts the keys into.
RANGES = 1024
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_DATE = "1970-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI and the path on it, for the driver and the tasks alike."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{key}/{digest}')}>"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its headers."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}",
             f"WARC-Date: {_DATE}", "WARC-Target-URI: " + "".join(c if c.isprintable() else "%20" for c in url or ""),
             f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    lines += [f"X-Key: {'' if key is None else key}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(data: bytes) -> bytes:
    """One gzip member without a time or a name."""
    body = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    return (b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body.compress(data) + body.flush()
            + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little"))


def shards(keys: DataFrame, target: int) -> list[int]:
    """Ascending keys at which shards start, from ``key`` and ``bytes``.

    Bytes are counted in equal ranges of keys; ranges over ``target`` are cut
    and counted again until they are light or hold one key. Each round returns
    at most ``RANGES`` rows per heavy range, of which there are at most total
    bytes / target.
    """
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if low is None:
        return []
    todo, counts = [(low, high + 1)], {}
    while todo:
        spark = keys.sparkSession
        heavy = spark.createDataFrame([tuple(map(Decimal, (a, b, -(-(b - a) // RANGES)))) for a, b in todo],
                                      "a decimal(20,0), b decimal(20,0), w decimal(20,0)")
        at = F.col("key").cast("decimal(20,0)")
        seen = (keys.join(F.broadcast(heavy), (at >= F.col("a")) & (at < F.col("b")))
                .withColumn("n", F.expr("(cast(key AS decimal(20,0)) - a) div w"))
                .groupBy("a", "b", "w", "n").agg(F.sum("bytes").alias("bytes")).collect())
        todo = []
        for a, b, w, n, size in seen:
            a, b, w, n = int(a), int(b), int(w), int(n)
            start, end = a + n * w, min(b, a + (n + 1) * w)
            if size > target and end - start > 1:
                todo.append((start, end))
            else:
                counts[start] = size
    cuts, size = [], target
    for start in sorted(counts):
        if size + counts[start] > target:
            cuts.append(start)
            size = 0
        size += counts[start]
    return cuts


_MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha1 string"


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        attempt = uuid.uuid4().hex
        shard, seq, out, done = None, 0, None, []
        records = size = 0
        digest = hashlib.sha1()
        told, refers = None, {}  # the key that the latest slim rows are about, and its responses by digest

        def close() -> None:
            nonlocal out, records, size, digest, seq
            if out is not None:
                out.close()
                done.append((shard, seq, temporary, name, records, size, digest.hexdigest()))
                seq += 1
            out, records, size, digest = None, 0, 0, hashlib.sha1()

        temporary = name = ""
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("shard", "key", "kind", "url", "payload", "response")]
            for at, key, kind, url, payload, response in zip(*columns):
                if at != shard:
                    close()
                    shard, seq = at, 0
                if key != told:
                    told, refers = key, {}
                if kind == 0:
                    refers[url] = response
                    continue
                data = payload.encode("utf-8", "surrogatepass")
                to = refers.get(hashlib.sha1(data).hexdigest()) if refers else None
                own = None if key == NO_ID else key
                member = compress(record(own, url, data, to, to is not None))
                if out is not None and size + len(member) > roll:
                    close()
                if out is None:
                    name = f"records-{shard:06d}-{seq:05d}.warc.gz"
                    temporary = f"_temporary/{attempt}/{name}"
                    store.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
                    out = store.open_output_stream(f"{root}/{temporary}", compression=None)
                out.write(member)
                digest.update(member)
                records, size = records + 1, size + len(member)
        close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["shard", "seq", "temporary", "name", "records", "bytes", "sha1"]
        rows = list(zip(*done)) if done else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist()):
                there = store.get_file_info(f"{root}/{temporary}").type
                if there == arrow_fs.FileType.File:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type != arrow_fs.FileType.File:
                    raise FileNotFoundError(f"neither {temporary} nor {name} in {folder}")
            yield batch
    return run


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None) -> DataFrame:
    """Write a record per row of ``df`` below ``folder``; returns the manifest.

    Null payloads are empty, null urls blank; rows with a null id come first.
    Repeated rows are written as often as they occur and share their type.
    ``folder`` must not exist; it is complete once the table ``manifest``
    below it is. Columns other than the three play no part.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(key.alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    slim = materialise(rows.select("key", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("digest")), "payloads")
    # Slim rows only: the latest key of each payload that occurs more than once.
    last = (slim.filter(F.col("bytes") >= revisit_bytes).groupBy("digest")
            .agg(F.max("key").alias("response"), F.min("key").alias("first")).filter("first < response"))
    refers = (slim.filter(F.col("bytes") >= revisit_bytes).join(last, "digest").filter("key < response")
              .select("key", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(None).cast("string").alias("payload"), "response"))
    sized = slim.select("key", (F.col("bytes") + 512).alias("bytes"))
    target = max(shard_bytes, -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // MAX_SHARDS))
    cuts = shards(sized, target)
    if len(cuts) <= 1:
        shard = F.lit(0)
    else:
        # At most MAX_SHARDS numbers.
        starts = df.sparkSession.sparkContext.broadcast(cuts)

        @F.pandas_udf("int")
        def shard_of(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(np.array(starts.value), keys.to_numpy(), side="right") - 1, dtype="int32")
        shard = shard_of("key")
    every = rows.select("key", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("response")).unionByName(refers)
    dealt = (every.withColumn("shard", shard).repartitionById(max(1, len(cuts)), "shard")
             .sortWithinPartitions("shard", "key", "kind", "url", "payload"))
    manifest = materialise(dealt.select("shard", "key", "kind", "url", "payload", "response").mapInArrow(
        _write(folder, roll_bytes or max(1, target // ROLL_SHARE)), _MANIFEST), "manifest")
    _dealt(manifest).mapInArrow(_commit(folder), _MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _dealt(files: DataFrame) -> DataFrame:
    """Rows of a manifest, as many tasks as their bytes ask for; the tiny rows alone would all be one task."""
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return files.repartition(max(1, min(count, -(-size // READ_BYTES))), "name")


def members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream of bytes."""
    inflate, parts = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


_RECORDS = "key long, url string, type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string"


def read(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of all files of the manifest below ``folder``.

    Digests and lengths are checked against each response's payload and each
    file against the manifest; a mismatch raises. A revisit has no payload of
    its own; its length and digest are those of the payload it stands for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for name, sha1 in zip(batch["name"].to_pylist(), batch["sha1"].to_pylist()):
                rows: list[tuple] = []
                size, whole = 0, hashlib.sha1()

                def chunks() -> Iterator[bytes]:
                    with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                        while chunk := stream.read(1 << 20):
                            whole.update(chunk)
                            yield chunk

                for member in members(chunks()):
                    rows.append((*parse(member, keep_payload), name))
                    size += len(member)
                    if size > 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)
                if whole.hexdigest() != sha1:
                    raise ValueError(f"{name} differs from the manifest")

    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("name", "sha1", "bytes")
    return _dealt(files).mapInArrow(run, _RECORDS)


def parse(member: bytes, keep_payload: bool) -> tuple:
    head, _, block = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    block = block[:size]
    if fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError("a block differs from its digest")
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: int(fields[name]) if fields.get(name) else None
    if not revisit and (digest != hashlib.sha1(block).hexdigest() or size != number("X-Payload-Length")):
        raise ValueError("a payload differs from its digest")
    return (number("X-Key"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Key"),
            number("X-Payload-Length"), digest, block if keep_payload and not revisit else None)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["key", "url", "type", "refers_to", "payload_bytes", "payload_digest", "payload", "file"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **sizes) -> DataFrame:
    """Archive ``df`` in the shared folder and read it back: a row per record."""
    folder = scratch_path(df.sparkSession, "warc")
    write(df, folder, id_col, url_col, payload_col, **sizes)
    back = read(df.sparkSession, folder, keep_payload=False)
    return back.select(F.col("key").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
