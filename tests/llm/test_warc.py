"""WARC archives: round trips, determinism, manifests."""

import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from logfault.llm import warc
from logfault.llm.queries import op1_warc


def rows_of(seed=1):
    rng = random.Random(seed)
    page = lambda n: "".join(rng.choice("<p>é ab😀\n") for _ in range(n))
    same = [page(1500), page(999), "é" * 500]
    out = [(i, f"http://x/{i}", page(rng.randint(0, 3000))) for i in range(120)]
    out += [(200 + i, f"http://y/{i}", same[i % 3]) for i in range(30)]
    return out + [(-5, None, same[0]), (10**12, "http://z\r\nX-Key: 9", None), (None, "n", "null id"), (300, "u", ""), (301, "a b é", " ")]


def expected(rows):
    digest = {r: hashlib.sha1((r[2] or "").encode()).hexdigest() for r in rows}
    last = {}
    for r in rows:
        if len((r[2] or "").encode()) >= 1000 and r[0] is not None:
            last[digest[r]] = max(r[0], last.get(digest[r], r[0]))
    out = Counter()
    for r in rows:
        size = len((r[2] or "").encode())
        to = last.get(digest[r]) if size >= 1000 else None
        revisit = to is not None and to != r[0]
        out[(r[0], size, digest[r], "revisit" if revisit else "response", to if revisit else None)] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 20_000, "roll_bytes": 3_000}])
def test_round_trip(spark, sizes):
    rows = rows_of() + [(50, "http://x/50", "again"), (300, "u", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, key string").repartition(5)
    assert Counter(tuple(r) for r in warc.round_trip(df, **sizes).collect()) == expected(rows)


def archive(spark, tmp_path, name, parts):
    df = spark.createDataFrame(rows_of(), "page_id long, url string, html string").repartition(parts)
    folder = tmp_path / name
    manifest = warc.write(df, str(folder), shard_bytes=20_000, roll_bytes=3_000)
    return folder, manifest


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    a, _ = archive(spark, tmp_path, "a", 3)
    b, _ = archive(spark, tmp_path, "b", 8)
    files = {f.name: f.read_bytes() for f in a.glob("*.warc.gz")}
    assert len(files) > 10 and files == {f.name: f.read_bytes() for f in b.glob("*.warc.gz")}


def test_files_are_sorted_gzip_members_and_rolled(spark, tmp_path):
    folder, manifest = archive(spark, tmp_path, "a", 4)
    keys = []
    for m in sorted(manifest.collect(), key=lambda m: m.name):
        raw = (folder / m.name).read_bytes()
        assert len(raw) == m.bytes and hashlib.sha1(raw).hexdigest() == m.sha1
        assert m.bytes <= 3_000 or m.records == 1
        text = gzip.decompress(raw)
        assert text.count(b"WARC/1.1\r\n") == m.records
        keys += [int(line[7:] or -(1 << 63)) for line in text.split(b"\r\n") if line.startswith(b"X-Key: ")]
    assert keys == sorted(keys) and len(keys) == len(rows_of())
    assert not list(folder.glob("_temporary/*/*.gz"))


def test_payloads_and_stray_files(spark, tmp_path):
    folder, _ = archive(spark, tmp_path, "a", 4)
    (folder / "records-999999-00000.warc.gz").write_bytes(b"left by a lost attempt")
    back = {r.key: r for r in warc.read(spark, str(folder)).collect()}
    for key, _, html in rows_of():
        r = back[key]
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == (html or "").encode()


def test_commit_can_be_repeated_and_damage_is_seen(spark, tmp_path):
    folder, manifest = archive(spark, tmp_path, "a", 4)
    again = manifest.mapInArrow(warc._commit(str(folder)), warc._MANIFEST)
    assert again.count() == manifest.count()
    victim = next(Path(folder).glob("*.warc.gz"))
    data = bytearray(victim.read_bytes())
    data[len(data) // 2] ^= 1
    victim.write_bytes(bytes(data))
    with pytest.raises(Exception, match="(?i)error|differs|record"):
        warc.read(spark, str(folder)).collect()


def test_cuts_follow_the_bytes(spark):
    keys = [(i, 100) for i in range(1000)] + [(10**9 + i, 100) for i in range(1000)] + [(-(1 << 63), 5000), ((1 << 63) - 1, 5000)]
    df = spark.createDataFrame(keys, "key long, bytes long")
    cuts = warc.shards(df, 5_000)
    assert cuts == sorted(set(cuts))
    sizes = Counter()
    for k, b in keys:
        sizes[sum(c <= k for c in cuts)] += b
    assert min(sizes) == 1 and max(sizes.values()) <= 5_000
    assert warc.shards(df.limit(0), 100) == []


def test_empty_table_and_query(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0
    folder = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert Counter(tuple(r) for r in op1_warc(spark, folder).collect()) == expected(pages)


def test_many_files_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    from logfault.llm import warc
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    manifest = warc.write(rows, f"file://{tmp_path}/w", shard_bytes=20_000, roll_bytes=500)
    files = manifest.count()
    assert files > 1000 and manifest.groupBy("shard").count().filter("count > 3").count() > 10
    old, warc.READ_BYTES = warc.READ_BYTES, 50_000
    try:
        parts = warc.read(spark, f"file://{tmp_path}/w").groupBy(F.spark_partition_id()).count().count()
        assert parts > 5
    finally:
        warc.READ_BYTES = old
    # By default a shard is several files.
    html = F.concat_ws("", *(F.sha2(F.concat_ws("-", "page_id", F.lit(i)), 512) for i in range(200)))
    big = warc.write(rows.withColumn("html", html), f"file://{tmp_path}/v")
    assert big.groupBy("shard").count().agg(F.max("count")).first()[0] > 3
