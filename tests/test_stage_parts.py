"""Stage files of any size: contents as bounded parts, digested in order."""

import hashlib
import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from stagecraft.plans.catalog import REGISTRY
from stagecraft.sources import parts as PT
from stagecraft.sources import stage as SG
from stagecraft.streaming import live as LV


def _stage(folder, sizes, ext=".parquet"):
    """Files of random bytes; {relative path: (size, MD5)}."""
    want = {}
    for i, n in enumerate(sizes):
        rel = f"a b/{i}%20ü{ext}" if i % 2 else f"{i}{ext}"
        os.makedirs(os.path.dirname(os.path.join(folder, rel)), exist_ok=True)
        data = os.urandom(n)
        with open(os.path.join(folder, rel), "wb") as f:
            f.write(data)
        want[rel] = (n, hashlib.md5(data).hexdigest())
    return want


@contextmanager
def _value_limit(spark, n):
    """As if a value ended at ``n`` bytes instead of 2 GB."""
    key = "spark.sql.sources.binaryFile.maxLength"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _files_beyond_a_value(spark, folder, query):
    want = _stage(folder, (1, 999, 1000, 1001, 700_000, 2 * PT.PART_BYTES))
    with _value_limit(spark, 1000):
        rows = REGISTRY[query][0](spark, folder).collect()
    assert len(rows) == len(want) and {r[0]: (r[1], r[2]) for r in rows} == want


def test_consume_once_reads_files_beyond_a_value(spark, tmpdir_fresh):
    _files_beyond_a_value(spark, tmpdir_fresh, "consume_once")


def test_stage_stream_reads_files_beyond_a_value(spark, tmpdir_fresh):
    _files_beyond_a_value(spark, tmpdir_fresh, "stage_stream")


def test_stage_files_reads_files_beyond_a_value(spark, tmpdir_fresh):
    _files_beyond_a_value(spark, tmpdir_fresh, "stage_files")


def test_parts_of_stage_files_are_the_contents(spark, tmpdir_fresh):
    _stage(tmpdir_fresh, (1, 100, 101, 2500), ".bin")
    whole = {r.relative_path: r for r in SG.stage_files(spark, tmpdir_fresh).collect()}
    got = {}
    for r in SG.stage_files(spark, tmpdir_fresh, part_bytes=100).orderBy("relative_path", "offset").collect():
        of = whole[r.relative_path]
        assert (r["size"], r.last_modified) == (of["size"], of.last_modified) and 0 < len(r.content) <= 100
        assert r.offset == len(got.setdefault(r.relative_path, b""))
        got[r.relative_path] += r.content
    assert got == {k: bytes(r.content) for k, r in whole.items()}


def test_streamed_parts_are_bounded_and_new_files_come_once(spark, tmpdir_fresh):
    stage, out, ckpt = (os.path.join(tmpdir_fresh, x) for x in ("stage", "out", "ckpt"))
    os.makedirs(stage)
    largest = []

    def digest(batch):
        largest.append(batch.agg(F.max(F.length("content"))).first()[0])
        return PT.md5_of_parts(batch, "FILE_NAME")

    def run():
        LV.consume(LV.stage_stream(spark, stage, part_bytes=100), out, ckpt, digest).awaitTermination()
        rows = spark.read.parquet(out).collect()
        return len(rows), {r.FILE_NAME: (r["size"], r.md5) for r in rows}

    want = _stage(stage, (1, 100, 101, 2500), ".bin")
    assert run() == (4, want)
    want |= _stage(stage, (300,), ".new")
    assert run() == (5, want) and run() == (5, want)
    assert largest == [100, 100]


def test_an_empty_file_has_one_empty_part(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "empty")
    open(path, "wb").close()
    parts = PT.read_parts(spark.createDataFrame([(path, 0)], "path string, size long"), "path", "size", 10)
    assert [(r.offset, bytes(r.content)) for r in parts.collect()] == [(0, b"")]
    assert PT.md5_of_parts(parts, "path").first().md5 == hashlib.md5(b"").hexdigest()


def test_parts_out_of_order_or_missing_are_refused(spark, tmpdir_fresh):
    _stage(tmpdir_fresh, (1000,), ".bin")
    files = spark.createDataFrame([(os.path.join(tmpdir_fresh, "0.bin"), 1000)], "path string, size long")
    parts = PT.read_parts(files, "path", "size", 100)
    for wrong in (parts.coalesce(1).sortWithinPartitions(F.desc("offset")), parts.filter("offset <> 300"), parts.filter("offset < 900")):
        with pytest.raises(Exception, match="parts (out of order|missing)"):
            PT.md5_of_parts(wrong, "path").collect()
    with pytest.raises(ValueError):
        PT.read_parts(files, "path", "size", 0)


def test_a_file_shorter_than_listed_fails(spark, tmpdir_fresh):
    _stage(tmpdir_fresh, (500,), ".bin")
    files = spark.createDataFrame([(os.path.join(tmpdir_fresh, "0.bin"), 501)], "path string, size long")
    with pytest.raises(Exception, match="EOF"):
        PT.read_parts(files, "path", "size", 100).collect()
