"""Change sets (literal cases + invariants) and live stage streams."""

import os
import shutil

from pyspark.sql import functions as F

from stagecraft.streaming import changes as CH
from stagecraft.streaming import live as LV


def test_changes_literal_cases(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "B"), (5, "e"), (4, "d")], "k int, v string")
    got = sorted(((r.k, r.v, r.action, r.is_update) for r in CH.changes(before, after, "k").collect()),
                 key=lambda x: (x[0], x[2]))
    assert got == [(2, "b", "DELETE", True), (2, "B", "INSERT", True), (3, "c", "DELETE", False),
                   (4, None, "DELETE", True), (4, "d", "INSERT", True), (5, "e", "INSERT", False)]
    # invariant: applying the change set to before gives after
    rebuilt = CH.apply_changes(before, CH.changes(before, after, "k"), "k")
    assert sorted(map(tuple, rebuilt.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)


def test_compact_log(spark):
    log = spark.createDataFrame([
        (1, 1, "INSERT", "x"), (1, 2, "DELETE", "x"),                # insert then delete -> nothing
        (2, 1, "DELETE", "y"), (2, 2, "INSERT", "z"),                # delete then insert -> update
        (3, 1, "INSERT", "p"), (3, 2, "UPDATE", "q"),                # insert -> insert of last image
        (4, 1, "UPDATE", "r"), (4, 2, "DELETE", "s"),                # last delete -> delete
    ], "k int, seq int, op string, v string")
    got = sorted((r.k, r.action, r.v) for r in CH.compact_log(log, "k", "seq").collect())
    assert got == [(2, "UPDATE", "z"), (3, "INSERT", "q"), (4, "DELETE", "s")]


def test_append_only_and_stale(spark):
    before = spark.createDataFrame([(1, "a")], "k int, v string")
    after = spark.createDataFrame([(1, "A"), (2, "b")], "k int, v string")
    assert [r.k for r in CH.append_only(before, after, "k").collect()] == [2]
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-30 00:00:00")], "g int, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    st = {r.g: r.state for r in CH.stale(ev, "g", "ts", "2024-02-01 00:00:00", "3 days").collect()}
    assert st == {1: "Stale", 2: "Fresh"}


def test_schedule_parse(spark):
    rows = ["5 MINUTE", "60 MINUTE", "USING CRON 0 9 * * * UTC", "", "x MINUTE", None]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [(r.m, r.c) for r in df.select(LV.parse_schedule("s").alias("p"))
           .select(F.col("p.minutes").alias("m"), F.col("p.cron").alias("c")).collect()]
    assert got == [(5, None), (60, None), (None, "0 9 * * * UTC"), (60, None), (None, None), (60, None)]


def test_stage_stream_insert_only_and_exactly_once(spark, tmpdir_fresh):
    stage = os.path.join(tmpdir_fresh, "stage", "nested")
    os.makedirs(stage)
    for n in ("a.txt", "b.txt"):
        with open(os.path.join(stage, n), "w") as f:
            f.write(n)
    out, ckpt = os.path.join(tmpdir_fresh, "out"), os.path.join(tmpdir_fresh, "ckpt")
    base = os.path.join(tmpdir_fresh, "stage")

    def run():
        q = LV.consume(LV.stage_stream(spark, base), out, ckpt,
                       lambda b: b.select("FILE_NAME", "size"))
        q.awaitTermination()
        return sorted(r.FILE_NAME for r in spark.read.parquet(out).collect())

    assert run() == ["nested/a.txt", "nested/b.txt"]
    with open(os.path.join(stage, "c.txt"), "w") as f:        # new file
        f.write("c")
    assert run() == ["nested/a.txt", "nested/b.txt", "nested/c.txt"]
    with open(os.path.join(stage, "a.txt"), "w") as f:        # overwritten: not seen again (INSERT_ONLY)
        f.write("changed")
    assert run() == ["nested/a.txt", "nested/b.txt", "nested/c.txt"]
    assert run() == ["nested/a.txt", "nested/b.txt", "nested/c.txt"]   # restart: no repeats


def test_scheduled_runs_stream_matches_batch(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "ev")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts").write.parquet(src)
    batch = {(str(r.run_start)): r.rows for r in LV.scheduled_runs(spark.read.parquet(src), "ts").collect()}
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    agg = LV.scheduled_runs(stream, "ts", "60 minutes")
    q = agg.writeStream.outputMode("complete").format("memory").queryName("runs_test").start()
    q.processAllAvailable()
    q.stop()
    live = {str(r.run_start): r.rows for r in spark.sql("SELECT * FROM runs_test").collect()}
    assert sum(live.values()) == sum(batch.values()) and len(live) == len(batch)


def test_stage_changes_standard(spark, tmpdir_fresh):
    import time
    from stagecraft.sources.stage import stage_directory
    stage = os.path.join(tmpdir_fresh, "st")
    os.makedirs(os.path.join(stage, "sub"))
    empty = stage_directory(spark, stage)                       # empty directory
    assert empty.count() == 0
    for n, body in (("a.txt", "a"), ("b.txt", "b"), ("sub/c.txt", "c")):
        with open(os.path.join(stage, n), "w") as f:
            f.write(body)
    # snapshot of the first listing (a tiny test directory)
    before = spark.createDataFrame(stage_directory(spark, stage).collect())
    time.sleep(1.1)
    with open(os.path.join(stage, "a.txt"), "w") as f:          # overwritten
        f.write("a changed")
    os.remove(os.path.join(stage, "b.txt"))                      # deleted
    with open(os.path.join(stage, "sub", "d.txt"), "w") as f:   # new, nested
        f.write("d")
    after = stage_directory(spark, stage)
    got = sorted((r.relative_path, r.action, r.is_update) for r in CH.stage_changes(before, after).collect())
    assert got == [("a.txt", "DELETE", True), ("a.txt", "INSERT", True), ("b.txt", "DELETE", False),
                   ("sub/d.txt", "INSERT", False)]


def test_table_stream_append_only(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "tbl")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(src)
    out, ckpt = os.path.join(tmpdir_fresh, "o"), os.path.join(tmpdir_fresh, "c")

    def run():
        LV.consume(LV.table_stream(spark, src, rows.schema), out, ckpt).awaitTermination()
        return sorted(r.k for r in spark.read.parquet(out).collect())

    assert run() == [1, 2]
    spark.createDataFrame([(3, "c")], "k int, v string").write.mode("append").parquet(src)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]


def test_consume_replay_after_failure_is_exactly_once(spark, tmpdir_fresh):
    stage = os.path.join(tmpdir_fresh, "stage")
    os.makedirs(stage)
    for n in ("a.txt", "b.txt"):
        with open(os.path.join(stage, n), "w") as f:
            f.write(n)
    out, ckpt = os.path.join(tmpdir_fresh, "out"), os.path.join(tmpdir_fresh, "ckpt")
    flag = os.path.join(tmpdir_fresh, "failed_once")

    def flaky(batch):
        # the output is written, then the task dies before the batch commits
        if not os.path.exists(flag):
            batch.select("FILE_NAME", "size").write.mode("overwrite").parquet(os.path.join(out, "batch_id=0"))
            open(flag, "w").close()
            raise RuntimeError("simulated loss after the write")
        return batch.select("FILE_NAME", "size")

    q = LV.consume(LV.stage_stream(spark, stage), out, ckpt, flaky)
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001 - the simulated failure
        pass
    q = LV.consume(LV.stage_stream(spark, stage), out, ckpt, flaky)   # restart on the same checkpoint
    q.awaitTermination()
    got = sorted(r.FILE_NAME for r in spark.read.parquet(out).collect())
    assert got == ["a.txt", "b.txt"]


def _run(spark, base, rows, stream, mode="append"):
    rows.write.mode("append").parquet(base + "/in")
    LV.consume(stream(LV.table_stream(spark, base + "/in", rows.schema)), base + "/out", base + "/ckpt", output_mode=mode).awaitTermination()


def test_live_changes_out_of_order_replayed_and_late(spark, tmpdir_fresh):
    from datetime import datetime
    schema = "k int, seq int, op string, v string, ts timestamp_ntz"
    at = lambda d: datetime(2024, 1, d)
    one = [(1, 2, "UPDATE", "b", at(10)), (1, 1, "INSERT", "a", at(9)), (2, 1, "INSERT", "x", at(10)), (3, 5, "DELETE", None, at(10))]
    two = one + [(2, 2, "DELETE", None, at(11)), (1, 3, "UPDATE", "c", at(11)), (3, 4, "UPDATE", "w", at(10))]
    three = [(4, 1, "INSERT", "late", at(1)), (3, 6, "INSERT", "z", at(12))]  # day 1 is behind the watermark by now
    for rows in (one, two, three):
        _run(spark, tmpdir_fresh, spark.createDataFrame(rows, schema), lambda s: LV.net_changes(s, "k", "seq", "ts", "5 days"), "update")
    got = sorted(map(tuple, LV.current(spark, tmpdir_fresh + "/out", "k").collect()))
    assert got == [(1, "INSERT", 3, "c"), (3, "UPDATE", 3, "z")]


def test_live_inserts_drop_replays_and_late_rows(spark, tmpdir_fresh):
    from datetime import datetime
    schema = "k int, ts timestamp_ntz"
    at = lambda d: datetime(2024, 1, d)
    for rows in ([(1, at(10)), (1, at(10)), (2, at(9))], [(2, at(9)), (3, at(12))], [(4, at(2)), (3, at(12)), (5, at(11))]):
        _run(spark, tmpdir_fresh, spark.createDataFrame(rows, schema), lambda s: LV.inserted_rows(s, "k", "ts", "4 days"))
    assert sorted(r.k for r in spark.read.parquet(tmpdir_fresh + "/out").collect()) == [1, 2, 3, 5]


def test_closing_row_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, ts timestamp_ntz")
    assert LV.closing_row(empty, "ts", "1 DAY").collect() == []


def test_change_log_with_time_joins_nothing(spark):
    """The log's time comes with its rows: no join of the events with themselves."""
    from stagecraft.plans import fixtures as FX
    log = FX.change_log(spark, "/root/testdata/sf0.001", "ts")
    assert log.columns == ["user_id", "seq", "op", "value", "props", "ts"]
    assert "Join" not in log._jdf.queryExecution().executedPlan().toString()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert log.select("seq", "ts").exceptAll(events.select("event_id", "ts")).count() == 0 and log.count() == events.count()
