"""ST4-ST7: stage streams, exactly-once consumption, scheduled runs.

* ST4 ``stage_stream``: new files of a stage as a Structured Streaming source
  (INSERT_ONLY: a file rewritten under an old path is not seen again -- the
  file source tracks paths).  A STANDARD stream on a stage is the batch
  difference of two listings (ST1 on path + modification time).
* ST5 ``consume``: a task that reads a stream and appends to a table,
  exactly once: the checkpoint records processed files and batch ids, and
  each batch overwrites its own batch folder, so a replay is idempotent.
* ST6 ``scheduled_runs``: rows handled by each run of an ``N MINUTE``
  schedule = tumbling windows; live, the same grouping runs with a
  processing-time trigger and a watermark.
* Live change sets: ``net_changes`` (ST2) and ``inserted_rows`` (ST3) keep keyed
  state, so rows that are delivered again count once; both drop rows older than
  the watermark.
* ST7 ``parse_schedule``: ``N MINUTE`` -> interval; ``USING CRON ...`` kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecraft.sources.parts import read_parts
from stagecraft.sources.stage import EXTENSIONS, _any_case, _base, relative

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def stage_stream(spark: SparkSession, path: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None, part_bytes: int | None = None) -> DataFrame:
    """ST4: streaming rows (FILE_NAME, size, last_modified, content) of new files.
    With ``part_bytes``, for files of any size, rows (FILE_NAME, size, last_modified,
    offset, content) of their parts in order (see ``sources.parts``)."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    base = _base(spark, path)
    df = r.load(path)
    out = df.select(relative(base).alias("FILE_NAME"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified"), "content" if part_bytes is None else "path")
    return out if part_bytes is None else read_parts(out, "path", "size", part_bytes).drop("path")


def stage_rows(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """ST4 over rows: the rows of new CSV (with a header), JSON and Parquet files
    anywhere below a stage, each file read by its extension, all with one ``schema``.
    A stream per format, united; the checkpoint keeps each one's files."""
    out = None
    for ext, fmt in EXTENSIONS.items():
        r = (spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", _any_case(ext)).option("header", "true"))
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
        rows = r.load(path)
        out = rows if out is None else out.unionByName(rows)
    return out


def inserted_rows(stream: DataFrame, key: str | list[str], ts: str, watermark: str) -> DataFrame:
    """ST3 live: rows whose key has not come before, with ``action`` INSERT.  A key
    is remembered until the watermark (``watermark`` behind the newest ``ts`` of the
    batches before) passes its row; older rows are late and dropped, so state is
    bounded by the rows of that time and a replay within it adds nothing."""
    keys = [key] if isinstance(key, str) else list(key)
    at = "__at"
    seen = stream.withColumn(at, F.col(ts).cast("timestamp")).withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)
    return seen.drop(at).withColumn("action", F.lit("INSERT"))


def net_changes(stream: DataFrame, key: str, seq: str, ts: str, watermark: str, op: str = "op",
                images: list[str] | None = None) -> DataFrame:
    """ST2 live: per key the net change of the log so far, for ``consume(...,
    output_mode="update")``: a batch gives the keys it touched, ``action`` null where
    nothing is left of an insert.  Log rows (key, seq) delivered again within the
    watermark count once, older rows are late and dropped (see ``inserted_rows``).
    First and last operation and the count are combinable aggregates kept by key, so
    rows may come in any order and a key with a third of the log is pre-aggregated
    before the shuffle."""
    from stagecraft.streaming.changes import net_action
    imgs = list(images) if images is not None else [c for c in stream.columns if c not in (key, seq, op, ts)]
    rows = inserted_rows(stream, [key, seq], ts, watermark)
    g = rows.groupBy(key).agg(F.min_by(op, seq).alias("first_op"), F.max_by(op, seq).alias("last_op"),
                              F.max_by(F.struct(*imgs), seq).alias("img"), F.count(F.lit(1)).alias("n_ops"))
    return g.select(key, net_action().alias("action"), "n_ops", *[F.col(f"img.{c}").alias(c) for c in imgs])


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row per key of a folder that ``consume`` wrote in update mode,
    without keys that nothing is left of."""
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch_id=*")
    cols = [c for c in rows.columns if c not in (key, "batch_id")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("batch_id").cast("long")).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in cols]).filter(F.col("action").isNotNull())


def closing_row(df: DataFrame, ts: str, after: str) -> DataFrame:
    """One row ``after`` the newest ``ts``, all other columns null: read as a
    stream's last row, it moves the watermark past every open window."""
    last = df.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts)).filter(F.col(ts).isNotNull())
    return last.select(*[F.col(ts).cast(t).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])


def table_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """ST3 live (APPEND_ONLY on a table): rows of files added to a table
    folder since the stream's checkpoint, as a Structured Streaming source.
    Rewrites of old files are not re-read (insert-only semantics)."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def consume(stream: DataFrame, target_path: str, checkpoint: str, transform=None,
            fmt: str = "parquet", available_now: bool = True, processing_time: str | None = None,
            output_mode: str = "append"):
    """ST5: run a task over a stream into a table folder, exactly once.

    The checkpoint records which files each batch took; a batch replayed
    after a failure keeps its id and its files.  Each batch is written with
    ``overwrite`` into its own ``batch_id=<id>`` folder, so a replay replaces
    its own output instead of appending it twice (idempotent write).  Readers
    see the table as the union of the batch folders.  Returns the started
    query.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform is not None else batch
        out.write.mode("overwrite").format(fmt).save(f"{target_path.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.outputMode(output_mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def parse_schedule(c: Column | str) -> Column:
    """ST7: STRUCT<minutes INT, every INTERVAL, cron STRING>.  ``N MINUTE``
    (case-insensitive, spaces allowed) gives minutes and an interval; ``USING
    CRON ...`` is kept as text; empty -> the default 60 minutes; anything
    else -> all null."""
    col = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    mins = F.regexp_extract(col, r"(?i)^([0-9]+)[ \t]*MINUTES?$", 1)
    cron = F.regexp_extract(col, r"(?i)^USING[ \t]+CRON[ \t]+(.+)$", 1)
    m = (F.when(col == "", F.lit(60))
          .when(mins != "", mins.cast("int")))
    return F.struct(m.alias("minutes"),
                    F.when(m.isNotNull(), F.make_dt_interval(mins=m)).alias("every"),
                    F.nullif(cron, F.lit("")).alias("cron"))


def scheduled_runs(df: DataFrame, ts: str, every: str = "60 minutes", watermark: str | None = None) -> DataFrame:
    """ST6: (run_start, run_end, rows): the rows each scheduled run handles,
    as tumbling windows of ``every``.  On a stream pass ``watermark`` (the
    event time must be a TIMESTAMP) so windows close in append mode."""
    src = df
    t = F.col(ts)
    if watermark:
        src = src.withColumn(ts, t.cast("timestamp")).withWatermark(ts, watermark)
    g = src.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    return g.select(F.col("w.start").alias("run_start"), F.col("w.end").alias("run_end"), "rows")
