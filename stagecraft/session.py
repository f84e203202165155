"""Session settings shared by the library, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  AQE re-plans joins from runtime
# sizes (a shuffle that turns out small becomes a broadcast), coalesces small
# partitions and splits skewed ones; UTC makes TIMESTAMP_NTZ comparisons with
# the SQL oracle exact.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "stagecraft") -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    The master comes from the deployment (spark-submit, spark-defaults); only a
    caller that passes one, such as the bench, sets it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if os.environ.get("SPARK_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", os.environ["SPARK_DRIVER_MEMORY"])
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and is read here.  Only
    when nothing is configured (tests, local runs) a fresh local folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            configured = None
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="stagecraft-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, tag: str = "t", with_count: bool = False):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: the lineage is cut (a lost executor does not replay earlier rounds)
    and, unlike an eager ``checkpoint()``, the input is computed only once.

    ``with_count=True`` also returns the number of rows written, observed
    during the write itself (``DataFrame.observe``), so no second job runs.
    """
    import uuid
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stagecraft-mat/{tag}-{uuid.uuid4().hex[:12]}"
    if with_count:
        obs = Observation(f"rows_{tag}")
        df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), int(obs.get["n"])
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(df, tag: str = "t"):
    """(``materialize``, the folder written), for tables that ``remove`` deletes again."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stagecraft-mat/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote and no result reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df, rows: int, *cols, per: int = 500_000):
    """``df`` hash-partitioned by ``cols`` into tasks of about ``per`` rows.  AQE
    joins partitions up to a target of compressed bytes, and a scan's task takes what
    its split holds: rows that compress well make tasks of many times that in memory.
    Tables of few rows keep Spark's own plan."""
    n = -(-int(rows) // per)
    return df.repartition(n, *cols) if n > df.sparkSession.sparkContext.defaultParallelism else df


def size_partitions(spark: SparkSession, input_bytes: int, target_bytes: int = 128 << 20,
                    min_partitions: int | None = None) -> int:
    """Size shuffles for the data: about one shuffle partition per
    ``target_bytes`` of input (at least two per core), with AQE coalescing
    small partitions back to ``target_bytes`` and splitting skewed ones.
    At 100 TB this gives ~800k partitions of 128 MB; at sf0.1 the floor."""
    cores = spark.sparkContext.defaultParallelism
    floor = min_partitions if min_partitions is not None else 2 * cores
    n = max(floor, -(-int(input_bytes) // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return n
