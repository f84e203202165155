"""Table counts, table inventory and column profiles.

Re-aimed from the reference's catalog listings to data: the row count of
each table of a data directory (G1), with its files, bytes and newest file
time (G2), and a profile of each column (G3).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.session import spread
from stagecraft.sources.stage import stage_directory
from stagecraft.sources.tables import table_path


def table_counts(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """G1: (table_name, rows) for each table, as one job of unioned counts.
    A table that cannot be read counts 0, as a failing listing did."""
    parts = []
    for n in names:
        try:
            df = spark.read.parquet(table_path(sf_dir, n))
            parts.append(df.select(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")))
        except Exception:  # noqa: BLE001 - unreadable table counts 0
            parts.append(spark.range(1).select(F.lit(n).alias("table_name"), F.lit(0).cast("bigint").alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def table_inventory(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(table_name, rows, files, bytes, newest_epoch) -- G1 joined to the
    file listing (S1, no content read) grouped by table."""
    listing = (stage_directory(spark, sf_dir, glob="*.parquet")
               .withColumn("table_name", F.regexp_extract("relative_path", r"^([^/]+)\.parquet", 1))
               .groupBy("table_name")
               .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
                    F.max(F.unix_timestamp("last_modified")).alias("newest_epoch")))
    return table_counts(spark, sf_dir, names).join(listing, "table_name", "left")


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, type, nulls, distinct, min, max) for every column.

    ``exact=False`` (the default) uses HyperLogLog++ (``approx_count_distinct``):
    fixed-size sketches merged per partition, ONE aggregate pass over the table, then
    unpivoted with ``stack``.  ``exact=True`` groups each column by its values (see
    ``_exact_profile``).
    """
    if exact:
        return _exact_profile(df)
    aggs = []
    cols = df.schema.fields
    for f in cols:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        nulls = F.count_if(c.isNull())
        if kind.startswith(("map", "variant")):  # no order and no equality: by their text
            c = F.to_json(c)
        aggs += [nulls.alias(f"{f.name}__nulls"), F.approx_count_distinct(c).cast("bigint").alias(f"{f.name}__distinct"),
                 F.min(c).cast("string").alias(f"{f.name}__min"), F.max(c).cast("string").alias(f"{f.name}__max")]
    one = df.agg(*aggs)
    stack = ", ".join(
        f"'{f.name}', '{f.dataType.simpleString()}', `{f.name}__nulls`, `{f.name}__distinct`, "
        f"`{f.name}__min`, `{f.name}__max`" for f in cols)
    return one.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, type, nulls, distinct_count, min_value, max_value)")


def _exact_profile(df: DataFrame, per: int = 500_000) -> DataFrame:
    """``column_profile`` with exact distinct counts: the table is spread by its rows
    once, so that a task's groups stay few, then each column is grouped by value and
    profiled from its groups.  Unlike several distinct counts in one aggregate, no row
    is copied once per column."""
    fields = df.schema.fields
    plain = [F.col(f"`{f.name}`") for f in fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    df = spread(df, df.count(), *plain, per=per)
    parts = []
    for f in fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind.startswith(("map", "variant")):  # no order and no equality: by their text
            c = F.to_json(c)
        values = df.select(c.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        parts.append(values.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                                F.count("v").alias("distinct_count"), F.min("v").cast("string").alias("min_value"),
                                F.max("v").cast("string").alias("max_value"))
                     .select(F.lit(f.name).alias("column_name"), F.lit(kind).alias("type"), "nulls", "distinct_count", "min_value", "max_value"))
    return reduce(DataFrame.unionByName, parts)


def _text_of(c, kind: str):
    """A value as text that is equal for equal values."""
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(c)
    return F.hex(c) if kind == "binary" else c.cast("string")


def profile_sketches(df: DataFrame, table: str) -> DataFrame:
    """G3 by parts: (table_name, column_name, type, rows, nulls, min_value, max_value,
    sketch) of every column, map, array, struct and VARIANT included, from one pass.

    ``sketch`` is an HLL sketch of the column's values (4 KB at most), ``min_value``
    and ``max_value`` are null where values have no order and hold numbers as
    DECIMAL text.  Stored per load of a table, the rows of all loads merge with
    ``merged_profile``: no earlier data is read again."""
    entries = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        value = c if kind in ("int", "bigint", "string", "binary") else _text_of(c, kind)
        order = not kind.startswith(("array", "map", "struct", "variant", "binary"))
        number = kind in ("float", "double") or kind.startswith("decimal")

        def edge(agg):
            if not order:
                return F.lit(None).cast("string")
            return (agg(c).cast("decimal(38,6)") if number else agg(c)).cast("string")

        entries.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(kind).alias("type"), F.count(F.lit(1)).alias("rows"),
                                F.count_if(c.isNull()).alias("nulls"), edge(F.min).alias("min_value"), edge(F.max).alias("max_value"),
                                F.hll_sketch_agg(value).alias("sketch")))
    return df.agg(F.array(*entries).alias("e")).select(F.lit(table).alias("table_name"), F.inline("e"))


def merged_profile(parts: DataFrame) -> DataFrame:
    """(table_name, column_name, type, rows, nulls, min_value, max_value,
    distinct_count) from the rows of ``profile_sketches``; the distinct count is the
    merged sketch's estimate (within about 2 percent)."""
    number = F.col("type").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col("type").startswith("decimal")
    def edge(agg, name):  # numbers by value, the rest by text
        return agg(F.when(F.col(name).isNotNull(), F.transform(F.array(name), lambda v: F.struct(
            F.when(number, v.try_cast("decimal(38,6)")).alias("n"), v.alias("v")))[0]))["v"].alias(name)

    merged = parts.groupBy("table_name", "column_name", "type").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), edge(F.min, "min_value"), edge(F.max, "max_value"),
        F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("table_name", "column_name", "type", "rows", "nulls", "min_value", "max_value",
                         F.hll_sketch_estimate("sketch").alias("distinct_count"))


def describe_columns(df: DataFrame) -> DataFrame:
    """Column description rows (name, type, nullable Y/N, default, comment)
    from a DataFrame's schema -- metadata only, no data is read.  The
    ``comment`` comes from the field metadata when a table carries one."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), "Y" if f.nullable else "N", "",
             str((f.metadata or {}).get("comment", ""))) for f in df.schema.fields]
    return spark.createDataFrame(rows, "name string, type string, nullable string, default string, comment string")
