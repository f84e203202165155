"""S4 table scans, S5 views, S6 previews."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def table_scan(spark: SparkSession, name: str, sf_dir: str | None = None) -> DataFrame:
    """``SELECT * FROM name`` -- a catalog table or view, else a parquet table under ``sf_dir``."""
    if sf_dir is not None:
        return load(spark, sf_dir, name)
    return spark.table(name)


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver tables as temporary views (so user SQL can name them)."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def create_view(spark: SparkSession, name: str, definition: str, replace: bool = False) -> DataFrame:
    """``CREATE VIEW name AS <select>``.

    Like the reference there is no OR REPLACE by default, so a second creation
    with the same name fails.  The view is temporary (session scoped); its body
    is planned by Catalyst together with the query that reads it.  Only a query
    is accepted as the definition, no other statement.
    """
    if not replace and spark.catalog.tableExists(name):
        raise ValueError(f"view {name} already exists")
    quoted = name.replace("`", "``")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{quoted}` AS {definition}")  # only a query parses here
    return spark.table(name)


def preview(df: DataFrame, n: int = 100, order_by: list[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows under a total order (TakeOrderedAndProject: a
    per-partition top-n, then one merge of n rows per partition)."""
    cols = order_by or df.columns
    return df.orderBy(*cols).limit(n)
