"""User functions (the reference's procedures).

* U3 SQL scalar functions and U4 SQL table functions are temporary SQL
  functions: Catalyst inlines their bodies into the calling plan, so they
  cost nothing at run time.
* U5 Python functions become Arrow-batched pandas UDFs; Python table functions
  become Arrow table functions over a (partitioned, ordered) table argument.
Argument and return types are checked with the P9 type rules first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stagecraft.functions.types import IDENTIFIER, spark_type


def _args(args: Sequence[tuple[str, str]]) -> str:
    out = []
    for name, typ in args:
        if not re.fullmatch(IDENTIFIER, name):
            raise ValueError(f"Invalid argument name: {name}")
        out.append(f"{name} {spark_type(typ)}")
    return ", ".join(out)


def define_sql_function(spark: SparkSession, name: str, args: Sequence[tuple[str, str]],
                        returns: str, body: str) -> str:
    """CREATE TEMPORARY FUNCTION name(args) RETURNS type RETURN body."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"Invalid function name: {name}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_args(args)}) "
              f"RETURNS {spark_type(returns)} RETURN {body}")
    return name


def define_table_function(spark: SparkSession, name: str, args: Sequence[tuple[str, str]],
                          columns: Sequence[tuple[str, str]], select: str) -> str:
    """U4: CREATE TEMPORARY FUNCTION name(args) RETURNS TABLE (cols) RETURN select."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"Invalid function name: {name}")
    cols = _args(columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_args(args)}) "
              f"RETURNS TABLE ({cols}) RETURN {select}")
    return name


def define_python_udf(fn: Callable, returns: str, name: str | None = None,
                      spark: SparkSession | None = None):
    """A vectorised (pandas) UDF from ``fn(pandas.Series, ...) ->
    pandas.Series``; registered for SQL when ``name`` and ``spark`` are given."""
    udf = F.pandas_udf(fn, spark_type(returns))
    if name and spark is not None:
        spark.udf.register(name, udf)
    return udf


def define_python_table_function(spark: SparkSession, name: str, handler: type, columns: Sequence[tuple[str, str]]) -> str:
    """A Python table function for SQL: ``SELECT * FROM name(TABLE(t) PARTITION BY
    k ORDER BY o)``.  ``handler`` is a class made anew for each partition; ``eval``
    takes Arrow batches of its rows in their order and yields Arrow tables with
    ``columns``, ``terminate`` may yield more at the partition's end.  For results
    that hang on what came before; a partition's rows pass one task in batches."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"Invalid function name: {name}")
    if not callable(getattr(handler, "eval", None)):
        raise ValueError("a table function needs eval")
    spark.udtf.register(name, F.arrow_udtf(handler, returnType=_args(columns)))
    return name
