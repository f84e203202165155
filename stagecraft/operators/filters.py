"""F1-F4 filters.  All are Catalyst predicates: pushed into the Parquet scan
where the column allows it, otherwise evaluated in the scan's stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.types import is_identifier


def name_search(df: DataFrame, col: str, text: str | None) -> DataFrame:
    """case-insensitive substring match; an empty search keeps all rows."""
    if not text:
        return df
    return df.filter(F.contains(F.lower(F.col(col)), F.lit(text.lower())))


def valid_columns(df: DataFrame, col: str = "name") -> DataFrame:
    """keep column definitions with a non-empty, valid name."""
    return df.filter(F.coalesce(F.col(col), F.lit("")) != "").filter(is_identifier(col))


def where(df: DataFrame, predicate: str) -> DataFrame:
    """a user's WHERE clause (SQL text) as a filter; Catalyst pushes what
    it can into the scan."""
    return df.filter(F.expr(predicate))
