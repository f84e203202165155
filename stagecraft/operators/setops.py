"""J4 prefer-draft merge, U1 append, U2 distinct names, O1 recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Every row of ``first`` (the draft), then the rows of ``second``
    whose key is not in ``first``.  An anti join plus a union: no row of
    either side is merged or dropped otherwise."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def append_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``b`` added to ``a``, duplicates kept (UNION ALL)."""
    return a.unionByName(b, allowMissingColumns=True)


def distinct_names(df: DataFrame, col: str) -> DataFrame:
    """The set of names (one shuffle, pre-aggregated per partition)."""
    return df.select(col).distinct()


def recent(df: DataFrame, ts: str, n: int = 50, tie: str | None = None) -> DataFrame:
    """O1: newest ``n`` rows first, with a tie-break key so the cut is
    deterministic.  Planned as TakeOrderedAndProject: a top-n per partition,
    then one merge of at most n rows per partition."""
    order: list[Column] = [F.col(ts).desc()]
    if tie:
        order.append(F.col(tie).desc())
    return df.orderBy(*order).limit(n)
