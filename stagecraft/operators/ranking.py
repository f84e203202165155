"""Row numbers inside groups without putting a group in one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task; a group holding a third of the table then runs on one core and
must fit its sort there.  ``row_numbers`` gives the same numbers from a
distributed sort instead:

1. range-partition and sort by (g, o): a hot group is spread over many
   partitions, each sorted;
2. inside each partition, rows are numbered per group in sort order
   (``mapInPandas`` over Arrow batches, carrying the last group across
   batches) -- this is the only per-partition imperative step;
3. a group continues from earlier partitions only at the start of a
   partition, so at most one piece per partition needs an offset: the
   offsets table has at most ``#partitions`` rows (a proven bound) and is
   broadcast; it comes from a pre-aggregated count per (partition, group).

Steps 1-2 are written once to the shared checkpoint folder (see
``session.materialize``), so step 3 and the final join read the same rows.

The order keys must make a total order inside each group (add a unique key),
so a task re-run after an executor loss reads the same rows in the same order
and gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _number_within_partition(by: list[str]):
    """Per-partition numbering of rows sorted by (by, order), vectorised with
    numpy; the last group of a batch carries over into the next batch."""
    def run(batches):
        import numpy as np
        last_key, last_n = None, 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                yield pdf.assign(__r=np.zeros(0, dtype="int64"))
                continue
            keys = pdf[by].astype(object).where(pdf[by].notna(), None)
            change = np.ones(n, dtype=bool)
            if n > 1:
                change[1:] = keys.iloc[1:].to_numpy() .__ne__(keys.iloc[:-1].to_numpy()).any(axis=1)
            starts = np.flatnonzero(change)
            grp = np.cumsum(change) - 1
            r = np.arange(n, dtype="int64") - starts[grp] + 1
            first = tuple(keys.iloc[0])
            if last_key is not None and first == last_key:
                r[grp == 0] += last_n
            last_key = tuple(keys.iloc[-1])
            last_n = int(r[-1])
            yield pdf.assign(__r=r)
    return run


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    by, keys = list(by), [*by, *order]
    from stagecraft.session import materialize
    s = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
           .withColumn("__p", F.spark_partition_id()))
    schema = T.StructType(list(s.schema.fields) + [T.StructField("__r", T.LongType(), False)])
    # Partition ids and in-partition numbers are computed in one pass and
    # written to the shared checkpoint folder, so the offsets below and the
    # final join read the same values (AQE or a re-run cannot move rows
    # between the two).
    numbered = materialize(s.mapInPandas(_number_within_partition(by), schema), "rank")
    # One row per (partition, group) after map-side pre-aggregation.
    pieces = numbered.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__p")
    offsets = (pieces.withColumn("__off", F.sum("__n").over(w) - F.col("__n"))
                     .filter(F.col("__off") > 0).drop("__n"))       # <= one row per partition
    # Offsets hold at most one row per range partition of the sort; the join is
    # null-safe, so a null group is a group like any other.
    o = offsets.select(F.col("__p").alias("__op"), *[F.col(b).alias(f"__o{i}") for i, b in enumerate(by)], "__off")
    on = F.col("__p") == F.col("__op")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__o{i}"))
    return numbered.join(o, on, "left").select(
        *df.columns, (F.coalesce("__off", F.lit(0)) + F.col("__r")).cast("bigint").alias(name))
