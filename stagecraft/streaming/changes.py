"""ST1-ST3, ST8: change tracking between table versions (batch forms).

The reference's streams are change-tracking objects kept by a warehouse.
Here a change set is computed from two versions of a table (ST1), from a log
of row operations (ST2), or as inserted rows only (ST3).  All are joins or
grouped aggregates keyed by the table key, so they partition by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _comparable(c, type_: str):
    """VARIANT values are compared by their JSON text: they have no order."""
    return F.to_json(c) if "variant" in type_ else c


def changes(before: DataFrame, after: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """ST1 (STANDARD): rows with ``action`` INSERT/DELETE and ``is_update``.

    A full outer join on the key; rows whose whole image is equal (null-safe,
    ``<=>`` on a struct of all columns, VARIANT as JSON text) are dropped.  An update gives a DELETE
    of the old image and an INSERT of the new one, both ``is_update``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*cols).alias("__old"))
    a = after.select(*keys, F.struct(*cols).alias("__new"))
    types = dict(before.dtypes)

    def image(side):
        return F.struct(F.col(side).isNull().alias("gone"), *[_comparable(F.col(f"{side}.`{c}`"), types[c]).alias(c) for c in cols])
    j = b.join(a, keys, "full_outer").filter(~image("__old").eqNullSafe(image("__new")))
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    ev = F.array(
        F.when(F.col("__old").isNotNull(), F.struct(F.lit("DELETE").alias("action"), F.col("__old").alias("img"))),
        F.when(F.col("__new").isNotNull(), F.struct(F.lit("INSERT").alias("action"), F.col("__new").alias("img"))))
    out = j.select(*keys, both.alias("is_update"), F.explode(F.filter(ev, lambda x: x.isNotNull())).alias("ev"))
    return out.select(*keys, *[F.col(f"ev.img.{c}").alias(c) for c in cols],
                      F.col("ev.action").alias("action"), "is_update")


def apply_changes(before: DataFrame, delta: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inverse of ST1 (for checks): before minus deleted keys plus inserts."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in before.columns]
    dels = delta.filter(F.col("action") == "DELETE").select(*keys)
    ins = delta.filter(F.col("action") == "INSERT").select(*cols)
    return before.join(dels, keys, "left_anti").unionByName(ins)


def net_action():
    """The net change from columns ``first_op`` and ``last_op``; null if nothing is left."""
    return (F.when((F.col("first_op") == "INSERT") & (F.col("last_op") == "DELETE"), F.lit(None))
             .when(F.col("first_op") == "INSERT", "INSERT")
             .when(F.col("last_op") == "DELETE", "DELETE")
             .otherwise("UPDATE"))


def compact_log(log: DataFrame, key: str, seq: str, op: str = "op",
                images: Sequence[str] | None = None) -> DataFrame:
    """ST2: the net change per key between two reads of an operation log.

    First op INSERT and last op DELETE -> nothing; first INSERT -> INSERT of
    the last image; last DELETE -> DELETE; otherwise UPDATE (last image).
    ``min_by``/``max_by`` are combinable, so a key with a third of the log is
    pre-aggregated in every partition before the shuffle.
    """
    imgs = list(images) if images is not None else [c for c in log.columns if c not in (key, seq, op)]
    g = log.groupBy(key).agg(
        F.min_by(op, seq).alias("first_op"), F.max_by(op, seq).alias("last_op"),
        F.max_by(F.struct(*imgs), seq).alias("last_img"), F.count(F.lit(1)).alias("n_ops"))
    return (g.withColumn("action", net_action()).filter(F.col("action").isNotNull())
             .select(key, "action", "n_ops", *[F.col(f"last_img.{c}").alias(c) for c in imgs]))


def append_only(before: DataFrame, after: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """ST3 (APPEND_ONLY / INSERT_ONLY): inserted rows only -- keys new in
    ``after``; updates and deletes are not reported."""
    keys = [key] if isinstance(key, str) else list(key)
    return after.join(before.select(*keys), keys, "left_anti").withColumn("action", F.lit("INSERT"))


def stale(df: DataFrame, group: str, ts: str, as_of: str, retention: str = "14 days") -> DataFrame:
    """ST8: (group, last_ts, stale, state): a stream is stale when its newest
    change is older than ``as_of - retention``."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {retention}")
    g = df.groupBy(group).agg(F.max(ts).alias("last_ts"))
    st = F.col("last_ts") < cut
    return g.select(group, "last_ts", st.alias("stale"),
                    F.when(st, "Stale").otherwise("Fresh").alias("state"))


def stage_changes(before_listing: DataFrame, after_listing: DataFrame) -> DataFrame:
    """STANDARD stream on a stage: the difference of two stage listings
    keyed by path.  A new file is an INSERT, a deleted file a DELETE, and a
    file rewritten under the same path (new size or modification time) an
    update (DELETE + INSERT with ``is_update``) -- the case the file stream
    source (INSERT_ONLY) does not see."""
    cols = ["relative_path", "size", "last_modified"]
    return changes(before_listing.select(*cols), after_listing.select(*cols), "relative_path")
