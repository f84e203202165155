"""K1-K5 table definition and writes, C1 not-null checks, A1-A3 column changes.

Plain Parquet tables have no update, delete, identity or enforced NOT NULL,
so those are DataFrame jobs: cast and check before writing, append, or write
a new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.functions.scalars import DEFAULT_COLUMNS
from stagecraft.functions.types import IDENTIFIER, SPARK_TYPES, spark_type, type_base

import re


def _cols(columns) -> list[dict]:
    out = []
    for c in columns:
        if isinstance(c, dict):
            out.append({"name": c.get("name"), "type": c.get("type"), "nullable": c.get("nullable", True)})
        else:
            name, typ, *rest = c
            out.append({"name": name, "type": typ, "nullable": rest[0] if rest else True})
    return out


def _to_type(c: Column, t: str) -> Column:
    if t == "variant":
        # JSON text becomes its value; other text becomes a JSON string value.
        return F.coalesce(F.try_parse_json(c.cast("string")),
                          F.try_variant_get(F.parse_json(F.to_json(F.array(c.cast("string")))), "$[0]", "variant"))
    text = c.cast("string")
    if t == SPARK_TYPES["TIMESTAMP_TZ"]:
        # The instant, and the offset it was written with (the session's zone without one).
        zone = F.regexp_extract(text, ZONE, 1)
        zone = F.when(zone == "", F.current_timezone()).when(F.upper(zone) == "Z", "+00:00").otherwise(
            F.regexp_replace(F.regexp_replace(zone, "^UTC|^GMT", ""), r"^([+-])(\d\d):?(\d\d)?$", "$1$2:$3"))
        zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
        return F.when(c.isNotNull(), F.struct(text.cast("timestamp").alias("ts"), zone.alias("tz")))
    if t in (SPARK_TYPES["OBJECT"], SPARK_TYPES["ARRAY"]):
        return F.parse_json(text).cast(t)
    if t == TIME:
        parts = F.regexp_extract(F.trim(text), CLOCK, 0)
        whole = F.when(F.length(parts) == 5, F.concat(parts, F.lit(":00"))).otherwise(parts)
        return F.when(c.isNull(), None).when(parts == "", F.raise_error(F.concat(F.lit("no time of day: "), text))).otherwise(whole)
    return c.cast("string" if t.startswith(("varchar", "char")) else t)


#: A time of day stays text (Spark's own type for it is off by default), checked and
#: with seconds; a declared TIME is told from plain text by its name.
TIME = "time"
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"
ZONE = r"\d\d:\d\d(?::\d\d(?:\.\d+)?)?\s*(Z|z|(?:UTC|GMT)?[+-]\d\d(?::?\d\d)?)$"


def _declared_type(declared: str) -> str:
    return TIME if type_base(declared) == "TIME" else spark_type(declared)


def apply_schema(df: DataFrame, columns, source_names: Sequence[str] | None = None) -> DataFrame:
    """K1 (data side): project ``df`` onto the declared columns, casting each
    (ANSI casts: a bad value, or a null in a NOT NULL column, fails the job).  ``source_names`` maps declared
    columns to input columns by position (default: same names)."""
    cols = _cols(columns)
    src = list(source_names) if source_names else [c["name"] for c in cols]
    out = df.select(*[_to_type(F.col(s), _declared_type(c["type"])).alias(c["name"]) for s, c in zip(src, cols)])
    return enforce_not_null(out, [c["name"] for c in cols if not c["nullable"]])


def violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, failing_rows): one pass of conditional counts, then
    unpivoted.  Use ``enforce_not_null`` to fail a write instead."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, failing_rows)")


def enforce_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C1 as a constraint: the job fails on the first null (``raise_error``)."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c).isNull(),
                                       F.raise_error(F.lit(f"NOT NULL constraint violated: {c}")))
                              .otherwise(F.col(c)))
    return out


#: Table property that names the NOT NULL columns, which plain Parquet tables do not keep.
NOT_NULL = "stagecraft.not_null"


def create_table(spark: SparkSession, name: str, columns, comment: str | None = None,
                 if_not_exists: bool = False, location: str | None = None) -> None:
    """K1/K2 (catalog side): CREATE TABLE with checked names and types.
    K2 drops columns with bad names silently and uses the default columns
    when none are given, as the reference does."""
    cols = _cols(columns) if columns else _cols(DEFAULT_COLUMNS)
    if if_not_exists:
        cols = [c for c in cols if c["name"] and re.fullmatch(IDENTIFIER, c["name"])]
    if not cols:
        raise ValueError("a table needs one or more columns")
    for c in cols:
        if not c["name"] or not re.fullmatch(IDENTIFIER, c["name"]):
            raise ValueError(f"column name not usable: {c['name']!r}")
    defs = ", ".join(f"`{c['name']}` {spark_type(c['type'])}" for c in cols)
    sql = f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{name} ({defs}) USING parquet"
    if location:
        sql += " LOCATION '" + location.replace("'", "\\'") + "'"
    needed = [c["name"] for c in cols if not c["nullable"]]
    if needed:
        sql += f" TBLPROPERTIES ('{NOT_NULL}' = '{','.join(needed)}')"
    if comment:
        sql += " COMMENT " + "'" + comment.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(sql)


def ensure_table(spark: SparkSession, name: str, columns=None, location: str | None = None) -> None:
    """K2: CREATE TABLE IF NOT EXISTS with the default output columns."""
    create_table(spark, name, columns, if_not_exists=True, location=location)


def append_into(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> None:
    """K3: INSERT INTO table (cols) SELECT ... -- by name, cast to the table's
    types; a null in a column declared NOT NULL fails the write.  Every call appends again (the reference re-reads the whole stage
    each run, so rows repeat); K4 is the exactly-once form."""
    spark = df.sparkSession
    target = spark.table(table)
    names = list(columns) if columns else target.columns
    types = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    out = df.select(*[_to_type(F.col(n), types[n]).alias(n) for n in names])
    for n in target.columns:
        if n not in names:
            out = out.withColumn(n, F.lit(None).cast(types[n]))
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    needed = [n for n in properties.get(NOT_NULL, "").split(",") if n]
    enforce_not_null(out.select(*target.columns), needed).write.insertInto(table)


def append_new(df: DataFrame, table: str, key: str = "FILE_NAME") -> None:
    """K4: append only rows whose key the table does not hold yet (anti join
    on the key; AQE broadcasts the smaller side when it is small)."""
    spark = df.sparkSession
    fresh = df.join(spark.table(table).select(key).distinct(), key, "left_anti")
    append_into(fresh, table)


def dense_ids(df: DataFrame, order: str, start: Column | int = 0, name: str = "ID") -> DataFrame:
    """Dense ids ``start+1 ..`` in ``order`` without a single-partition window:
    a distributed sort, numbers inside each partition and one offset per
    partition (``ranking.row_numbers`` with no group key)."""
    from stagecraft.operators.ranking import row_numbers
    base = F.lit(start) if isinstance(start, int) else start
    numbered = row_numbers(df.withColumn("__all", F.lit(0)), ["__all"], [order], "__rn")
    return numbered.withColumn(name, (base + F.col("__rn")).cast("bigint")).drop("__all", "__rn")


def save_configs(df: DataFrame, table: str | None = None, name_col: str = "NAME",
                 config_col: str = "CONFIG", order: str | None = None,
                 created_at: str | None = None) -> DataFrame:
    """K5: (ID, NAME, CONFIG VARIANT, CREATED_AT): trimmed name, JSON text
    parsed to VARIANT, ids continuing after the table's largest id, default
    time now.  Appends to ``table`` when given and returns the new rows."""
    spark = df.sparkSession
    start = 0
    if table is not None and spark.catalog.tableExists(table):
        start = spark.table(table).select(F.coalesce(F.max("ID"), F.lit(0))).scalar()
    at = F.lit(created_at).cast("timestamp_ntz") if created_at else F.localtimestamp()
    rows = df.select(F.trim(F.col(name_col)).alias("NAME"), F.parse_json(F.col(config_col)).alias("CONFIG"),
                     at.alias("CREATED_AT"), F.col(order or name_col).alias("__ord"))
    out = dense_ids(rows, "__ord", start).select("ID", "NAME", "CONFIG", "CREATED_AT")
    if table is not None:
        # The ids depend on the table's current largest id: fix the new rows
        # once, so the rows returned are the rows appended.
        from stagecraft.session import materialize
        out = materialize(out, "k5")
        out.write.mode("append").saveAsTable(table)
    return out


def add_column(df: DataFrame, name: str, type_: str, nullable: bool = True, default=None) -> DataFrame:
    """A1: ALTER TABLE ADD COLUMN; a NOT NULL column needs a default."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"column name not usable: {name!r}")
    if not nullable and default is None:
        raise ValueError("a NOT NULL column needs a default")
    return df.withColumn(name, F.lit(default).cast(spark_type(type_)))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """A2: ALTER TABLE DROP COLUMN (a projection; write it as a new version)."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """A3: rename a column."""
    if old not in df.columns:
        raise ValueError(f"no column {old}")
    if not re.fullmatch(IDENTIFIER, new):
        raise ValueError(f"column name not usable: {new!r}")
    return df.withColumnRenamed(old, new)
