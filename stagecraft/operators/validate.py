"""V1, V2: validation of many pipeline specs and column definitions at once.

Each rule is a boolean column; a row gets one output row per broken rule
(``explode`` of the filtered rule array), so the result is a violation table
that can be joined back or counted -- no Python loop over specs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.scalars import object_name
from stagecraft.functions.types import NODE_TYPES, is_identifier, is_valid_type


def _violations(df: DataFrame, keys: list[str], rules: list[tuple[str, F.Column]]) -> DataFrame:
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return (df.select(*keys, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("violation")))


def validate_columns(columns: DataFrame, table: str = "table_name", name: str = "name",
                     type_: str = "type", tables: DataFrame | None = None) -> DataFrame:
    """V2: (table, name, violation) for bad names and types; ``empty_name`` covers
    blank names.  ``tables`` lists all table definitions: one without any column
    gives ``no_columns`` with a null name."""
    nm = F.coalesce(F.col(name), F.lit(""))
    rules = [
        ("empty_name", nm == ""),
        ("invalid_name", (nm != "") & ~is_identifier(name)),
        ("invalid_type", ~is_valid_type(type_)),
    ]
    out = _violations(columns, [table, name], rules)
    if tables is not None:
        bare = tables.select(table).distinct().join(columns.select(table), table, "left_anti")
        out = out.unionByName(bare.select(table, F.lit(None).cast("string").alias(name), F.lit("no_columns").alias("violation")))
    return out


def validate_pipelines(specs: DataFrame, nodes: DataFrame, key: str = "graph_id") -> DataFrame:
    """V1: (key, node id, violation) over a table of specs ``(key, database,
    schema)`` and their nodes ``(key, id, type, label, name)``.

    Rules: bad database or schema name, no nodes, bad node name, duplicate
    node name in one pipeline, unknown node type.
    """
    spec_rules = [
        ("invalid_database", ~is_identifier("database")),
        ("invalid_schema", ~is_identifier("schema")),
    ]
    counts = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"))
    s = specs.join(counts, key, "left")
    spec_v = _violations(s.withColumn("id", F.lit(None).cast("string")), [key, "id"],
                         spec_rules + [("empty_pipeline", F.coalesce(F.col("n_nodes"), F.lit(0)) == 0)])
    known = NODE_TYPES
    named = nodes.withColumn("obj_name", object_name(F.col("name"), F.col("label")))
    # Duplicates from a combinable count per (pipeline, name), joined back;
    # no window has to hold one pipeline's nodes in one task.
    dups = (named.groupBy(key, "obj_name").agg(F.count(F.lit(1)).alias("__n"))
                 .filter(F.col("__n") > 1).select(key, "obj_name", F.lit(True).alias("dup")))
    flagged = named.join(dups, [key, "obj_name"], "left").withColumn("dup", F.coalesce("dup", F.lit(False)))
    node_v = _violations(flagged, [key, "id"], [
        ("invalid_name", ~is_identifier("obj_name")),
        ("duplicate_name", F.col("dup")),
        ("unknown_type", F.col("type").isNull() | ~F.col("type").isin(*known)),
    ])
    return spec_v.unionByName(node_v)
