"""Saved pipeline configs -> node and edge tables (load side of K5/O1/P5).

A table of saved configs ``(key, CONFIG)`` -- JSON text or VARIANT, possibly
encoded more than once by the store -- becomes ``nodes(graph_id, pos, id,
type, label, name)`` and ``edges(graph_id, source, target, epos)`` (the key is
renamed: a saved-config ``ID`` and a node ``id`` are the same name to Spark), the inputs of T1-T3,
G4-G6, J1, J2 and V1.  Per-row parsing and ``posexplode``; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.scalars import json_unwrap


def spec_tables(df: DataFrame, key: str = "ID", config_col: str = "CONFIG") -> tuple[DataFrame, DataFrame]:
    c = F.col(config_col)
    text = c.cast("string") if dict(df.dtypes)[config_col] != "variant" else F.to_json(c)
    parsed = df.select(F.col(key).alias("graph_id"), json_unwrap(text).alias("__v"))
    key = "graph_id"
    nodes = (parsed.select(key, F.posexplode_outer(F.try_variant_get("__v", "$.nodes", "array<variant>"))
                           .alias("pos", "n"))
                   .filter(F.col("n").isNotNull())
                   .select(key, "pos",
                           F.try_variant_get("n", "$.id", "string").alias("id"),
                           F.try_variant_get("n", "$.type", "string").alias("type"),
                           F.try_variant_get("n", "$.label", "string").alias("label"),
                           F.coalesce(F.try_variant_get("n", "$.config.name", "string"), F.lit("")).alias("name")))
    edges = (parsed.select(key, F.posexplode_outer(F.try_variant_get("__v", "$.edges", "array<variant>"))
                           .alias("epos", "e"))
                   .filter(F.col("e").isNotNull())
                   .select(key, F.try_variant_get("e", "$.source", "string").alias("source"),
                           F.try_variant_get("e", "$.target", "string").alias("target"), "epos"))
    return nodes, edges
