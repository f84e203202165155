"""Prompt and reply tables, F3 edge range filter and J3 id resolution.

A table of requests becomes a table of prompts (R1); a model (X11) answers
each; the answers are decoded (R3, R4) and turned into node and edge rows
(R5).  All steps are per-row expressions or equi-joins keyed by the reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.scalars import strip_fences
from stagecraft.operators.ranking import row_numbers

# Our system message (node types and reply shape) and the
# defaults for database and schema.
SYSTEM_PROMPT = (
    "You design data pipelines. Reply with one JSON object only: "
    '{"message": text, "nodes": [{"type", "label", "config"}], "edges": [{"source_index", "target_index"}]}. '
    "Node types: stage, table, task, stream, ai_extract, ai_classify, ai_parse_document, "
    "ai_summarize, ai_sentiment. Edges use 0-based positions in nodes.")
DEFAULT_DATABASE = "MY_DB"
DEFAULT_SCHEMA = "PUBLIC"


def render_prompts(df: DataFrame, user_col: str, system: str = SYSTEM_PROMPT,
                   database: Column | None = None, schema: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>>: the system message, then the user's
    request prefixed with database and schema (defaults MY_DB, PUBLIC)."""
    db = F.coalesce(database, F.lit(DEFAULT_DATABASE)) if database is not None else F.lit(DEFAULT_DATABASE)
    sc = F.coalesce(schema, F.lit(DEFAULT_SCHEMA)) if schema is not None else F.lit(DEFAULT_SCHEMA)
    user = F.format_string("Database: %s, Schema: %s. Request: %s", db, sc, F.col(user_col))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def transcripts(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", roles=("user", "assistant")) -> DataFrame:
    """R2: user and assistant messages in order: (conv, turn, ord, role, text,
    prev_role).  One row per message (no list per conversation).  ``ord`` is
    numbered by a distributed sort (a long conversation is not one task) and
    ``prev_role`` is an equi-join on (conv, ord - 1)."""
    kept = df.filter(F.col(role).isin(*roles)).select(conv, turn, role, text)
    numbered = row_numbers(kept, [conv], [turn], "ord")
    prev = numbered.select(conv, (F.col("ord") + 1).alias("ord"), F.col(role).alias("prev_role"))
    return (numbered.join(prev, [conv, "ord"], "left")
                    .select(conv, turn, "ord", role, text, "prev_role"))


def decode_replies(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``content`` (choices[0].messages, "" when absent) and
    ``outer_json``.  When the outer text is not JSON, the raw text is the
    message (and R4 gives no nodes or edges).  The text is parsed once into a
    column that the other expressions reference."""
    parsed = df.withColumn("__outer", F.try_parse_json(F.col(raw_col)))
    v = F.col("__outer")
    msg = F.try_variant_get(v, "$.choices[0].messages", "string")
    return (parsed.withColumn("outer_json", v.isNotNull())
                  .withColumn("content", F.when(v.isNull(), F.col(raw_col)).otherwise(F.coalesce(msg, F.lit(""))))
                  .drop("__outer"))


def reply_to_pipeline(df: DataFrame, content_col: str = "content", outer_col: str | None = "outer_json") -> DataFrame:
    """Fences stripped, ``{message, nodes, edges}`` parsed.  Not JSON (or
    not an object, e.g. literal ``null``) -> the text is the message and
    nodes and edges are empty.  Adds ``message``, ``nodes`` (ARRAY<VARIANT>),
    ``edges`` (ARRAY<VARIANT>) and ``is_pipeline``.  The reply is parsed once
    (one column), so the optimizer does not repeat the parse per field."""
    parsed = df.withColumn("__reply", F.try_parse_json(strip_fences(F.col(content_col))))
    v = F.col("__reply")
    ok = v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT"))
    if outer_col is not None:
        ok = ok & F.col(outer_col)
    flagged = parsed.withColumn("is_pipeline", ok)
    empty = F.array().cast("array<variant>")
    good = F.col("is_pipeline")
    nodes = F.coalesce(F.try_variant_get(v, "$.nodes", "array<variant>"), empty)
    edges = F.coalesce(F.try_variant_get(v, "$.edges", "array<variant>"), empty)
    return (flagged.withColumn("message", F.when(good, F.try_variant_get(v, "$.message", "string"))
                                           .otherwise(F.col(content_col)))
                   .withColumn("nodes", F.when(good, nodes).otherwise(empty))
                   .withColumn("edges", F.when(good, edges).otherwise(empty))
                   .drop("__reply"))


def reply_nodes(df: DataFrame, key: str = "reply_id") -> DataFrame:
    """R5, nodes: (key, pos, node_id, type, label, config) with generated ids."""
    # The _outer generator keeps the optimizer from copying the whole parse
    # into an inferred ``size(nodes) > 0`` filter below the explode.
    n = (df.select(key, F.posexplode_outer("nodes").alias("pos", "node"))
           .filter(F.col("pos").isNotNull()))
    return n.select(
        key, "pos",
        F.concat(F.lit("chat_"), F.col(key).cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("node_id"),
        F.try_variant_get("node", "$.type", "string").alias("type"),
        F.try_variant_get("node", "$.label", "string").alias("label"),
        F.to_json(F.try_variant_get("node", "$.config", "variant")).alias("config"))


def index_edges(df: DataFrame, key: str = "reply_id", keep: list[str] | None = None) -> DataFrame:
    """(key, n_nodes, source_index, target_index) of each reply's edges."""
    keep = keep or []
    e = (df.select(key, *keep, F.size("nodes").alias("n_nodes"), F.explode_outer("edges").alias("edge"))
           .filter(F.col("edge").isNotNull()))
    return e.select(key, *keep, "n_nodes",
                    F.try_variant_get("edge", "$.source_index", "int").alias("source_index"),
                    F.try_variant_get("edge", "$.target_index", "int").alias("target_index"))


def edges_in_range(edges: DataFrame) -> DataFrame:
    """keep edges whose two indexes lie in [0, n_nodes)."""
    s, t, n = F.col("source_index"), F.col("target_index"), F.col("n_nodes")
    return edges.filter((s >= 0) & (s < n) & (t >= 0) & (t < n))


def resolve_edges(nodes: DataFrame, index_edges_df: DataFrame, key: str = "reply_id") -> DataFrame:
    """Index pairs -> generated node ids, joining the node table twice on
    (key, position).  Out-of-range indexes find no node and drop out."""
    src = nodes.select(key, F.col("pos").alias("source_index"), F.col("node_id").alias("source"))
    dst = nodes.select(key, F.col("pos").alias("target_index"), F.col("node_id").alias("target"))
    return (index_edges_df.join(src, [key, "source_index"]).join(dst, [key, "target_index"])
                          .select(key, "source", "target"))


def replies_to_graph(df: DataFrame, key: str = "reply_id", raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Raw replies -> (nodes, edges) tables.

    Ids are generated from (key, position), so F3 and the id lookup of J3 are
    done inside each reply row (``element_at`` on the reply's id list): no
    join and no shuffle.  ``resolve_edges`` is the join form for node tables
    whose ids are not a function of the position."""
    parsed = reply_to_pipeline(decode_replies(df, raw_col))
    nodes = reply_nodes(parsed, key)
    # No filter on the parsed columns here: it would be pushed below the
    # projection and repeat the parse.  Rows without edges vanish at the
    # explode in ``index_edges``.
    ids = F.when(F.size("nodes") > 0, F.transform(
        F.sequence(F.lit(0), F.size("nodes") - 1),
        lambda i: F.concat(F.lit("chat_"), F.col(key).cast("string"), F.lit("_"), i.cast("string"))))
    with_ids = parsed.withColumn("__ids", ids)
    e = edges_in_range(index_edges(with_ids.select(key, "nodes", "edges", "__ids"), key, keep=["__ids"]))
    edges = e.select(key, F.element_at("__ids", F.col("source_index") + 1).alias("source"),
                     F.element_at("__ids", F.col("target_index") + 1).alias("target"))
    return nodes, edges
