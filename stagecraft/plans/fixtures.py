"""Tables derived from the driver tables for operators without natural data.

Each derivation exists twice: as a Spark plan (used by the registered
queries) and as a SQL CTE (used by their oracles).  All read whole tables;
the rules pick rows by their data (status, priority, flags, event type),
never by id ranges or sampling.

* pipeline graphs: one graph per order, one node per distinct (order, line
  number); edges go from a line to the next line, and from line 1 to every
  later line (>= 3) with return flag R.  Always upward, so a DAG.
  The cyclic variant adds a back edge (last line -> line 1) in orders with
  status P, and an edge from an unknown node ``n0`` to line 2 in orders with
  priority 1-URGENT.
* column definitions: one per part, name/type/nullable chosen from its data.
* chat replies: one per event, the reply shape chosen by event type.
* snapshots: orders before and after a change (deletes, inserts, updates).
* change log: events as row operations keyed by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.session import spread
from stagecraft.sources.tables import load

# Node type by line number.
NODE_TYPES = {1: "stage", 2: "ai_parse_document", 3: "ai_extract", 4: "ai_summarize",
              5: "table", 6: "stream", 7: "task"}


def _type_expr() -> F.Column:
    c = None
    for k, v in NODE_TYPES.items():
        c = F.when(F.col("pos") == k, v) if c is None else c.when(F.col("pos") == k, v)
    return c.otherwise("table")


def graph_size(spark: SparkSession, sf_dir: str) -> int:
    """Rows that the graphs are made of, from the files' footers."""
    return load(spark, sf_dir, "lineitem").count()


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_returnflag")
    # Spread before they are grouped: most rows are groups of their own.
    li = (spread(lines, graph_size(spark, sf_dir), "graph_id", "pos").groupBy("graph_id", "pos")
          .agg(F.min("l_partkey").alias("partkey"), F.bool_or(F.col("l_returnflag") == "R").alias("flag_r")))
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("label"))
    return (li.join(part, "partkey", "left")
              .select("graph_id", F.concat(F.lit("n"), F.col("pos").cast("string")).alias("id"), "pos",
                      _type_expr().alias("type"), "label", "flag_r"))


def graph_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    n = nodes if nodes is not None else graph_nodes(spark, sf_dir)
    rows = graph_size(spark, sf_dir)
    a = n.select("graph_id", F.col("id").alias("source"), F.col("pos").alias("spos"))
    b = n.select("graph_id", F.col("id").alias("target"), F.col("pos").alias("tpos"), "flag_r")
    nxt = (spread(a.withColumn("tpos", F.col("spos") + 1), rows, "graph_id", "tpos")
           .join(spread(b.drop("flag_r"), rows, "graph_id", "tpos"), ["graph_id", "tpos"]).select("graph_id", "source", "target", "spos", "tpos"))
    a1 = a.filter(F.col("spos") == 1)
    fan = (spread(a1, rows, "graph_id").join(spread(b.filter((F.col("tpos") >= 3) & F.col("flag_r")), rows, "graph_id"), "graph_id")
             .select("graph_id", "source", "target", "spos", "tpos"))
    return (nxt.unionByName(fan)
               .select("graph_id", "source", "target", (F.col("spos") * 16 + F.col("tpos")).alias("epos")))


def cyclic_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    n = nodes if nodes is not None else graph_nodes(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), "o_orderstatus", "o_orderpriority")
    last = n.groupBy("graph_id").agg(F.max("pos").alias("mp")).filter(F.col("mp") >= 2)
    back = (last.join(orders.filter(F.col("o_orderstatus") == "P"), "graph_id")
                .select("graph_id", F.concat(F.lit("n"), F.col("mp").cast("string")).alias("source"),
                        F.lit("n1").alias("target"), (F.col("mp") * 16 + 1).alias("epos")))
    unknown = (n.filter(F.col("pos") == 2).join(orders.filter(F.col("o_orderpriority") == "1-URGENT"), "graph_id")
                .select("graph_id", F.lit("n0").alias("source"), F.lit("n2").alias("target"), F.lit(2).alias("epos")))
    return graph_edges(spark, sf_dir, n).unionByName(back).unionByName(unknown)


def _type_sql() -> str:
    return "CASE pos " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NODE_TYPES.items()) + " ELSE 'table' END"


GRAPH_SQL = f"""
graph_nodes AS (
  SELECT graph_id, 'n' || pos AS id, pos, {_type_sql()} AS type, p.p_name AS label, flag_r
  FROM (SELECT l_orderkey AS graph_id, l_linenumber AS pos, min(l_partkey) AS partkey,
               bool_or(l_returnflag = 'R') AS flag_r
        FROM lineitem GROUP BY l_orderkey, l_linenumber) li
  LEFT JOIN part p ON p.p_partkey = li.partkey),
graph_edges AS (
  SELECT a.graph_id, a.id AS source, b.id AS target, a.pos * 16 + b.pos AS epos
  FROM graph_nodes a JOIN graph_nodes b ON a.graph_id = b.graph_id AND b.pos = a.pos + 1
  UNION ALL
  SELECT a.graph_id, a.id, b.id, a.pos * 16 + b.pos
  FROM graph_nodes a JOIN graph_nodes b ON a.graph_id = b.graph_id AND a.pos = 1 AND b.pos >= 3 AND b.flag_r),
cyclic_edges AS (
  SELECT * FROM graph_edges
  UNION ALL
  SELECT l.graph_id, 'n' || l.mp, 'n1', l.mp * 16 + 1
  FROM (SELECT graph_id, max(pos) AS mp FROM graph_nodes GROUP BY graph_id) l
  JOIN orders o ON o.o_orderkey = l.graph_id AND o.o_orderstatus = 'P' WHERE l.mp >= 2
  UNION ALL
  SELECT n.graph_id, 'n0', 'n2', 2 FROM graph_nodes n
  JOIN orders o ON o.o_orderkey = n.graph_id AND o.o_orderpriority = '1-URGENT' WHERE n.pos = 2)"""


# ---------------------------------------------------------------------------
# Column definitions (from part)
# ---------------------------------------------------------------------------
def column_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    name = (F.when(F.col("p_type") == "ECONOMY", F.col("p_name"))
             .when(F.col("p_type") == "SMALL", F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
             .otherwise(F.col("p_brand")))
    typ = (F.when(F.col("p_size") < 10, "varchar").when(F.col("p_size") < 20, "NUMBER(10,2)")
            .when(F.col("p_size") < 30, " int ").when(F.col("p_size") < 40, "JSON")
            .otherwise("VARCHAR(1) x (y)"))
    return p.select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("table_name"),
                    F.col("p_partkey").alias("ord"), name.alias("name"), typ.alias("type"),
                    (F.col("p_retailprice") > 1000).alias("nullable"))


COLUMN_DEFS_SQL = """
column_defs AS (
  SELECT replace(p_brand, '#', '_') AS table_name, p_partkey AS ord,
         CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_type = 'SMALL' THEN upper(replace(p_name, ' ', '_'))
              ELSE p_brand END AS name,
         CASE WHEN p_size < 10 THEN 'varchar' WHEN p_size < 20 THEN 'NUMBER(10,2)' WHEN p_size < 30 THEN ' int '
              WHEN p_size < 40 THEN 'JSON' ELSE 'VARCHAR(1) x (y)' END AS type,
         p_retailprice > 1000 AS nullable
  FROM part)"""


# ---------------------------------------------------------------------------
# Chat replies (from events)
# ---------------------------------------------------------------------------
def _inner_reply(uid, value, etype):
    """The inner reply JSON text: message, three nodes, two or three edges."""
    bad = (F.floor(value).cast("bigint") % 5) - 1            # -1 .. 3: sometimes out of range
    step = F.when(etype == "purchase", "ai_classify").otherwise("ai_extract")
    return F.concat(
        F.lit('{"message": "Pipeline for user '), uid.cast("string"),
        F.lit('", "nodes": [{"type": "stage", "label": "Files '), uid.cast("string"),
        F.lit('", "config": {"name": "STG_'), uid.cast("string"),
        F.lit('"}}, {"type": "'), step,
        F.lit('", "label": "Step", "config": {}}, {"type": "table", "label": "Out table", "config": {}}], '
              '"edges": [{"source_index": 0, "target_index": 1}, {"source_index": 1, "target_index": 2}, '
              '{"source_index": 1, "target_index": '), bad.cast("string"), F.lit("}]}"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reply_id, raw): the outer reply text per event.

    view -> fenced JSON reply; purchase -> fence without ``json``; click ->
    plain JSON reply; signup -> plain text message; error -> outer text that
    is not JSON.
    """
    e = load(spark, sf_dir, "events")
    et, uid, val = F.col("event_type"), F.col("user_id"), F.col("value")
    inner = _inner_reply(uid, val, et)
    content = (F.when(et == "view", F.concat(F.lit("```json\n"), inner, F.lit("\n```")))
                .when(et == "purchase", F.concat(F.lit("```\n"), inner, F.lit("\n```")))
                .when(et == "click", inner)
                .otherwise(F.concat(F.lit("Sorry, I can only build pipelines. Props were "), F.col("props"))))
    outer = F.to_json(F.struct(F.array(F.struct(content.alias("messages"))).alias("choices")))
    raw = F.when(et == "error", F.concat(F.lit("upstream failure: "), F.col("props"))).otherwise(outer)
    return e.select(F.col("event_id").alias("reply_id"), raw.alias("raw"))


REPLIES_SQL = """
replies AS (
  SELECT event_id AS reply_id,
         CASE WHEN event_type = 'error' THEN 'upstream failure: ' || props
              ELSE to_json(struct_pack(choices := [struct_pack(messages := content)]))::VARCHAR END AS raw
  FROM (SELECT *,
          CASE WHEN event_type = 'view' THEN '```json' || chr(10) || inner_reply || chr(10) || '```'
               WHEN event_type = 'purchase' THEN '```' || chr(10) || inner_reply || chr(10) || '```'
               WHEN event_type = 'click' THEN inner_reply
               ELSE 'Sorry, I can only build pipelines. Props were ' || props END AS content
        FROM (SELECT *,
                '{"message": "Pipeline for user ' || user_id::VARCHAR ||
                '", "nodes": [{"type": "stage", "label": "Files ' || user_id::VARCHAR ||
                '", "config": {"name": "STG_' || user_id::VARCHAR ||
                '"}}, {"type": "' || CASE WHEN event_type = 'purchase' THEN 'ai_classify' ELSE 'ai_extract' END ||
                '", "label": "Step", "config": {}}, {"type": "table", "label": "Out table", "config": {}}], '
                || '"edges": [{"source_index": 0, "target_index": 1}, {"source_index": 1, "target_index": 2}, '
                || '{"source_index": 1, "target_index": ' || ((floor(value)::BIGINT % 5) - 1)::VARCHAR || '}]}' AS inner_reply
              FROM events) a) b)"""


# ---------------------------------------------------------------------------
# Snapshots and change logs
# ---------------------------------------------------------------------------
SNAP_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """before: orders without priority 5-LOW; after: orders without 1-URGENT,
    with the price of open 2-HIGH orders raised by 1."""
    o = load(spark, sf_dir, "orders").select(*SNAP_COLS)
    before = o.filter(F.col("o_orderpriority") != "5-LOW")
    after = (o.filter(F.col("o_orderpriority") != "1-URGENT")
              .withColumn("o_totalprice",
                          F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH"),
                                 F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return before, after


SNAPSHOT_SQL = """
before AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
           WHERE o_orderpriority <> '5-LOW'),
after AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                 CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END
                   AS o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT')"""


def change_log(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(user_id, seq, op, value, props) and the columns ``more`` of the events:
    signup -> INSERT, error -> DELETE, anything else -> UPDATE."""
    e = load(spark, sf_dir, "events")
    op = (F.when(F.col("event_type") == "signup", "INSERT")
           .when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE"))
    return e.select("user_id", F.col("event_id").alias("seq"), op.alias("op"), "value", "props", *more)


CHANGE_LOG_SQL = """
change_log AS (SELECT user_id, event_id AS seq,
                      CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE'
                           ELSE 'UPDATE' END AS op, value, props FROM events)"""
