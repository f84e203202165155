"""T1-T3 topological operators and G4-G6, J1, J2 lookups on tables of graphs.

The reference orders one small graph in memory.  A Spark user holds a table
of many saved graphs: ``nodes(graph_id, id, pos, type, ...)`` and
``edges(graph_id, source, target[, epos])``.  Every operator here works on all
graphs at once and keys its joins and windows by ``graph_id`` plus the node
id, so one large graph does not become one hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecraft.functions.scalars import object_name
from stagecraft.operators.ranking import row_numbers
from stagecraft.session import remove, spread

G, ID = "graph_id", "id"


#: Nodes and edges of a graph that one task orders as a whole; larger graphs are
#: ordered level by level by the cluster.
WHOLE = 100_000
#: Rows that a task gathers of whole graphs before it orders them together.
TOGETHER = 50_000
#: Out-edges of a node that one join key may hold; the rest go to further salts.
HUB = 50_000


def topological_levels(nodes: DataFrame, edges: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(graph_id, id, [carry...], level) -- see ``_kahn``."""
    return _kahn(nodes, edges, carry)[0]


def _kahn(nodes: DataFrame, edges: DataFrame, carry: list[str] | None = None,
          whole: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Kahn's algorithm, breadth first, over all graphs at once.

    A node is peeled once all its in-edges' sources are; its level is the longest
    path from a root.  Edges from unknown nodes never count down, so their targets
    -- like every node in or behind a cycle -- are never peeled (T3 reports them).
    ``carry`` names node columns to keep, so a caller needs no join back.  Returns
    (levels, unpeeled).

    Plan at scale: graphs of up to ``whole`` nodes and edges are dealt to tasks by
    one shuffle and ordered there, many at a time (``_order_chunks``), however many
    levels they have.  Larger graphs, if the counts show any, are ordered by
    ``_kahn_log``, one small job a level, and no task holds one of them.  The result
    is written once; the tables of the way there are deleted.
    """
    from stagecraft.session import materialize
    whole = WHOLE if whole is None else whole
    carry = list(carry or [])
    n = nodes.select(G, ID, *carry)
    e = edges.select(G, "source", "target")
    sizes = n.select(G).unionAll(e.select(G)).groupBy(G).agg(F.count(F.lit(1)).alias("__n"))
    big = materialize(sizes.filter(F.col("__n") > whole).select(F.col(G).alias("__g")), "t1_big")
    some = not big.isEmpty()

    def side(df: DataFrame, how: str) -> DataFrame:
        return df.join(big, F.col(G).eqNullSafe(F.col("__g")), how) if some else df

    small_n, small_e = side(n, "left_anti"), side(e, "left_anti")
    rows = small_n.select(G, F.lit(0).alias("__k"), F.col(ID), F.lit(None).cast(n.schema[ID].dataType).alias("target"), *carry).unionByName(
        small_e.select(G, F.lit(1).alias("__k"), F.col("source").alias(ID), "target"), allowMissingColumns=True)
    schema = T.StructType([*n.schema.fields, T.StructField("level", T.IntegerType())])
    done = rows.repartition(G).sortWithinPartitions(G, "__k").mapInArrow(_order_chunks(n.columns), schema)
    drop = []
    if some:
        large, drop = _kahn_log(side(n, "left_semi").dropDuplicates([G, ID]), side(e, "left_semi"), carry)
        done = done.unionByName(large)
    done = materialize(done, "t1_levels")
    for path in drop:
        remove(nodes.sparkSession, path)
    return done.filter(F.col("level").isNotNull()), done.filter(F.col("level").isNull()).select(G, ID)


def _order_chunks(columns: list[str]):
    """Orders the whole graphs of rows sorted by (graph, nodes first)."""
    def levels(table):
        import numpy as np
        import pyarrow as pa
        graph = table.column(G).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        ends = pa.concat_arrays([table.column(c).combine_chunks() for c in (ID, "target")])
        code = ends.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        width, edge = int(code.max(initial=0)) + 1, table.column("__k").to_numpy() == 1
        first, last = graph * width + code[:len(graph)], graph * width + code[len(graph):]
        node, row = np.unique(first[~edge], return_index=True)
        at = lambda key: np.minimum(np.searchsorted(node, key), max(len(node) - 1, 0))
        source, target = at(first[edge]), at(last[edge])
        known = node[target] == last[edge] if len(node) else np.zeros(int(edge.sum()), bool)
        waits = np.bincount(target[known], minlength=len(node))
        known &= node[source] == first[edge] if len(node) else known
        order = np.argsort(source[known], kind="stable")
        source, target = source[known][order], target[known][order]
        start = np.searchsorted(source, np.arange(len(node) + 1))
        level = np.full(len(node), -1, np.int32)
        ready, r = np.flatnonzero(waits == 0), 0
        while len(ready):
            level[ready] = r
            n = start[ready + 1] - start[ready]
            out = target[np.repeat(start[ready] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            np.subtract.at(waits, out, 1)
            ready, r = np.unique(out[waits[out] == 0]), r + 1
        kept = table.take(np.flatnonzero(~edge)[row]).select(columns)
        return kept.append_column("level", pa.array(level, pa.int32(), mask=level < 0)).combine_chunks().to_batches()

    def run(batches):
        import pyarrow as pa
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            graph = table.column(G).combine_chunks()
            codes = graph.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int((codes != codes[-1]).sum())  # the last graph may go on in the next batch
            if cut:
                yield from levels(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size -= cut
        if held:
            yield from levels(pa.Table.from_batches(held))

    return run


def _kahn_log(nodes: DataFrame, edges: DataFrame, carry: list[str]) -> tuple[DataFrame, list[str]]:
    """Levels of large graphs ((graph_id, id, carry, level), null if never peeled),
    and the folders to delete once that is written.

    Nodes (with their in-degrees) and edges are written once.  A level's job joins
    the nodes peeled last with their out-edges, counts these by target, and logs for
    each touched target how many in-edges are left; those with none are the next
    level.  Nothing else is written, so all levels together write one row per edge at
    most; the log is compacted whenever it has doubled.  A node with more than ``HUB``
    out-edges spreads them over several join keys.
    """
    from pyspark.sql import Observation
    from stagecraft.session import write_once
    spark = nodes.sparkSession
    drop = []

    def write(df: DataFrame, tag: str, **counts) -> tuple[DataFrame, dict]:
        if counts:
            obs = Observation()
            df = df.observe(obs, *[c.alias(k) for k, c in counts.items()])
        out, path = write_once(df, tag)
        drop.append(path)
        return out, obs.get if counts else {}

    out_degree = edges.groupBy(G, F.col("source").alias(ID)).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts"))
    in_degree = edges.groupBy(G, F.col("target").alias(ID)).agg(F.count(F.lit(1)).alias("waits"))
    state, _ = write(nodes.join(in_degree, [G, ID], "left").join(out_degree, [G, ID], "left").select(
        G, ID, *carry, F.coalesce("waits", F.lit(0)).alias("waits"), F.coalesce("salts", F.lit(0)).alias("salts")), "t1_state")
    hubs = state.filter("salts > 1").select(G, F.col(ID).alias("source"), "salts")
    links, _ = write(edges.join(hubs, [G, "source"], "left").select(
        G, "source", "target", F.when(F.col("salts") > 1, F.pmod(F.hash("target"), "salts")).otherwise(0).alias("salt")), "t1_edges")
    ready = state.filter("waits = 0")
    parts, level = [ready.select(G, ID, *carry, F.lit(0).alias("level"))], 0
    log, logged, compact = None, 0, 0
    while True:
        level += 1
        sources = ready.filter("salts > 0").select(G, F.col(ID).alias("source"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        step = links.join(sources, [G, "source", "salt"]).groupBy(G, F.col("target").alias(ID)).agg(F.count(F.lit(1)).alias("now"))
        if log is not None:
            step = step.join(log.groupBy(G, ID).agg(F.sum("done").alias("before")), [G, ID], "left")
        else:
            step = step.withColumn("before", F.lit(0).cast("long"))
        step = step.join(state.select(G, ID, *carry, "waits", "salts"), [G, ID]).select(
            G, ID, *carry, F.col("now").alias("done"), "salts", (F.col("waits") - F.coalesce("before", F.lit(0)) - F.col("now")).alias("waits"))
        step, n = write(step, "t1_log", ready=F.count_if(F.col("waits") == 0), waiting=F.count_if(F.col("waits") > 0))
        waiting = step.filter("waits > 0").select(G, ID, "done")
        log, logged = waiting if log is None else log.unionAll(waiting), logged + n["waiting"]
        if not n["ready"]:
            break
        ready = step.filter("waits = 0")
        parts.append(ready.select(G, ID, *carry, F.lit(level).alias("level")))
        if logged > 2 * compact + 1000 or level % 64 == 0:
            log, n = write(log.groupBy(G, ID).agg(F.sum("done").alias("done")), "t1_log", rows=F.count(F.lit(1)))
            logged = compact = n["rows"]
        if len(parts) >= 64:  # few parts, so that plans stay small
            joined, _ = write(reduce(DataFrame.unionAll, parts), "t1_parts")
            parts = [joined]
    peeled = reduce(DataFrame.unionAll, parts)
    never = state.join(peeled.select(G, ID), [G, ID], "left_anti").select(G, ID, *carry, F.lit(None).cast("int").alias("level"))
    return peeled.unionAll(never), drop


def topological_order(nodes: DataFrame, edges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, level, ord): a valid order -- by level, then by
    position -- numbered per graph from 1."""
    if levels is None:
        lv = topological_levels(nodes, edges, carry=["pos"])
    elif "pos" in levels.columns:
        lv = levels
    else:
        lv = levels.join(nodes.select(G, ID, "pos"), [G, ID])
    # Numbered by a distributed sort, not a window per graph: a graph holding
    # a large share of all nodes is spread over many tasks.
    return row_numbers(lv, [G], ["level", "pos", ID], "ord").select(G, ID, "level", "ord")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Nodes that no order reaches: in a cycle, behind one, or fed by an
    edge from an unknown node."""
    if levels is None:
        return _kahn(nodes, edges)[1]
    return nodes.select(G, ID).join(levels.select(G, ID), [G, ID], "left_anti")


def in_degree(nodes: DataFrame, edges: DataFrame, rows: int = 0) -> DataFrame:
    """(graph_id, id, in_degree) with 0 for nodes without in-edges.  ``rows``,
    the number of nodes if known, spreads large graphs over tasks (``spread``)."""
    deg = spread(edges.select(G, F.col("target").alias(ID)), rows, G, ID).groupBy(G, ID).agg(F.count(F.lit(1)).alias("in_degree"))
    return (spread(nodes.select(G, ID), rows, G, ID).join(deg, [G, ID], "left")
                 .select(G, ID, F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree")))


# Kinds a node can be bucketed in.
KINDS = ("stage", "table", "task", "stream")


def kind_of(type_col) -> F.Column:
    t = F.col(type_col) if isinstance(type_col, str) else type_col
    return (F.when(t.isin(*KINDS), t).when(t.startswith("ai_"), F.lit("ai")))


def nodes_by_kind(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """(graph_id, kind, rank, id, name): nodes put in buckets by kind
    (``ai_*`` by prefix, unknown kinds ignored), ranked inside each bucket in
    topological order (level, then position).  One row per node -- no list is
    collected per group -- and numbered by a distributed sort, so a large
    graph is not one task.  ``levels`` is T1's output; when it carries
    ``pos``, ``type`` and ``label`` no join back to ``nodes`` is needed."""
    need = ["pos", "type", "label"]
    src = levels if all(c in levels.columns for c in need) else \
        levels.select(G, ID, "level").join(nodes.select(G, ID, *need), [G, ID])
    named = src.select(G, ID, "pos", "level", kind_of("type").alias("kind"),
                       object_name(F.lit(""), F.col("label")).alias("name"))
    kept = named.filter(F.col("kind").isNotNull())
    return row_numbers(kept, [G, "kind"], ["level", "pos", ID], "rank").select(G, "kind", "rank", ID, "name")


def first_of_kind(nodes: DataFrame, levels: DataFrame, kinds=("stage", "table")) -> DataFrame:
    """(graph_id, kind, id): the first node of each kind in topological
    order -- a combinable ``min_by`` over (level, position, id), pre-aggregated
    before the shuffle; no numbering needed."""
    need = ["pos", "type"]
    src = levels if all(c in levels.columns for c in need) else \
        levels.select(G, ID, "level").join(nodes.select(G, ID, *need), [G, ID])
    return (src.select(G, ID, "pos", "level", kind_of("type").alias("kind"))
               .filter(F.col("kind").isin(*kinds))
               .groupBy(G, "kind").agg(F.min_by(ID, F.struct("level", "pos", ID)).alias(ID)))


def upstream(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(graph_id, id, upstream_id, epos) -- sources of the edges into each
    node that exist in the node table, optionally only those of a kind."""
    src = nodes.select(G, F.col(ID).alias("source"), F.col("type").alias("up_type"))
    if kind is not None:
        src = src.filter(F.col("up_type") == kind)
    return (edges.join(src, [G, "source"])
                 .select(G, F.col("target").alias(ID), F.col("source").alias("upstream_id"), "epos"))


def first_upstream(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """J1 as the reference uses it: the first upstream node of a kind (by
    edge position) for each node that has one."""
    return (upstream(nodes, edges, kind).groupBy(G, ID)
            .agg(F.min_by("upstream_id", "epos").alias("upstream_id")))


def downstream(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(graph_id, id, downstream_id) -- targets of the edges out of each node."""
    dst = nodes.select(G, F.col(ID).alias("target"), F.col("type").alias("down_type"))
    if kind is not None:
        dst = dst.filter(F.col("down_type") == kind)
    return (edges.join(dst, [G, "target"])
                 .select(G, F.col("source").alias(ID), F.col("target").alias("downstream_id")))
