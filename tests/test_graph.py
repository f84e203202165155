"""Topological operators on literal graphs: one node, chain, diamond, two
roots, double edge, cycle, node behind a cycle, edge from an unknown node,
empty graph -- all in one table of graphs."""

import random

from stagecraft.operators import graph as GR

NODES = [
    (1, "a", 1, "stage", "A"),                                       # one node
    (2, "a", 1, "stage", "A"), (2, "b", 2, "table", "B"), (2, "c", 3, "task", "C"),     # chain
    (3, "a", 1, "stage", "A"), (3, "b", 2, "ai_extract", "B"), (3, "c", 3, "ai_summarize", "C"),
    (3, "d", 4, "table", "D"),                                       # diamond
    (4, "a", 1, "stage", "A"), (4, "b", 2, "stage", "B"), (4, "c", 3, "table", "C"),    # two roots
    (5, "a", 1, "stage", "A"), (5, "b", 2, "table", "B"),            # double edge
    (6, "a", 1, "stage", "A"), (6, "b", 2, "table", "B"), (6, "c", 3, "task", "C"),     # cycle b<->c ...
    (6, "d", 4, "stream", "D"),                                      # ... and d behind it
    (7, "a", 1, "stage", "A"), (7, "b", 2, "table", "B"),            # unknown source into b
]
EDGES = [
    (2, "a", "b", 1), (2, "b", "c", 2),
    (3, "a", "b", 1), (3, "a", "c", 2), (3, "b", "d", 3), (3, "c", "d", 4),
    (4, "a", "c", 1), (4, "b", "c", 2),
    (5, "a", "b", 1), (5, "a", "b", 2),
    (6, "a", "b", 1), (6, "b", "c", 2), (6, "c", "b", 3), (6, "c", "d", 4),
    (7, "zz", "b", 1), (7, "a", "b", 2),
]


def _frames(spark):
    nodes = spark.createDataFrame(NODES, "graph_id long, id string, pos int, type string, label string")
    edges = spark.createDataFrame(EDGES, "graph_id long, source string, target string, epos int")
    return nodes, edges


def test_levels_and_cycles(spark):
    nodes, edges = _frames(spark)
    lv = {(r.graph_id, r.id): r.level for r in GR.topological_levels(nodes, edges).collect()}
    assert lv[(1, "a")] == 0
    assert [lv[(2, x)] for x in "abc"] == [0, 1, 2]
    assert [lv[(3, x)] for x in "abcd"] == [0, 1, 1, 2]
    assert [lv[(4, x)] for x in "abc"] == [0, 0, 1]
    assert [lv[(5, x)] for x in "ab"] == [0, 1]
    assert lv[(6, "a")] == 0 and (6, "b") not in lv and (6, "d") not in lv
    assert lv[(7, "a")] == 0 and (7, "b") not in lv
    bad = {(r.graph_id, r.id) for r in GR.cyclic_nodes(nodes, edges).collect()}
    assert bad == {(6, "b"), (6, "c"), (6, "d"), (7, "b")}


def test_order_respects_every_edge(spark):
    nodes, edges = _frames(spark)
    order = {(r.graph_id, r.id): r.ord for r in GR.topological_order(nodes, edges).collect()}
    for g, s, t, _ in EDGES:
        if (g, s) in order and (g, t) in order:
            assert order[(g, s)] < order[(g, t)]


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "graph_id long, id string, pos int, type string, label string")
    edges = spark.createDataFrame([], "graph_id long, source string, target string, epos int")
    assert GR.topological_levels(nodes, edges).count() == 0


def test_degree_kinds_and_lookups(spark):
    nodes, edges = _frames(spark)
    deg = {(r.graph_id, r.id): r.in_degree for r in GR.in_degree(nodes, edges).collect()}
    assert deg[(1, "a")] == 0 and deg[(3, "d")] == 2 and deg[(5, "b")] == 2
    levels = GR.topological_levels(nodes, edges)
    first = {(r.graph_id, r.kind): r.id for r in GR.first_of_kind(nodes, levels).collect()}
    ranks = {(r.graph_id, r.id): r.rank for r in GR.nodes_by_kind(nodes, levels).collect()}
    assert ranks[(4, "a")] == 1 and ranks[(4, "b")] == 2 and ranks[(3, "b")] == 1 and ranks[(3, "c")] == 2
    assert first[(4, "stage")] == "a" and first[(3, "table")] == "d"
    up = {(r.graph_id, r.id): r.upstream_id for r in GR.first_upstream(nodes, edges, "stage").collect()}
    assert up[(4, "c")] == "a"
    down = {(r.graph_id, r.downstream_id) for r in GR.downstream(nodes, edges).filter("id = 'a'").collect()}
    assert (3, "b") in down and (3, "c") in down


def test_self_loop(spark):
    nodes = spark.createDataFrame([(1, "a", 1, "stage", "A"), (1, "b", 2, "table", "B"), (1, "c", 3, "task", "C"),
                                   (2, "x", 1, "stage", "X")],
                                  "graph_id long, id string, pos int, type string, label string")
    edges = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 2), (2, "x", "x", 1)],
                                  "graph_id long, source string, target string, epos int")
    lv = {(r.graph_id, r.id): r.level for r in GR.topological_levels(nodes, edges).collect()}
    assert lv == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2}            # x loops onto itself
    assert {(r.graph_id, r.id) for r in GR.cyclic_nodes(nodes, edges).collect()} == {(2, "x")}


def test_long_chain(spark):
    n = 12
    nodes = spark.createDataFrame([(1, f"n{i:02d}", i, "stage", "S") for i in range(n)], "graph_id long, id string, pos int, type string, label string")
    edges = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}", i) for i in range(n - 1)],
                                  "graph_id long, source string, target string, epos int")
    lv = {r.id: r.level for r in GR.topological_levels(nodes, edges).collect()}
    assert lv == {f"n{i:02d}": i for i in range(n)}


def _by_both(nodes, edges):
    """Levels and unpeeled nodes, by whole graphs and by the level log."""
    out = []
    for whole in (GR.WHOLE, 0):
        levels, never = GR._kahn(nodes, edges, carry=["pos"], whole=whole)
        out.append(({(r.graph_id, r.id): (r.level, r.pos) for r in levels.collect()}, {(r.graph_id, r.id) for r in never.collect()}))
    return out


def test_whole_graphs_and_level_log_agree(spark, monkeypatch):
    nodes, edges = _frames(spark)
    monkeypatch.setattr(GR, "HUB", 2)
    monkeypatch.setattr(GR, "TOGETHER", 3)
    one, two = _by_both(nodes, edges)
    assert one == two and one[1] == {(6, "b"), (6, "c"), (6, "d"), (7, "b")}
    import random
    rng = random.Random(4)
    made = [(g, f"n{i}", i, "stage", "S") for g in (1, 2, None, 5) for i in range(40) if g is not None]
    links = [(g, f"n{a}", f"n{b}", 0) for g in (1, 2, 5, 9) for a, b in ((rng.randrange(45), rng.randrange(45)) for _ in range(90)) if a < b or rng.random() < 0.01]
    nodes = spark.createDataFrame(made + made[:5], "graph_id long, id string, pos int, type string, label string").repartition(5)
    edges = spark.createDataFrame(links, "graph_id long, source string, target string, epos int").repartition(3)
    one, two = _by_both(nodes, edges)
    assert one == two and len(one[0]) + len(one[1]) == 120
    want = {}
    for g in (1, 2, 5):  # longest paths by relaxing, counted only where all sources are reached
        inn = {f"n{i}": [a for gg, a, b, _ in links if gg == g and b == f"n{i}"] for i in range(40)}
        left = dict(inn)
        while True:
            ready = [n for n, src in left.items() if all((g, a) in want for a in src)]
            if not ready:
                break
            for n in ready:
                want[g, n] = max((want[g, a] + 1 for a in left.pop(n)), default=0)
    assert {k: v[0] for k, v in one[0].items()} == want


def test_level_log_writes_a_row_per_edge_and_leaves_no_table(spark, monkeypatch):
    from stagecraft import session
    n, wrote = 40, []
    write_once = session.write_once

    def counted(df, tag):
        out, path = write_once(df, tag)
        wrote.append((tag, out.count(), path))
        return out, path

    monkeypatch.setattr(session, "write_once", counted)
    nodes = spark.createDataFrame([(1, f"n{i}", i) for i in range(n)], "graph_id long, id string, pos int")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(n - 1)], "graph_id long, source string, target string")
    levels, never = GR._kahn(nodes, edges, whole=10)
    assert {r.id: r.level for r in levels.collect()} == {f"n{i}": i for i in range(n)} and never.isEmpty()
    assert sum(k for tag, k, _ in wrote if tag == "t1_log") == n - 1
    import os
    assert not any(os.path.exists(path.replace("file:", "")) for _, _, path in wrote)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stagecraft_t1")]


def test_hub_edges_take_several_keys(spark, monkeypatch):
    monkeypatch.setattr(GR, "HUB", 100)
    nodes = spark.createDataFrame([(1, "hub", 0)] + [(1, f"n{i}", i) for i in range(1000)], "graph_id long, id string, pos int")
    edges = spark.createDataFrame([(1, "hub", f"n{i}") for i in range(1000)], "graph_id long, source string, target string")
    done, drop = GR._kahn_log(nodes, edges, [])
    links = spark.read.parquet(next(p for p in drop if "t1_edges" in p))
    assert links.select("salt").distinct().count() == 10
    assert done.groupBy("level").count().orderBy("level").collect() == [(0, 1), (1, 1000)]


def test_in_degree_of_many_rows_is_spread(spark):
    """With many rows known the tasks are sized by rows, not by compressed bytes."""
    rng = random.Random(3)
    nodes = [(g, f"n{k}") for g in range(40) for k in range(rng.randrange(6))] + [(1, "n0"), (None, "x")]
    edges = [(rng.randrange(42), "s", f"n{rng.randrange(6)}") for _ in range(300)] + [(None, "s", "x")]
    n = spark.createDataFrame(nodes, "graph_id long, id string")
    e = spark.createDataFrame(edges, "graph_id long, source string, target string")
    out = GR.in_degree(n, e, 20_000_000)
    assert "40), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((g, i, sum((x, z) == (g, i) for x, _, z in edges)) for g, i in nodes if g is not None)
    got = [tuple(r) for r in out.collect()]
    assert sorted(r for r in got if r[0] is not None) == want and [r for r in got if r[0] is None] == [(None, "x", 0)]
