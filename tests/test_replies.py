"""Reply decoding on the literal reply cases of FIXTURES.md."""

import json

from stagecraft.operators import replies as RP

INNER = {"message": "m", "nodes": [{"type": "stage", "label": "S", "config": {"name": "S1"}},
                                   {"type": "table", "label": "T", "config": {}}],
         "edges": [{"source_index": 0, "target_index": 1}, {"source_index": -1, "target_index": 1},
                   {"source_index": 0, "target_index": 2}]}


def outer(content):
    return json.dumps({"choices": [{"messages": content}]})


CASES = [
    (1, outer("just words")),                                  # plain text
    (2, outer(json.dumps(INNER))),                             # JSON
    (3, outer("```json\n" + json.dumps(INNER) + "\n```")),      # fenced JSON
    (4, outer("```\n" + json.dumps(INNER) + "\n```")),          # fenced without json
    (5, outer("null")),                                        # literal null
    (6, outer(json.dumps({"message": "x", "nodes": [{"type": "stage", "label": "S"}]}))),  # missing edges
    (7, "this is not json"),                                   # outer not JSON
    (8, json.dumps({"other": 1})),                             # no choices
]


def test_decode_and_parse(spark):
    df = spark.createDataFrame(CASES, "reply_id long, raw string")
    p = {r.reply_id: r for r in RP.reply_to_pipeline(RP.decode_replies(df)).collect()}
    assert not p[1].is_pipeline and p[1].message == "just words"
    for k in (2, 3, 4):
        assert p[k].is_pipeline and p[k].message == "m" and len(p[k].nodes) == 2
    assert not p[5].is_pipeline and p[5].message == "null" and p[5].nodes == []
    assert p[6].is_pipeline and p[6].edges == [] and len(p[6].nodes) == 1
    assert not p[7].is_pipeline and p[7].message == "this is not json" and not p[7].outer_json
    assert p[8].outer_json and p[8].content == ""


def test_graph_rows_filter_bad_indexes(spark):
    df = spark.createDataFrame(CASES, "reply_id long, raw string")
    nodes, edges = RP.replies_to_graph(df)
    e = sorted((r.reply_id, r.source, r.target) for r in edges.collect())
    assert e == [(k, f"chat_{k}_0", f"chat_{k}_1") for k in (2, 3, 4)]
    # the join form of J3 gives the same edges
    parsed = RP.reply_to_pipeline(RP.decode_replies(df))
    j = RP.resolve_edges(RP.reply_nodes(parsed), RP.edges_in_range(RP.index_edges(parsed)))
    assert sorted((r.reply_id, r.source, r.target) for r in j.collect()) == e
    assert nodes.filter("reply_id = 6").count() == 1


def test_render_prompts_defaults(spark):
    df = spark.createDataFrame([("build it",)], "text string")
    msgs = df.select(RP.render_prompts(df, "text").alias("m")).first().m
    assert msgs[0].role == "system" and msgs[1].content == "Database: MY_DB, Schema: PUBLIC. Request: build it"
