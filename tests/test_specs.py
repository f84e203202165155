import json

from stagecraft.operators import graph as GR
from stagecraft.plans.specs import spec_tables

SPEC = {"nodes": [{"id": "a", "type": "stage", "label": "S", "config": {"name": "STG"}},
                  {"id": "b", "type": "ai_summarize", "label": "Sum", "config": {}},
                  {"id": "c", "type": "table", "label": "Out", "config": {}}],
        "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "c"}]}


def test_spec_tables_unwraps_and_orders(spark):
    plain = json.dumps(SPEC)
    twice = json.dumps(plain)
    thrice = json.dumps(twice)
    df = spark.createDataFrame([(1, plain), (2, twice), (3, thrice), (4, "not json"), (5, '{"edges": []}')],
                               "ID long, CONFIG string")
    nodes, edges = spec_tables(df)
    assert sorted({r.graph_id for r in nodes.collect()}) == [1, 2, 3]
    assert edges.count() == 6
    lv = {(r.graph_id, r.id): r.level for r in GR.topological_levels(nodes, edges).collect()}
    assert lv[(3, "c")] == 2 and lv[(1, "a")] == 0
