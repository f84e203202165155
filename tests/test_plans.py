"""Plan-shape regressions: the properties that matter at scale."""

import re

import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_one_exchange(spark):
    plan = _plan(E.queries()["stored_pipeline"](spark, SF_SMALL))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cartesian_or_row_python_anywhere(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        hits = [m for m in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if m in plan]
        if hits:
            bad[name] = hits
    assert not bad


def test_scans_prune_columns(spark):
    plan = _plan(E.queries()["summarize"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas == ["struct<doc_id:bigint,text:string>"]
    plan = _plan(E.queries()["user_predicate"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderstatus)" in plan
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_config_tables_are_broadcast(spark):
    plan = _plan(E.queries()["classify_seeded"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
