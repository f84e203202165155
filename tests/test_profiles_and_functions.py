"""Merged profiles, JSON levels, spec checks and table functions on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from stagecraft.functions import procedures as PR
from stagecraft.functions import scalars as S
from stagecraft.operators import inventory as INV
from stagecraft.operators import validate as VA
from stagecraft.plans import pipeline as PL


def test_profiles_merge_over_loads_and_types(spark):
    def load(lo, hi):
        return spark.range(lo, hi).select(
            F.col("id"), (F.col("id") % 7 * 10.5).alias("d"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id"))).alias("s"),
            F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("id") % 5)).alias("m"), F.array(F.col("id") % 4).alias("a"),
            F.parse_json(F.concat(F.lit('{"x":'), F.col("id") % 6, F.lit("}"))).alias("v"), F.struct((F.col("id") % 2).alias("p")).alias("st"),
            F.encode((F.col("id") % 3).cast("string"), "utf-8").alias("b"), F.lit(None).cast("int").alias("none"))

    parts = INV.profile_sketches(load(0, 4000), "t").unionByName(INV.profile_sketches(load(2000, 9000), "t")).unionByName(INV.profile_sketches(load(0, 0), "t"))
    got = {r.column_name: r for r in INV.merged_profile(parts).collect()}
    assert all(r.rows == 11000 for r in got.values()) and got["none"].nulls == 11000
    for name, exact in {"id": 9000, "s": 6000, "d": 7, "m": 5, "a": 4, "v": 6, "st": 2, "b": 3, "none": 0}.items():
        assert abs(got[name].distinct_count - exact) <= 0.03 * exact, name
    assert (got["id"].min_value, got["id"].max_value) == ("0", "8999") and got["d"].max_value == "63.000000" and got["m"].min_value is None
    assert got["s"].nulls == sum(i % 3 == 0 for i in [*range(4000), *range(2000, 9000)])
    exact = {r.column_name: r for r in INV.column_profile(load(0, 100), exact=True).collect()}
    assert exact["m"].distinct_count == 5 and exact["v"].distinct_count == 6


def test_json_of_many_levels(spark):
    rows = []
    for k, v in enumerate([{"a": 1}, [1, "x"], 5, True, "abcdefabcdef", "", "00ff", {"t": "\\\"" * 20}]):
        text = json.dumps(v)
        for level in range(7):
            rows.append((k, level, text))
            text = json.dumps(text)
    rows += [(90, 0, None), (91, 0, "no json"), (92, 0, "")]
    got = {(r.k, r.level): r.j for r in spark.createDataFrame(rows, "k int, level int, t string").select(
        "k", "level", F.to_json(S.json_unwrap("t")).alias("j")).collect()}
    for k, v in enumerate([{"a": 1}, [1, "x"], 5, True]):
        assert all(json.loads(got[k, level]) == v for level in range(7))
    assert all(json.loads(got[7, level]) == {"t": "\\\"" * 20} for level in range(7))
    assert got[90, 0] is None and got[91, 0] is None


def test_specs_with_repeated_names_or_loose_edges_are_refused(spark):
    def spec(tables=("A", "B"), edges=(("s", "a"), ("s", "b"))):
        return {"database": "D", "schema": "S", "nodes": [{"id": "s", "type": "stage", "label": "st", "config": {"name": "STG"}},
                {"id": "a", "type": "table", "label": tables[0], "config": {}}, {"id": "b", "type": "table", "label": tables[1], "config": {}}],
                "edges": [{"source": x, "target": y} for x, y in edges]}

    stages = {"STG": spark.createDataFrame([("f", "text")], "FILE_NAME string, content string")}
    assert {k: v.count() for k, v in PL.pipeline_outputs(spec(), stages).items()} == {"A": 1, "B": 1}
    for bad, said in ((spec(tables=("A", "A")), "more than once: A"), (spec(edges=(("s", "zz"),)), "edge target is no node of the pipeline: 'zz'"),
                      (spec(edges=(("q", "a"),)), "edge source is no node of the pipeline: 'q'")):
        with pytest.raises(ValueError, match=said):
            PL.pipeline_outputs(bad, stages)


def test_tables_without_columns(spark):
    cols = spark.createDataFrame([("t", "a", "INT"), ("u", "1a", "INT")], "table_name string, name string, type string")
    tables = spark.createDataFrame([("t",), ("u",), ("v",), ("v",)], "table_name string")
    assert sorted(map(tuple, VA.validate_columns(cols, tables=tables).collect())) == [("u", "1a", "invalid_name"), ("v", None, "no_columns")]


class Doubler:
    def __init__(self):
        self.n = 0

    def eval(self, rows):
        self.n += rows.num_rows
        return iter(())

    def terminate(self):
        import pyarrow as pa
        yield pa.table({"n": pa.array([2 * self.n], pa.int64())})


def test_table_function_registration(spark):
    from pyspark import cloudpickle
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    PR.define_python_table_function(spark, "doubler", Doubler, [("n", "BIGINT")])
    spark.range(10).selectExpr("id % 2 AS g").createOrReplaceTempView("doubler_rows")
    assert [r.n for r in spark.sql("SELECT * FROM doubler(TABLE(doubler_rows) PARTITION BY g)").collect()] == [10, 10]
    for name, columns in (("bad name", [("n", "INT")]), ("ok", [("1n", "INT")]), ("ok", [("n", "NOTYPE")])):
        with pytest.raises(ValueError):
            PR.define_python_table_function(spark, name, Doubler, columns)


def test_exact_profile_copies_no_rows(spark):
    """Exact distinct counts column by column, without an Expand of the rows."""
    rows = [(k % 7 if k % 5 else None, f"s{k % 11}" if k % 3 else None, float(k % 4)) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, `c.d` double")
    for out in (INV.column_profile(df, exact=True), INV._exact_profile(df, per=20)):
        assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.column_name: tuple(r)[1:] for r in out.collect()}
        assert got == {"a": ("int", 60, 7, "0", "6"), "b": ("string", 100, 11, "s0", "s9"), "c.d": ("double", 0, 4, "0.0", "3.0")}
    empty = INV.column_profile(df.limit(0), exact=True).collect()
    assert [tuple(r) for r in empty] == [("a", "int", 0, 0, None, None), ("b", "string", 0, 0, None, None), ("c.d", "double", 0, 0, None, None)]
