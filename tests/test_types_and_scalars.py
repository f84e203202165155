from pyspark.sql import functions as F

from stagecraft.functions import scalars as S
from stagecraft.functions import types as TY


def test_identifiers(spark):
    names = ["A", "_x$1", "1x", "a-b", "", "a b", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(TY.is_identifier("n")).collect()]
    assert got == [True, True, False, False, False, False, False]


def test_object_name_from_label(spark):
    df = spark.createDataFrame([("", "a b"), (None, "My  stage\tx"), ("KEEP", "ignored")], "name string, label string")
    got = [r[0] for r in df.select(S.object_name("name", "label")).collect()]
    assert got == ["A_B", "MY_STAGE_X", "KEEP"]


def test_types(spark):
    types = ["varchar", "NUMBER(10,2)", " int ", "JSON", "VARCHAR(1) x (y)", "timestamp_ntz", "DECIMAL(38, 0)"]
    df = spark.createDataFrame([(t,) for t in types], "t string")
    got = [(r.name, r.valid) for r in df.select(TY.normalize_type("t").alias("x")).select("x.*").collect()]
    assert got == [("VARCHAR", True), ("NUMBER", True), ("INT", True), ("JSON", False),
                   ("VARCHAR", False), ("TIMESTAMP_NTZ", True), ("DECIMAL", True)]


def test_spark_type_map():
    assert TY.spark_type("NUMBER(10,2)") == "decimal(10,2)"
    assert TY.spark_type("number") == "decimal(38,0)"
    assert TY.spark_type("VARCHAR(5)") == "varchar(5)"
    assert TY.spark_type("TIMESTAMP_LTZ") == "timestamp"


def test_split_lines(spark):
    texts = ["a\n\nb\n", "   ", 'x "quoted" y\n  z  ', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.split_lines("t")).collect()]
    assert got == [["a", "b"], [], ['x "quoted" y', "z"], [], None]


def test_json_unwrap_levels(spark):
    plain = '{"nodes": [1], "edges": []}'
    twice = '"' + plain.replace('"', '\\"') + '"'
    thrice = '"' + twice.replace("\\", "\\\\").replace('"', '\\"') + '"'
    df = spark.createDataFrame([(plain,), (twice,), (thrice,), ("not json",), ('{"edges": []}',)], "c string")
    out = df.select(F.to_json(S.json_unwrap("c")).alias("j"),
                    F.try_variant_get(S.json_unwrap("c"), "$.nodes", "array<int>").alias("nodes")).collect()
    assert [r.nodes for r in out] == [[1], [1], [1], None, None]
    assert out[0].j == out[1].j == out[2].j


def test_strip_fences(spark):
    rows = ["```json\n{\"a\": 1}\n```", "```\n{\"a\": 1}\n```", "{\"a\": 1}", "```JSON {\"a\": 1} ```"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = [r[0] for r in df.select(S.strip_fences("c")).collect()]
    assert got == ['{"a": 1}'] * 4


def test_first_filled_and_label(spark):
    df = spark.createDataFrame([(None, "", "x"), ("", None, None), ("v", "w", None)], "a string, b string, c string")
    got = [r[0] for r in df.select(S.first_filled("a", "b", "c", default="Y")).collect()]
    assert got == ["x", "Y", "v"]
    lab = [r[0] for r in spark.createDataFrame([("true",), ("false",)], "s string")
           .select(S.label("s", {"true": "Stale"}, "Fresh")).collect()]
    assert lab == ["Stale", "Fresh"]


def test_split_lines_crlf(spark):
    df = spark.createDataFrame([("a\r\n  b \t\r\n\r\n",)], "t string")
    assert df.select(S.split_lines("t")).first()[0] == ["a", "b"]


def test_json_unwrap_at_any_depth(spark):
    import json
    from pyspark.sql import functions as F
    from stagecraft.functions import scalars as S
    values = [{"k": 7}, [1], 5, "no json"]
    rows = []
    for v in values:
        text = json.dumps(v)
        for _ in range(6):
            text = json.dumps(text)
        rows.append((text,))
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(F.to_json(S.json_unwrap("c"))).collect()]
    assert got == ['{"k":7}', "[1]", "5", None]
