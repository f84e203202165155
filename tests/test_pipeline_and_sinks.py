import copy
import os

import pytest
from pyspark.sql import functions as F

from stagecraft.operators import sinks as SK
from stagecraft.operators import validate as VA
from stagecraft.plans import catalog as C
from stagecraft.plans.pipeline import run_pipeline


def _stage(spark):
    return C.pages_stage(spark, "/root/testdata/sf0.001")


def test_pipeline_rejects_bad_specs(spark):
    bad = copy.deepcopy(C.FLAGSHIP_SPEC)
    bad["database"] = "my db"
    with pytest.raises(ValueError):
        run_pipeline(bad, {"PAGES": _stage(spark)})
    empty = dict(C.FLAGSHIP_SPEC, nodes=[], edges=[])
    with pytest.raises(ValueError):
        run_pipeline(empty, {"PAGES": _stage(spark)})
    cyc = copy.deepcopy(C.FLAGSHIP_SPEC)
    cyc["edges"].append({"source": "n3", "target": "n2"})
    with pytest.raises(ValueError):
        run_pipeline(cyc, {"PAGES": _stage(spark)})


def test_pipeline_follows_edges(spark):
    spec = copy.deepcopy(C.FLAGSHIP_SPEC)
    # a branch not on the path to the table is ignored
    spec["nodes"].append({"id": "n9", "type": "ai_sentiment", "label": "Side", "config": {}})
    spec["edges"].append({"source": "n1", "target": "n9"})
    out = run_pipeline(spec, {"PAGES": _stage(spark)}, as_of=C.AS_OF)
    ref = run_pipeline(C.FLAGSHIP_SPEC, {"PAGES": _stage(spark)}, as_of=C.AS_OF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ref.collect()))


def test_append_twice_and_append_new(spark, tmpdir_fresh):
    rows = spark.createDataFrame([("f1", "x"), ("f2", "y")], "FILE_NAME string, PROCESSED_DATA string") \
        .withColumn("PROCESSED_AT", F.lit("2024-01-01").cast("timestamp_ntz"))
    SK.ensure_table(spark, "t_k3_test", None, location=os.path.join(tmpdir_fresh, "k3"))
    SK.append_into(rows, "t_k3_test")
    SK.append_into(rows, "t_k3_test")
    assert spark.table("t_k3_test").count() == 4
    SK.ensure_table(spark, "t_k4_test", None, location=os.path.join(tmpdir_fresh, "k4"))
    SK.append_new(rows, "t_k4_test")
    SK.append_new(rows, "t_k4_test")
    assert spark.table("t_k4_test").count() == 2
    got = spark.table("t_k4_test").select(F.col("PROCESSED_DATA").cast("string")).collect()
    assert sorted(r[0] for r in got) == ["x", "y"]


def test_dense_ids_continue(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    out = SK.dense_ids(df, "k", start=10).collect()
    ids = sorted(r.ID for r in out)
    assert ids == list(range(11, 1011))
    assert all(r.ID == r.k + 11 for r in out)


def test_not_null_and_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    v = {r.column_name: r.failing_rows for r in SK.violations(df, ["a", "b"]).collect()}
    assert v == {"a": 0, "b": 1}
    with pytest.raises(Exception):
        SK.enforce_not_null(df, ["b"]).collect()
    assert SK.add_column(df, "c", "INT", default=0).columns == ["a", "b", "c"]
    with pytest.raises(ValueError):
        SK.add_column(df, "d", "INT", nullable=False)
    assert SK.rename_column(SK.drop_column(df, "a"), "b", "bee").columns == ["bee"]


def test_validate_columns_cases(spark):
    cols = spark.createDataFrame([("t", "A", "varchar"), ("t", "", "int"), ("t", "a b", "JSON"),
                                  ("t", "_x$1", "VARCHAR(1) x (y)")], "table_name string, name string, type string")
    got = sorted((r.name, r.violation) for r in VA.validate_columns(cols).collect())
    assert got == [("", "empty_name"), ("_x$1", "invalid_type"), ("a b", "invalid_name"), ("a b", "invalid_type")]


def test_pipeline_task_over_new_files(spark, tmpdir_fresh):
    from stagecraft.plans.pipeline import schedule_minutes, start_pipeline_task
    stage = os.path.join(tmpdir_fresh, "pages")
    os.makedirs(stage)
    page = "<html><body><h1>Title {0}</h1><p>First words here. Second words here. Third one.</p></body></html>"
    for i in (1, 2):
        with open(os.path.join(stage, f"p{i}.html"), "w") as f:
            f.write(page.format(i))
    out, ckpt = os.path.join(tmpdir_fresh, "out"), os.path.join(tmpdir_fresh, "ckpt")

    def run():
        start_pipeline_task(C.FLAGSHIP_SPEC, stage, out, ckpt, available_now=True, as_of=C.AS_OF).awaitTermination()
        return sorted((r.FILE_NAME, r.PROCESSED_DATA) for r in spark.read.parquet(out).collect())

    got = run()
    assert [g[0] for g in got] == ["p1.html", "p2.html"] and got[0][1].startswith("Title 1")
    with open(os.path.join(stage, "p3.html"), "w") as f:
        f.write(page.format(3))
    assert [g[0] for g in run()] == ["p1.html", "p2.html", "p3.html"]
    assert schedule_minutes("5 MINUTE") == 5 and schedule_minutes("") == 60
    with pytest.raises(ValueError):
        schedule_minutes("USING CRON 0 9 * * * UTC")


def test_describe_columns(spark):
    from stagecraft.operators.inventory import describe_columns
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    rows = {r.name: (r.type, r.nullable) for r in describe_columns(df).collect()}
    assert rows["c_custkey"] == ("bigint", "Y") and rows["c_acctbal"] == ("double", "Y")


def test_stage_read_formats_and_views(spark, tmpdir_fresh):
    from stagecraft.sources.stage import stage_read
    from stagecraft.sources.tables import create_view
    csv_dir = os.path.join(tmpdir_fresh, "csv")
    os.makedirs(csv_dir)
    with open(os.path.join(csv_dir, "a.csv"), "w") as f:
        f.write("k,v\n1,x\n2,y\n")
    got = stage_read(spark, csv_dir, "auto", schema="k int, v string", glob="*.csv")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y")]
    js = os.path.join(tmpdir_fresh, "j.json")
    with open(js, "w") as f:
        f.write('{"k": 3, "v": "z"}\n')
    assert stage_read(spark, js, "JSON", schema="k int, v string").first().v == "z"
    with pytest.raises(ValueError):
        stage_read(spark, js, "XML")
    spark.range(3).createOrReplaceTempView("base_t")
    create_view(spark, "v_once", "SELECT id FROM base_t WHERE id > 0")
    with pytest.raises(ValueError):
        create_view(spark, "v_once", "SELECT id FROM base_t")          # no OR REPLACE
    assert spark.table("v_once").count() == 2


def test_save_configs_continue_ids(spark, tmpdir_fresh):
    cfg = spark.createDataFrame([("  a ", '{"nodes": []}', 1), ("b", '{"nodes": [1]}', 2)],
                                "NAME string, CONFIG string, o int")
    first = SK.save_configs(cfg, None, order="o", created_at="2024-01-01 00:00:00")
    first.write.option("path", os.path.join(tmpdir_fresh, "cfg")).saveAsTable("saved_cfg_test")
    more = spark.createDataFrame([("c", '"{\\"nodes\\": []}"', 3)], "NAME string, CONFIG string, o int")
    new = SK.save_configs(more, "saved_cfg_test", order="o", created_at="2024-01-02 00:00:00")
    rows = sorted((r.ID, r.NAME) for r in spark.table("saved_cfg_test").collect())
    assert rows == [(1, "a"), (2, "b"), (3, "c")]
    assert [(r.ID, r.NAME) for r in new.collect()] == [(3, "c")]     # stable after the append


def test_validate_pipelines_cases(spark):
    specs = spark.createDataFrame([(1, "MY_DB", "PUBLIC"), (2, "my db", "PUBLIC"), (3, "DB", "1x")],
                                  "graph_id long, database string, schema string")
    nodes = spark.createDataFrame([
        (1, "a", "stage", "Files", ""), (1, "b", "table", "files", "FILES"),    # duplicate name FILES
        (1, "c", "ai_magic", "Step", ""),                                      # unknown type
        (2, "a", "stage", "a-b", ""),                                          # invalid name
        (2, "b", None, "Other", ""),                                           # no type
    ], "graph_id long, id string, type string, label string, name string")
    got = sorted((r.graph_id, r.id or "", r.violation) for r in VA.validate_pipelines(specs, nodes).collect())
    assert got == [(1, "a", "duplicate_name"), (1, "b", "duplicate_name"), (1, "c", "unknown_type"),
                   (2, "", "invalid_database"), (2, "a", "invalid_name"), (2, "b", "unknown_type"),
                   (3, "", "empty_pipeline"), (3, "", "invalid_schema")]


def test_parse_modes(spark):
    from stagecraft.functions import text as X
    df = spark.createDataFrame([(1, "<p>a &lt; b</p><script>x</script>")], "id int, html string")
    assert X.parse_document(df, "id", "html", "OCR").first().text == "a < b"
    assert X.parse_document(df, "id", "html", "layout").first().kind == "paragraph"
    with pytest.raises(ValueError):
        X.parse_document(df, "id", "html", "VISION")


def test_view_takes_only_queries(spark):
    import pytest
    from pyspark.errors import ParseException
    from stagecraft.sources.tables import create_view
    with pytest.raises(ParseException):
        create_view(spark, "v_statement", "DROP TABLE no_such_table")
    assert not spark.catalog.tableExists("v_statement")


def _spec(nodes, edges):
    return {"database": "D", "schema": "P", "nodes": [{"id": i, "type": t, "label": i, "config": c} for i, t, c in nodes],
            "edges": [{"source": a, "target": b} for a, b in edges]}


def test_rows_of_one_name_or_none_stay_apart(spark):
    rows = spark.createDataFrame([("a", "one invoice"), ("a", "a contract here"), (None, "invoice"), (None, "invoice")],
                                 "FILE_NAME string, content string")
    spec = _spec([("s", "stage", {}), ("c", "ai_classify", {}), ("t", "table", {})], [("s", "c"), ("c", "t")])
    got = sorted((str(r[0]), r[1]) for r in run_pipeline(spec, {"S": rows}, as_of=C.AS_OF).collect())
    assert got == [("None", "invoice"), ("None", "invoice"), ("a", "contract"), ("a", "invoice")]


def test_several_tables_declared_columns_and_lexicon(spark):
    from stagecraft.functions.text import lexicon_from_pairs
    from stagecraft.plans.pipeline import pipeline_outputs
    rows = spark.createDataFrame([("a", "good day"), ("b", "bad day")], "FILE_NAME string, content string")
    cols = [{"name": n, "type": t} for n, t in (("PROCESSED_DATA", "VARCHAR"), ("FILE_NAME", "VARCHAR"), ("NOTE", "INT"),
                                                ("PROCESSED_AT", "DATE"))]
    spec = _spec([("s", "stage", {}), ("f", "ai_sentiment", {"lexicon": "WORDS"}), ("t", "table", {}), ("u", "table", {"columns": cols})],
                 [("s", "f"), ("s", "t"), ("f", "u")])
    out = pipeline_outputs(spec, {"S": rows}, as_of=C.AS_OF, tables={"WORDS": lexicon_from_pairs(spark, [("good", 1.0), ("bad", -1.0)])})
    assert sorted(out) == ["T", "U"]
    assert sorted(tuple(r)[:2] for r in out["T"].collect()) == [("a", "good day"), ("b", "bad day")]
    assert out["U"].columns == [c["name"] for c in cols]
    assert sorted((r.FILE_NAME, r.PROCESSED_DATA, r.NOTE) for r in out["U"].collect()) == [("a", "positive", None), ("b", "negative", None)]
    with pytest.raises(ValueError):
        run_pipeline(spec, {"S": rows})            # two tables, no target
    with pytest.raises(ValueError):
        run_pipeline(spec, {"S": rows}, target="U")  # no such lexicon


def test_stage_read_auto_over_a_mixed_folder(spark, tmpdir_fresh):
    from stagecraft.sources.stage import stage_directory, stage_read
    for name, text in (("a.CSV", "k,v\n1,x\n"), ("sub/b.jsonl", '{"k": "2", "v": "y"}\n'), ("c.json", '{"k": "3", "v": "z"}\n')):
        os.makedirs(os.path.dirname(os.path.join(tmpdir_fresh, name)), exist_ok=True)
        with open(os.path.join(tmpdir_fresh, name), "w") as f:
            f.write(text)
    assert sorted(map(tuple, stage_read(spark, tmpdir_fresh).select("k", "v").collect())) == [("1", "x"), ("2", "y"), ("3", "z")]
    for path in (tmpdir_fresh, "file://" + tmpdir_fresh, "file:" + tmpdir_fresh + "/"):
        assert sorted(r[0] for r in stage_directory(spark, path).collect()) == ["a.CSV", "c.json", "sub/b.jsonl"]
    with open(os.path.join(tmpdir_fresh, "d.txt"), "w") as f:
        f.write("x")
    with pytest.raises(ValueError):
        stage_read(spark, tmpdir_fresh)


def test_changes_of_variant_rows(spark):
    from stagecraft.streaming.changes import changes
    before = spark.sql("SELECT * FROM VALUES (1, parse_json('1')), (2, parse_json('{\"a\": 1}')), (3, parse_json('1')) t(k, v)")
    after = spark.sql("SELECT * FROM VALUES (1, parse_json('\"1\"')), (2, parse_json('{\"a\": 1}')) t(k, v)")
    got = sorted((r.k, r.action, r.is_update) for r in changes(before, after, "k").select("k", "action", "is_update").collect())
    assert got == [(1, "DELETE", True), (1, "INSERT", True), (3, "DELETE", False)]


def test_two_stages_summary_rows_stay_documents(spark):
    """The rows of both stages are summarised in place: no window over their words."""
    from stagecraft.plans.catalog import STAGES_SPEC
    pages = spark.createDataFrame([("p", "<p>one two. two</p>")], "FILE_NAME string, content string")
    docs = spark.createDataFrame([("d", "x y. x. z z"), ("d", "x y. x. z z"), (None, "")], "FILE_NAME string, content string")
    from stagecraft.plans.pipeline import run_pipeline
    out = run_pipeline(STAGES_SPEC, {"PAGES": pages, "DOCS": docs}, as_of="2024-02-01 00:00:00")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((str(r.FILE_NAME), r.PROCESSED_DATA) for r in out.collect())
    assert [x[0] for x in got] == ["None", "d", "d", "p"] and got[1] == got[2] and got[1][1] == "x y x z z" and got[0][1] is None


def test_two_stages_summaries_sort_no_texts(spark):
    """A row of a pipeline is one document: its text is not sorted into groups."""
    from stagecraft.plans.catalog import STAGES_SPEC
    from stagecraft.plans.pipeline import run_pipeline
    pages = spark.createDataFrame([("p", "<p>one two. two</p>"), ("d", "<p>x y</p>"), (None, None)], "FILE_NAME string, content string")
    docs = spark.createDataFrame([("d", "x y. x. z z"), ("d", "x y"), (None, "")], "FILE_NAME string, content string")
    out = run_pipeline(STAGES_SPEC, {"PAGES": pages, "DOCS": docs}, as_of="2024-02-01 00:00:00")
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((str(r.FILE_NAME), str(r.PROCESSED_DATA)) for r in out.collect())
    assert got == [("None", "None"), ("None", "None"), ("d", "x y"), ("d", "x y"), ("d", "x y x z z"), ("p", "one two two")]
