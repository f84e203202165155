"""Stored tables by version, NOT NULL on write, and types from text."""

import os

import pytest

from stagecraft.operators import sinks as SK
from stagecraft.operators import versions as VS

COLUMNS = [("id", "INT", False), ("name", "TEXT"), ("price", "NUMBER(8,2)")]


def rows(spark, root, version=None):
    return sorted((tuple(r) for r in VS.read_stored(spark, root, version).collect()), key=str)


def test_column_changes_by_version(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/t"
    assert VS.create_stored(spark, root, COLUMNS) == 1 and rows(spark, root) == []
    one = spark.createDataFrame([(1, "a", "1.5"), (2, None, None)], "id int, NAME string, price string")
    assert VS.write_stored(one, root) == 2
    VS.add_stored_column(spark, root, "rank", "INT", nullable=False, default="3")
    VS.rename_stored_column(spark, root, "NAME", "label")
    VS.drop_stored_column(spark, root, "price")
    assert VS.read_stored(spark, root).columns == ["id", "label", "rank"]
    assert rows(spark, root) == [(1, "a", 3), (2, None, 3)]
    VS.write_stored(spark.createDataFrame([(3, "c", None)], "id int, label string, other string"), root)
    VS.add_stored_column(spark, root, "price", "TEXT")
    assert rows(spark, root) == [(1, "a", 3, None), (2, None, 3, None), (3, "c", 3, None)]
    assert [str(x) for x in rows(spark, root, 2)] == ["(1, 'a', Decimal('1.50'))", "(2, None, None)"]
    VS.write_stored(spark.createDataFrame([(9,)], "id int"), root, overwrite=True)
    assert rows(spark, root) == [(9, None, 3, None)] and VS.versions(spark, root) == list(range(1, 9))


def test_refused_changes_leave_the_version(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/t"
    VS.create_stored(spark, root, COLUMNS)
    for bad in [(None, "a", "1"), (1, "a", "no number"), (1, "a", "12345678.9")]:
        with pytest.raises(Exception):
            VS.write_stored(spark.createDataFrame([(5, "ok", "1"), bad], "id int, name string, price string"), root)
    refused = [lambda: VS.add_stored_column(spark, root, "name", "INT"), lambda: VS.add_stored_column(spark, root, "bad name", "INT"),
               lambda: VS.add_stored_column(spark, root, "x", "INT", nullable=False), lambda: VS.add_stored_column(spark, root, "x", "INT", default="z"),
               lambda: VS.add_stored_column(spark, root, "x", "NOTYPE"), lambda: VS.drop_stored_column(spark, root, "zz"),
               lambda: VS.rename_stored_column(spark, root, "id", "NAME"), lambda: VS.rename_stored_column(spark, root, "id", "1x"),
               lambda: VS.create_stored(spark, root, COLUMNS), lambda: VS.create_stored(spark, f"{root}2", []),
               lambda: VS.create_stored(spark, f"{root}2", [("a", "INT"), ("A", "INT")]), lambda: VS.read_stored(spark, root, 7)]
    for change in refused:
        with pytest.raises(Exception):
            change()
    assert VS.versions(spark, root) == [1] and rows(spark, root) == []
    assert [f for f in os.listdir(root) if f.startswith("part")] == [] and len([f for f in os.listdir(f"{root}/_versions") if f.endswith(".json")]) == 1


def test_one_of_two_writers_is_told(spark, tmpdir_fresh, monkeypatch):
    root = f"{tmpdir_fresh}/t"
    VS.create_stored(spark, root, COLUMNS)
    seen = VS.describe(spark, root)
    VS.write_stored(spark.createDataFrame([(1, "first", "1")], "id int, name string, price string"), root)
    monkeypatch.setattr(VS, "describe", lambda *a, **k: seen)  # the second writer read before the first was done
    with pytest.raises(RuntimeError, match="another writer"):
        VS.write_stored(spark.createDataFrame([(2, "second", "1")], "id int, name string, price string"), root)
    monkeypatch.undo()
    assert [r[1] for r in rows(spark, root)] == ["first"]


def test_not_null_columns_of_catalog_tables(spark, tmpdir_fresh):
    SK.create_table(spark, "nn_table", [{"name": "a", "type": "INT", "nullable": False}, ("b", "TEXT")], location=f"{tmpdir_fresh}/nn")
    SK.append_into(spark.createDataFrame([(1, None)], "a int, b string"), "nn_table")
    with pytest.raises(Exception, match="NOT NULL"):
        SK.append_into(spark.createDataFrame([(None, "x")], "a int, b string"), "nn_table")
    assert spark.table("nn_table").collect() == [(1, None)]
    with pytest.raises(Exception, match="NOT NULL"):
        SK.apply_schema(spark.createDataFrame([(None,)], "a int"), [("a", "INT", False)]).collect()


def test_types_from_text(spark):
    def cast(declared, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r.v for r in SK.apply_schema(df, [("v", declared)]).collect()]

    got = cast("TIMESTAMP_TZ", "2024-01-02 03:04:05+02:00", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05 -0530", "2024-01-02 03:04:05", "2024-01-02 03:04:05.25 UTC+01", None)
    assert [r and (str(r.ts), r.tz) for r in got] == [("2024-01-02 01:04:05", "+02:00"), ("2024-01-02 03:04:05", "+00:00"), ("2024-01-02 08:34:05", "-05:30"),
                                                      ("2024-01-02 03:04:05", "UTC"), ("2024-01-02 02:04:05.250000", "+01:00"), None]
    assert cast("TIME", "03:04", "23:59:59.5", " 00:00:00", None) == ["03:04:00", "23:59:59.5", "00:00:00", None]
    assert [x and {k: v.toPython() for k, v in x.items()} for x in cast("OBJECT", '{"a": 1, "b": [2]}', None)] == [{"a": 1, "b": [2]}, None]
    assert [x and [v.toPython() for v in x] for x in cast("ARRAY", '[1, "x", {"k": 2}]', None)] == [[1, "x", {"k": 2}], None]
    for declared, bad in [("TIME", "25:00"), ("TIME", "x"), ("TIMESTAMP_TZ", "soon"), ("OBJECT", "[1]"), ("ARRAY", "{}"), ("OBJECT", "{"), ("INT", "1.5x")]:
        with pytest.raises(Exception):
            cast(declared, bad)
    from stagecraft.functions.types import TYPE_NAMES
    assert all(SK._declared_type(t) for t in TYPE_NAMES)


def test_only_new_keys_are_appended_and_only_likely_parts_read(spark, tmpdir_fresh):
    root = f"{tmpdir_fresh}/t"
    VS.create_stored(spark, root, [("K", "TEXT"), ("N", "BIGINT")])
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('k', id) AS k", "id AS n").repartition(3)
    seen = [VS.append_new_stored(rows(lo, lo + 500), root, "K") for lo in (0, 500, 1000)]
    assert [(x["appended"], x["parts"]) for x in seen] == [(500, 0), (500, 1), (500, 2)]
    new = VS.append_new_stored(rows(5000, 5020), root, "k")  # of 60 filter tests hardly one errs
    assert new["appended"] == 20 and new["read"] <= 1
    again = VS.append_new_stored(rows(600, 610), root, "K")
    assert again["appended"] == 0 and again["version"] is None and again["read"] <= 2 and again["parts"] == 4
    mixed = spark.createDataFrame([("k1", 0), ("new", 1), ("new", 2), (None, 3)], "k string, n long")
    assert VS.append_new_stored(mixed, root, "K")["appended"] == 3
    assert VS.append_new_stored(mixed, root, "K")["appended"] == 1  # a null key is always new
    VS.write_stored(spark.createDataFrame([("plain", 9)], "K string, N long"), root)  # a part without a filter is read
    assert VS.append_new_stored(spark.createDataFrame([("plain", 9)], "K string, N long"), root, "K")["appended"] == 0
    table = VS.read_stored(spark, root)
    assert table.count() == 1520 + 3 + 1 + 1 and table.select("K").distinct().count() == 1520 + 1 + 1 + 1


def test_key_filter_holds_every_key(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS k")
    filters = VS.key_filter(keys, "k", 8)
    block, places = VS._places(VS.F.col("k"), 8)

    def hits(df):
        j = filters.join(df.withColumn("b", block), VS.F.col("b") == VS.F.col("block"))
        for w, bit in places:
            j = j.filter(VS.F.getbit(VS.F.element_at("words", w + 1), bit) == 1)
        return j.count()

    assert hits(keys) == 3000 and hits(spark.range(10000, 13000).selectExpr("concat('k', id) AS k")) < 150
