import datetime as dt

import pytest

from feedops.operators import entity as op

TYPES = {"NAME": "text", "VALUE": "integer", "RATE": "float", "ID_BB_GLOBAL": "text"}


@pytest.fixture
def feed(spark):
    return spark.createDataFrame(
        [("BBG1", "one", "1", "1.50", "x", "f.20240101.csv.gz", "20240101", 1), ("BBG1", "uno", "N.A.", "abc", "x", "f.20240102.csv.gz", "20240102", 1),
         ("BBG1", "eins", "7.9", None, "x", "f.20240102.csv.gz", "20240102", 2), ("BBG2", "null", "a1", "2", "x", "f.20240101.csv.gz", "20240101", 2),
         ("XXX", "no", "1", "1", "x", "f.20240101.csv.gz", "20240101", 3), ("", "no", "1", "1", "x", "f.20240101.csv.gz", "20240101", 4)],
        "ID_BB_GLOBAL string, NAME string, VALUE string, RATE string, OTHER string, _file string, _date string, n int")


ORDER = ["_date", "_file", "n"]


def test_state(feed, rows):
    state = op.entity_state(feed, "ID_BB_GLOBAL", TYPES, ORDER)
    assert state.columns == ["ID_BB_GLOBAL", "NAME", "VALUE", "RATE"]
    assert rows(state) == [("BBG1", "eins", "7", "abc"), ("BBG2", None, "a1", "2")]
    records = {r["id"]: r["data"] for r in op.entity_records(feed, "ID_BB_GLOBAL", TYPES, ORDER).collect()}
    assert records["BBG2"] == {"VALUE": "a1", "RATE": "2"}


def test_history(feed, rows):
    history = op.entity_history(feed, "ID_BB_GLOBAL", TYPES, ORDER)
    got = rows(history.select("id", "property", "effective_date", "file", "value"))
    assert [r for r in got if r[0] == "BBG1" and r[1] == "NAME"] == [
        ("BBG1", "NAME", "20240101", "f.20240101.csv.gz", "one"), ("BBG1", "NAME", "20240102", "f.20240102.csv.gz", "eins")]
    assert ("BBG1", "RATE", "20240102", "f.20240102.csv.gz", "abc") in got and len(got) == 8
    # the last value of every property is the state
    state = {(r["ID_BB_GLOBAL"], c): r[c] for r in op.entity_state(feed, "ID_BB_GLOBAL", TYPES, ORDER).collect() for c in ("NAME", "VALUE", "RATE")}
    last = {}
    for i, p, d, _, v in sorted(got, key=lambda r: r[2]):
        last[i, p] = v
    assert last == {k: v for k, v in state.items() if v is not None}
    docs = {(r["id"], r["property"]): r["history"] for r in op.history_documents(history).collect()}
    assert docs["BBG2", "VALUE"] == '{"20240101":{"file":"f.20240101.csv.gz","value":"a1"}}'


def test_mismatches_and_metadata(spark, feed, rows):
    found = op.type_mismatches(feed, TYPES, key="ID_BB_GLOBAL")
    assert rows(found) == [("f.20240101.csv.gz", "VALUE", "integer", "text"), ("f.20240102.csv.gz", "RATE", "float", "text")]
    meta = spark.createDataFrame(
        [("f.20240101.csv.gz", 4, [("NAME", "text"), ("VALUE", "integer")]), ("other", 1, [("VALUE", "integer")])],
        "filename string, rowCount int, columns array<struct<name:string,dataType:string>>")
    fixed = {r["filename"]: [tuple(c) for c in r["columns"]] for r in op.correct_metadata(meta, found).collect()}
    assert fixed == {"f.20240101.csv.gz": [("NAME", "text"), ("VALUE", "text")], "other": [("VALUE", "integer")]}


def test_inputs(spark, rows):
    inv = spark.createDataFrame(
        [(f"r/{d}/{n}", f"r/{d}", n, 1, dt.datetime(2024, 1, 1)) for d, n in
         [("A", "a.20240101.csv.gz"), ("A", "a.20240201.csv.gz"), ("B", "b.20240101.csv.gz")]],
        "path string, directory string, name string, size bigint, mtime timestamp")
    kinds = spark.createDataFrame([("A", "asset"), ("B", "company")], "filename string, category string")
    assert rows(op.entity_inputs(inv, kinds).select("name")) == [("a.20240201.csv.gz",)]


def test_no_python_in_plans(feed, plan):
    text = plan(op.entity_state(feed, "ID_BB_GLOBAL", TYPES, ORDER))
    assert "EvalPython" not in text and text.count("hashpartitioning") == 1


def test_other_prefix_and_no_columns(spark):
    rows = spark.createDataFrame([("XY1", "5", "f", "20240101", 1), ("XY1", "6", "f", "20240101", 2), ("BBG1", "7", "f", "20240101", 3)],
                                 "id string, a string, _file string, _date string, n int")
    assert [str(r["a"]) for r in op.entity_state(rows, "id", {"a": "integer"}, ["n"], prefix="XY").collect()] == ["6"]
    assert op.entity_history(rows, "id", {"a": "integer"}, ["n"], prefix="XY").count() == 1
    assert [r["id"] for r in op.entity_state(rows, "id", {}, ["n"]).collect()] == ["BBG1"]
    assert op.entity_history(rows, "id", {}, ["n"]).count() == 0
    assert op.type_mismatches(rows, {"a": "text"}).count() == 0
