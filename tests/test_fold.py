"""Newest value per column: rows, shuffled bytes and measured load times."""

import os
import random

import pytest

from feedops.operators import merge as op
from feedops.operators.entity import entity_history
from feedops.plans import fold
from feedops.sources import csv as src


def plain(rows, width):
    """Newest non-null value of each column per key, by sorting."""
    out = {}
    for key, order, cells in sorted(rows, key=lambda r: (r[0], r[1])):
        own = out.setdefault(key, [None] * width)
        for i, c in enumerate(cells):
            own[i] = c if c is not None else own[i]
    return sorted((k, *v) for k, v in out.items())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("batch", [7, 10_000])
def test_equals_plain(spark, seed, batch):
    rng = random.Random(seed)
    keys = ["hot"] * 200 + [f"k{i}" for i in range(40)]
    rows = [(rng.choice(keys), (day, nr), [rng.choice([None, None, f"v{nr}"]) for _ in range(4)]) for nr, day in enumerate(rng.choices(["a", "b", "c"], k=400))]
    rows.append(("empty", ("a", 1), [None] * 4))
    df = spark.createDataFrame([(k, *o, *c) for k, o, c in rows], "k string, day string, nr long, a string, b string, c string, d string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sorted(tuple(r) for r in op.newest_values(df, "k", ["a", "b", "c", "d"], ["day", "nr"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 4)


def test_odd_inputs(spark, rows):
    df = spark.createDataFrame([("k", None, 1, "x"), ("k", 2, None, None), ("", 3, 3, "y"), (None, 4, 4, "z")], "k string, `a b` int, o int, x string")
    assert rows(op.newest_values(df, "k", ["a b", "x"], ["o"])) == [("k", 2, "x")]
    assert rows(op.newest_values(df, "k", [], ["o"])) == [("k",)]
    assert rows(op.newest_values(df.limit(0), "k", ["x"], ["o"])) == []
    assert rows(op.newest_values(df, "k", ["k", "o"], ["o"])) == [("k", "k", 1)]


def shuffled(df):
    """Bytes that the exchanges of an executed frame wrote, before compression."""
    rows, total = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, total


def test_the_order_moves_once_per_row(spark):
    """300 columns: a longer order adds its own bytes per row, not per column."""
    cells = ", ".join(f"c{i} string" for i in range(300))
    rows = [(f"k{n % 20}", n, *[f"{n}.{i}" if (n + i) % 3 else None for i in range(300)]) for n in range(60)]
    df = spark.createDataFrame(rows, f"k string, n long, {cells}").coalesce(1)
    names, text = [f"c{i}" for i in range(300)], 400
    short = op.newest_values(df, "k", names, ["n"])
    long = op.newest_values(df.withColumn("file", fold.F.rpad("k", text, "x")), "k", names, ["file", "n"])
    (a, small), (b, large) = shuffled(short), shuffled(long)
    assert sorted(a) == sorted(b) and small > 0
    assert large - small < 60 * (text + 64)


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(50_000).selectExpr("'hot' AS k", "id", "CAST(id AS string) AS a", "IF(id % 1000 = 1, 'x', NULL) AS b").coalesce(2)
    kept = fold.newest_cells(df, ["k"], ["a", "b"], "id")
    assert kept.count() <= 2 * 3


def test_history_keeps_the_file_of_each_value(spark, rows):
    data = [("BBG1", "1", None, "f1", "20240101", 1), ("BBG1", None, "5", "f2", "20240101", 2), ("BBG1", "2", None, "f3", "20240102", 1)]
    df = spark.createDataFrame(data, "id string, a string, b string, _file string, _date string, nr int")
    got = rows(entity_history(df, "id", {"a": "integer", "b": "text"}, ["nr"]))
    assert got == [("BBG1", "a", "20240101", "f1", "1"), ("BBG1", "a", "20240102", "f3", "2"), ("BBG1", "b", "20240101", "f2", "5")]


def test_measured_seconds(spark, tmp_path):
    for i in range(3):
        with open(os.path.join(tmp_path, f"f{i}_20240101.csv"), "w") as f:
            f.write("a,b\n" + "1,2\n" * (20_000 if i else 1))
    feed = src.read_feed(spark, f"{tmp_path}/*.csv", clock=True)
    runs = {r["file_path"].rpartition("/")[2]: r for r in op.load_runs(feed).collect()}
    assert {n: r["rows_processed"] for n, r in runs.items()} == {"f0_20240101.csv": 1, "f1_20240101.csv": 20_000, "f2_20240101.csv": 20_000}
    assert all(0 < r["processing_time_seconds"] < 60 for r in runs.values())
    report = op.load_report(op.load_runs(feed)).collect()[0]
    assert report["total_seconds"] > 0 and report["rows_per_second"] > 0


def test_parts_of_a_file_add_up(spark):
    ns = [("a", 0, 10), ("a", 0, 30), ("b", 0, 50), ("b", 1, 100), ("b", 1, 101), ("c", 2, 7)]
    df = spark.createDataFrame([(f, (t, n)) for f, t, n in ns], "_file string, _read_at struct<task int, nanos bigint>")
    got = {r[0]: round(r[1] * 1e9) for r in op.measured_seconds(df).collect()}
    assert got == {"a": 20, "b": 21, "c": 1}
