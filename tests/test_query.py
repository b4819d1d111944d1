import random

import pytest
from pyspark.sql import functions as F

from feedops.operators import joins, profile
from feedops.operators import query as op
from feedops.plans import ranked


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, i % 3, f"n{i % 2}", i / 2) for i in range(50)], "id int, k int, name string, v double")


def test_select_and_filter(table, plan):
    assert op.select_cols(table, "id, name").columns == ["id", "name"]
    with pytest.raises(ValueError, match=r"\['zz'\]"):
        op.select_cols(table, ["id", "zz"])
    with pytest.warns(UserWarning):
        got = op.where_eq(table, "k:1,name:n1,junk,zz:1")
    assert {r["id"] for r in got.collect()} == {i for i in range(50) if i % 3 == 1 and i % 2 == 1}
    assert op.where_eq(table, "k:abc").count() == 0
    assert op.where_any_eq(table, ["id", "k"], "1").count() == 17


def test_paging(table):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(op.page(table, ["v"], 5, 10)) == [10, 11, 12, 13, 14]
    for bad in ({"limit": 0}, {"limit": 10001, "most": 10000}, {"offset": -1}):
        with pytest.raises(ValueError):
            op.page(table, ["v"], **bad)
    rows, total = op.query(table, ["id"], "name", {"k": 1}, limit=3, offset=2)
    assert [tuple(r) for r in rows.collect()] == [("n1",), ("n0",), ("n1",)] and total.collect()[0][0] == 17


def test_ties_at_any_depth(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 AS v")
    for start in (10, 1500, 2900):
        assert op.rows_at(df, start, 5, ["v"]).count() == 5
    assert op.rows_at(df, 2998, 50, ["v"]).count() == 2
    assert op.page(df, ["v", "id"], 20_000).count() == 3000


@pytest.mark.parametrize("enough", [1_000_000, 5])
def test_deep_rows(spark, enough):
    rng = random.Random(enough)
    values = [(rng.choice([None, "a", "b", "b", "b"]), i) for i in range(300)]
    df = spark.createDataFrame(values, "s string, i int").repartition(7)
    ordered = sorted(values, key=lambda t: (t[0] is not None, t[0] or "", t[1]))
    for start, count in ((0, 1), (120, 30), (290, 50)):
        low, high = ranked.range_bounds(df, ["s", "i"], start, count, enough)
        got = df.filter(ranked.between(["s", "i"], low, high)).orderBy("s", "i").collect()
        assert [tuple(r) for r in got] == ordered[start:start + count]
    assert ranked.range_bounds(df, ["s", "i"], 300, 1) is None
    assert op.rows_at(df, 999, 5, ["s", "i"], shallow=0).count() == 0


def test_running_total_with_hot_group(spark, rows):
    data = [("hot" if i % 3 == 0 else f"g{i % 5}", i, 1 + i % 4) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, n bigint").repartition(6)
    got = {(g, i): t for g, i, _, t in rows(ranked.running_total(df, ["i"], "n", "t", ["g"]).select("g", "i", "n", "t"))}
    sums = {}
    for g, i, n in data:
        sums[g] = sums.get(g, 0) + n
        assert got[g, i] == sums[g]


def test_records(spark, rows):
    maps = spark.createDataFrame([("1", {"ISIN": "US1", "S2": "x"}), ("2", {"S1": "x"})], "id string, data map<string,string>")
    texts = maps.select("id", F.to_json("data").alias("data"))
    for df in (maps, texts):
        assert rows(op.find_by_attr(df, {"ISIN": "US1"}).select("id")) == [("1",)]
        assert rows(op.find_by_attr(df, {"S1": "x", "S2": "x"}, any_of=True).select("id")) == [("1",), ("2",)]
        assert rows(op.find_by_attr(df, {"S2": None}).select("id")) == [("1",)]
        assert rows(op.attrs(df, {"isin": "ISIN"})) == [("1", "US1"), ("2", None)]


def test_sql_and_metadata(spark, table, rows):
    got = op.sql(spark, "SELECT count(*) FROM t WHERE name = ? AND id > ?", {"t": table}, ["n1", 40])
    assert got.collect()[0][0] == 5
    assert rows(op.describe_table(table))[0] == (0, "id", "int", 50, 4)
    assert op.where(table, "v > 20").count() == 9
    assert op.head(table, 7).count() == 7 and op.sample(table, 0.5, 1).count() == op.sample(table, 0.5, 1).count()


def test_joins(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, name string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "id int, name string")
    c = spark.createDataFrame([("p", 1), ("q", 2)], "code string, n int")
    tables = {"a": a, "b": b, "c": c}
    keys = [("a", "id", "b", "id"), ("b", "name", "c", "code")]
    joined = joins.join_tables(tables, ["a", "b", "c"], keys)
    assert joined.columns == ["id", "name", "b_id", "b_name", "code", "n"]
    assert rows(joined) == [(1, "x", 1, "p", "p", 1), (1, "x", 1, "q", "q", 2)]
    assert rows(joins.join_tables(tables, ["a", "b", "c"], keys, slices=4).select(joined.columns)) == rows(joined)
    with pytest.raises(ValueError, match="missing from the catalog: d"):
        joins.join_tables(tables, ["a", "d"], keys)
    with pytest.raises(ValueError, match="no join condition"):
        joins.join_tables(tables, ["a", "c"], keys)
    limited = joins.join_limited(tables, ["b", "c"], [("b", "name", "c", "code")], 2, ["name"])
    assert limited.count() == 2
    kept = joins.filter_shared(tables, ["a", "b", "c"], {"ID": "1", "N": 2})
    assert [kept[t].count() for t in "abc"] == [1, 2, 1]
    assert rows(joins.semi_reduce(a, b, "id")) == [(1, "p"), (1, "q")]
    assert rows(joins.missing_keys(b, a, "id")) == [(3,)]
    assert rows(joins.missing_summary({"t1": b, "t2": a}, a, "ID")) == [("t1", 1), ("t2", 0)]


def test_spread_join_hot_key(spark, rows):
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(900)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{j}", j) for j in range(30)]], "k string, r int")
    got = joins.spread_join(left, right, "k", slices=4)
    assert rows(got.select("k", "i", "r")) == rows(left.join(right, "k").select("k", "i", "r"))


def test_no_key_list_limit(spark):
    small, big = spark.range(5000), spark.range(20000)
    assert joins.semi_reduce(small, big, "id").count() == 5000


def test_profile(spark, table, rows):
    import numpy as np

    rng = random.Random(1)
    values = [rng.choice([None, 1.0, 1.0, 2.5, rng.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").repartition(5)
    got = {r["column"]: r for r in profile.describe(df, ["v", "i"]).collect()}
    real = np.array([v for v in values if v is not None])
    for q, p in (("q25", 25), ("q50", 50), ("q75", 75)):
        assert got["v"][q] == pytest.approx(np.percentile(real, p)) and got["i"][q] == pytest.approx(np.percentile(range(501), p))
    assert got["v"]["count"] == len(real) and got["v"]["std"] == pytest.approx(real.std(ddof=1))
    near = profile.describe(df, ["i"], approximate=True).collect()[0]
    assert abs(near["q50"] - 250) <= 1
    assert profile.column_stats(table, "name").columns == ["value", "count", "sample_size", "sample_fraction"]
    empty = profile.describe(df.filter("i < 0"), ["v"])
    assert empty.count() in (0, 1)


def test_value_counts(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",), ("a",), ("c",)], "x string")
    assert [tuple(r) for r in profile.value_counts(df, "x").collect()] == [("a", 3), ("c", 2), ("b", 1)]
    assert profile.value_counts(df, "x", 2).count() == 2
    assert profile.value_count_summary(df, "x", 2).collect()[0] == (7, 3, 2, 1)
    counts = profile.value_counts(df, "x")
    merged = profile.merge_counts([counts, counts])
    assert [tuple(r) for r in merged.collect()] == [("a", 6), ("c", 4), ("b", 2)]
    assert profile.merge_summary(merged, 2).collect()[0] == (2, 3, 12)
    with pytest.raises(ValueError, match="a count table needs"):
        profile.merge_counts([df])


def test_infer_types(spark):
    df = spark.createDataFrame(
        [(i, str(i), f"{i}.5" if i else "7", "null" if i else "", "t", "2024-01-31", "x" if i == 150 else "1") for i in range(200)],
        "i int, a string, b string, c string, d string, e string, f string")
    got = {r["name"]: r["data_type"] for r in profile.infer_types(df, ["i"], 100, list("abcdef")).collect()}
    assert got == {"a": "integer", "b": "numeric", "c": "text", "d": "boolean", "e": "date", "f": "integer"}
    every = {r["name"]: r["data_type"] for r in profile.infer_types(df, columns=["f"]).collect()}
    assert every == {"f": "text"}


def test_shared_folder_is_the_named_one(spark, tmp_path, monkeypatch):
    from feedops import session

    named = {"spark.checkpoint.dir": str(tmp_path)}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: named.get(key, default))
    assert session.scratch_path(spark, "x").startswith(f"{tmp_path}/feedops/x-")
    monkeypatch.undo()
    assert session.shared_dir(spark) != str(tmp_path)
    assert session.durable(spark.range(5)).count() == 5


@pytest.mark.parametrize("hot,drawn", [(None, 10_000), (7, 10_000), (7, 150)])
def test_narrowed_ranges(spark, monkeypatch, hot, drawn):
    """Position look-up by value range, with NULLs and a value that holds a third of the rows."""
    monkeypatch.setattr(ranked, "SAMPLED", drawn)
    rng = random.Random(4)
    values = [(hot if i % 3 == 0 else rng.randrange(1000), i) for i in range(2000)]
    df = spark.createDataFrame(values, "v int, i int").repartition(5)
    ordered = sorted(values, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    for start, count in ((0, 10), (600, 200), (1000, 3), (1990, 50)):
        got = op.rows_at(df, start, count, ["v", "i"], shallow=0).collect()
        assert [tuple(r) for r in got] == ordered[start:start + count]
    texts = df.select(F.col("v").cast("string").alias("v"), "i")
    ordered = sorted(((None if v is None else str(v), i) for v, i in values), key=lambda t: (t[0] is not None, t[0] or "", t[1]))
    for start, count in ((0, 10), (700, 20), (1100, 300), (1999, 1)):
        got = op.rows_at(texts, start, count, ["v", "i"], shallow=0).collect()
        assert [tuple(r) for r in got] == ordered[start:start + count]


@pytest.mark.parametrize("enough", [0, 100_000, 20])
def test_quantiles_by_narrowing(spark, monkeypatch, enough):
    """Exact ranks with hot values, NaN, NULLs and an empty column."""
    import numpy as np

    from feedops.plans import selection

    if enough:  # 0: the built-in percentile
        monkeypatch.setattr(profile, "BUILT_IN", 1)
        monkeypatch.setattr(selection, "ENOUGH", enough)
    rng = random.Random(enough)
    data = [
        (5.0 if i % 3 == 0 else rng.random() * 10, float(rng.randrange(3)), None if i % 2 else rng.gauss(0, 1), None,
         float("nan") if i % 5 == 0 else float(i)) for i in range(3000)
    ]
    df = spark.createDataFrame(data, "hot double, few double, half double, none double, nans double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.6, 0.75, 0.999, 1.0]
    got = {(r["column"], r["probability"]): r["quantile"] for r in profile.quantiles(df, df.columns, probs).collect()}
    for i, c in enumerate(df.columns):
        real = [r[i] for r in data if r[i] is not None and r[i] == r[i]]
        for p in probs:
            if real:
                assert got[c, p] == pytest.approx(np.quantile(real, p)), (c, p)
            else:
                assert (c, p) not in got


def test_spread_join_of_equal_rows(spark, data, plan):
    left, right = spark.createDataFrame([(1,)] * 64 + [(2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, v string")
    got = joins.spread_join(left, right, "k", slices=4)
    assert sorted(got.groupBy("v").count().collect()) == [("a", 64), ("b", 1), ("c", 64)]
    lines, orders = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("lineitem", "orders"))
    text = plan(joins.spread_join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), orders, "o_orderkey").select("l_quantity", "o_custkey"))
    assert "l_extendedprice" not in text and "l_comment" not in text


def test_slices_are_the_same_when_rows_are_read_again(spark, data):
    """What a rerun task would see: rows in another order must get the slices they had."""
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    for frame in (lines, lines.select("l_orderkey", "l_quantity").filter("l_quantity > 5")):
        one, two = (dict(joins._placed(frame.repartition(n, "l_orderkey")).groupBy("l_orderkey").agg(F.sum(F.pmod("__place", F.lit(16)))).collect()) for n in (3, 7))
        assert one == two
    shuffled = lines.repartition(4).select("l_orderkey", "l_linenumber")
    assert "monotonically" not in joins.spread_join(shuffled, lines.select("l_orderkey", "l_tax"), "l_orderkey")._jdf.queryExecution().toString()
