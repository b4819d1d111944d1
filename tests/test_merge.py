import pytest
from pyspark.sql import functions as F

from feedops.operators import merge as op


@pytest.fixture
def target(spark):
    return spark.createDataFrame(
        [("1", {"name": "one", "price": "1"}), ("2", {"name": "two", "price": "2"}), ("9", {"name": "nine"})],
        "id string, data map<string,string>")


@pytest.fixture
def staged(spark):
    return spark.createDataFrame(
        [("1", None, "11", "x", "20240101", 1), ("1", "uno", None, "x", "20240101", 2), ("2", "N.A.", "", "y", "20240101", 1),
         ("3", "three", "3", None, "20240101", 1), ("", "no key", "0", "z", "20240101", 1), (None, "no key", "0", "z", "20240101", 1)],
        "Id string, name string, price string, Order string, FileDate string, seq int")


def records(df):
    return {r["id"]: r["data"] for r in df.collect()}


def upsert(target, staged, **options):
    options.setdefault("exclude", [*op.BOOKKEEPING, "seq"])
    return records(op.upsert_records(target, staged, "ID", ["seq"], **options))


def test_rules(target, staged):
    got = upsert(target, staged)
    # NULL and null tokens do not overwrite, absent attributes stay, new keys come in, bookkeeping and blank keys do not
    assert got["1"] == {"name": "uno", "price": "11", "Order": "x"}
    assert got["2"] == {"name": "two", "price": "2", "Order": "y"}
    assert got["3"] == {"name": "three", "price": "3", "Order": None}
    assert got["9"] == {"name": "nine"} and set(got) == {"1", "2", "3", "9"}


def test_variants(target, staged):
    over = upsert(target, staged, null_policy="overwrite")
    assert over["1"] == {"name": "uno", "price": None, "Order": "x"} and over["2"] == {"name": None, "price": None, "Order": "y"}
    assert set(upsert(target, staged, insert_missing=False)) == {"1", "2", "9"}
    assert upsert(target, staged, strip_nulls=True)["3"] == {"name": "three", "price": "3"}
    lower = upsert(target, staged, key_case="lower", reserved="prefix")
    assert lower["3"] == {"name": "three", "price": "3", "_order": None}
    assert upsert(target, staged, typed=False)["2"]["name"] == "N.A."


def test_idempotent_and_preview(spark, target, staged):
    options = {"exclude": [*op.BOOKKEEPING, "seq"]}
    once = op.upsert_records(target, staged, "id", ["seq"], **options)
    twice = op.upsert_records(once, staged, "id", ["seq"], **options)
    assert records(once) == records(twice)
    assert op.upsert_preview(target, staged, "id", ["seq"], **options).collect()[0] == (1, 2, 0)
    assert op.upsert_preview(once, staged, "id", ["seq"], **options).collect()[0] == (0, 0, 3)


def test_missing_key(target, staged):
    with pytest.raises(ValueError, match="no column"):
        op.upsert_records(target, staged, "isin")


def test_verify(target, staged):
    got = op.verify_records(op.upsert_records(target, staged, "id", ["seq"], exclude=[*op.BOOKKEEPING, "seq"]))
    assert got.collect()[0] == (4, 4, 0, 10, 1, 3)


@pytest.fixture
def frames(spark):
    new = spark.createDataFrame([("1", "n1"), ("2", "n2")], "id string, a string")
    mid = spark.createDataFrame([("2", "m2", "b2"), ("3", "m3", "b3")], "id string, a string, b string")
    old = spark.createDataFrame([("4", "o4", "b4")], "id string, a string, b string")
    return [("20240101", old), ("20240301", new), ("20240201", mid)]


def test_newest_columns(frames, rows):
    expected = [("1", "n1", None), ("2", "n2", "b2"), ("3", None, "b3")]
    assert rows(op.merge_newest_columns(frames, "id")) == expected
    assert rows(op.merge_newest_columns(frames, "id", dedupe=False)) == expected
    everything = op.merge_newest_columns(frames, "id", keep_all_keys=True)
    assert rows(everything) == [*expected, ("4", None, None)] and everything.columns == ["id", "a", "b"]
    assert rows(op.merge_newest_columns(frames, "id", keep_all_keys=True, dedupe=False)) == rows(everything)
    with pytest.raises(ValueError, match="nothing to merge"):
        op.merge_newest_columns([], "id")


def test_newest_columns_duplicates(spark, frames, rows):
    twice = spark.createDataFrame([("1", "n1", 1), ("1", "n9", 2)], "id string, a string, seq int")
    mid = frames[2][1]
    got = op.merge_newest_columns([("2", twice), ("1", mid)], "id", {"2": ["seq"], "1": ["b"]})
    assert rows(got) == [("1", "n9", 2, None), ("2", None, None, "b2"), ("3", None, None, "b3")]
    plain = op.merge_newest_columns([("2", twice), ("1", mid)], "id", dedupe=False)
    assert plain.count() == 4


def test_one_shuffle(frames, plan):
    text = plan(op.merge_newest_columns(frames, "id"))
    assert text.count("hashpartitioning") == 1


def test_track_keys(spark, rows):
    df = spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k1", "a"), ("k2", "a"), ("", "a"), (None, "a"), ("k0", "c")], "k string, f string")
    assert [tuple(r) for r in op.track_keys(df, "k", "f").collect()] == [("k1", 3, "a,b"), ("k0", 1, "c"), ("k2", 1, "a")]


def test_load_report(spark):
    runs = spark.createDataFrame(
        [("a", "success", 10, 2.0), ("b", "error", 99, 1.0), ("c", "success", 20, 3.0)],
        "file_path string, status string, rows_processed bigint, processing_time_seconds double")
    assert op.load_report(runs).collect()[0] == (3, 2, 1, 30, 6.0, 2.0, 5.0)
    df = spark.createDataFrame([("a", None), ("a", "bad"), ("b", None)], "_file string, _corrupt_record string")
    got = {r["file_path"]: tuple(r)[1:] for r in op.load_runs(df, bad_row=F.col("_corrupt_record").isNotNull()).collect()}
    assert got == {"a": ("error", 1, "1 malformed rows", None), "b": ("success", 1, None, None)}
    files = spark.createDataFrame([("a", None), ("b", None), ("c", "not readable"), ("d", None)], "path string, error string")
    seconds = spark.createDataFrame([("b", 2.0)], "file_path string, processing_time_seconds double")
    runs = op.load_runs(df, files=files, seconds=seconds)
    assert {r["file_path"]: tuple(r)[1:] for r in runs.collect()} == {
        "a": ("success", 2, None, None), "b": ("success", 1, None, 2.0), "c": ("error", 0, "not readable", None), "d": ("error", 0, "no rows", None)}
    assert op.load_report(runs).collect()[0] == (4, 2, 2, 3, 2.0, 2.0, 1.5)
