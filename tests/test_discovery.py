import datetime as dt

import pytest

from feedops.operators import discovery as op


@pytest.fixture
def inv(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    files = [
        ("a/EQUITY_out", "x.20240101.csv.gz", 5, day(9)), ("a/EQUITY_out", "x.20240301.csv.gz", 7, day(1)),
        ("a/EQUITY_out", "x.20241399.csv.gz", 9, day(8)), ("a/b/c", "z.20240101.csv.gz", 1, day(3)),
        ("a/b/c", "y.20240101.csv.gz", 2, day(4)), ("a/b/c", "nodate.csv.gz", 3, day(5)), ("", "root.20240101.csv", 0, day(6)),
    ]
    return spark.createDataFrame(
        [(f"{d}/{n}".lstrip("/"), d, n, s, t) for d, n, s, t in files],
        "path string, directory string, name string, size bigint, mtime timestamp")


def test_filter_levels(inv, rows):
    names = lambda df: {r["directory"] for r in df.collect()}
    assert names(op.filter_dirs(inv)) == {"", "a/EQUITY_out", "a/b/c"}
    # a/ itself does not match, so its children are hidden; root files always pass
    assert names(op.filter_dirs(inv, include="EQUITY")) == {""}
    assert names(op.filter_dirs(inv, include="^a/", exclude="b/")) == {"", "a/EQUITY_out"}
    assert names(op.filter_dirs(inv, include="^a$", mode="leaf")) == {"a/EQUITY_out", "a/b/c"}
    assert names(op.filter_dirs(inv, exclude="^a$", mode="leaf")) == set()


def test_folders(inv, rows):
    assert rows(op.folders_containing(inv, "equity")) == [("a/EQUITY_out",)]


def test_latest(inv, rows):
    got = rows(op.latest_per_dir(inv).select("directory", "name"))
    assert got == [("", "root.20240101.csv"), ("a/EQUITY_out", "x.20240301.csv.gz"), ("a/b/c", "z.20240101.csv.gz")]


def test_effective_date_errors(inv):
    errors = {r["name"]: r["error"] for r in op.with_effective_date(inv).collect()}
    assert errors["nodate.csv.gz"].startswith("name without") and errors["x.20241399.csv.gz"].startswith("name with an impossible")
    assert errors["x.20240101.csv.gz"] is None


def test_recent_and_size(inv, rows):
    recent = op.recent_per_dir(inv, 2)
    got = rows(recent.select("directory", "rank", "name"))
    assert ("a/EQUITY_out", 1, "x.20240101.csv.gz") in got and ("a/b/c", 2, "y.20240101.csv.gz") in got and len(got) == 5
    assert op.total_size(recent).collect()[0] == (5, 5 + 9 + 3 + 2 + 0)


def test_pair(inv, rows):
    got = {r["directory"]: r for r in op.snapshot_pair(inv).collect()}
    # an invalid date falls back to the modification time
    assert got["a/EQUITY_out"]["current"].endswith("x.20240301.csv.gz") and got["a/EQUITY_out"]["previous"].endswith("x.20241399.csv.gz")
    # same effective moment: the later modification wins
    assert got["a/b/c"]["current"].endswith("nodate.csv.gz") and got["a/b/c"]["previous"].endswith("y.20240101.csv.gz")
    assert got[""]["error"].startswith("a pair needs") and got[""]["previous"] is None
    by_time = {r["directory"]: r["current"] for r in op.snapshot_pair(inv, by="mtime").collect()}
    assert by_time["a/EQUITY_out"].endswith("x.20240101.csv.gz")


def test_top_files(spark):
    meta = spark.createDataFrame(
        [("FEED_AMER_OUT", 622401), ("FEED_EURO_OUT", 845632), ("FEED_ASIA_OUT", 723450), ("FEED_AFRICA_OUT", 321789),
         ("FEED_OCEANIA_OUT", 125678), ("FEED_NONE_OUT", None)], "filename string, rowCount bigint")
    names = [r["filename"].split("_")[1] for r in op.top_files_by_rows(meta).collect()]
    assert names == ["EURO", "ASIA", "AMER", "AFRICA", "OCEANIA", "NONE"]


def test_hot_directory_is_cut_in_map_tasks(inv, plan):
    assert "WindowGroupLimit" in plan(op.latest_per_dir(inv))
