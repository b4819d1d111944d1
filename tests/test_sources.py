import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from feedops import sinks
from feedops.operators import profile
from feedops.sources import csv as src
from feedops.sources import documents, inventory, staging
from feedops.streaming.ingest import ingest_incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open(path, "wt") if path.suffix == ".gz" else open(path, "w")).write(text)
    return str(path)


def test_header_rules(spark, rows):
    assert src.dedupe_header(["a", "Account", "b", "Account", "Account"]) == ["a", "Account", "b", "Account_3", "Account_4"]
    assert src.extend_header(["a", "b"], [["1", "2"], ["1", "2", "3", "4"]]) == ["a", "b", "column_3", "column_4"]
    assert rows(src.column_mapping(spark, ["x", "x"])) == [(0, "x", "x", False), (1, "x", "x_1", True)]


def test_text_csv(spark, tmp_path, rows):
    path = put(tmp_path / "a.csv", 'id,Account,Account,n te\n007,"x ""y"", z",,\n2,"",b,3,extra\n3,short\n')
    df = src.read_text_csv(spark, path)
    assert df.columns == ["id", "Account", "Account_2", "n te", "column_5"]
    assert rows(df) == [("007", 'x "y", z', None, None, None), ("2", "", "b", "3", "extra"), ("3", "short", None, None, None)]
    with pytest.raises(ValueError, match="no header"):
        src.read_text_csv(spark, put(tmp_path / "empty.csv", ""))
    piped = put(tmp_path / "p.csv", "a|b\n'1|2'|3\n")
    assert rows(src.read_text_csv(spark, piped, sep="auto", quote="'")) == [("1|2", "3")]


def test_different_headers(spark, tmp_path, rows):
    a = put(tmp_path / "a_20240101.csv.gz", "id,x\n1,a\n")
    b = put(tmp_path / "b_20240102.csv.gz", "id,y\n2,b\n")
    df = src.read_feed(spark, [a, b, a])
    assert rows(df.select("id", "x", "y", "_source_date")) == [("1", "a", None, "20240101"), ("2", None, "b", "20240102")]


def test_inferred(spark, tmp_path):
    lines = "".join(f"{i},{i}.5,x\n" for i in range(2000)) + "z,1,y\n"
    df = src.read_inferred_csv(spark, put(tmp_path / "a.csv", "a,b,c\n" + lines))
    assert dict(df.dtypes) == {"a": "string", "b": "double", "c": "string"}


def test_limit_per_file(spark, rows):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 4)).alias("_file"),
                                  F.col("id"))
    for n in (10, 1200):
        got = {}
        for f, i in rows(src.limit_per_file(df, n, ["id"])):
            got.setdefault(f, []).append(i)
        want = {}
        for i in range(5000):
            want.setdefault("hot" if i % 3 == 0 else f"f{i % 4}", []).append(i)
        assert {f: sorted(v) for f, v in got.items()} == {f: v[:n] for f, v in want.items()}


@pytest.mark.parametrize("n", [1, 7, 40, 100, 2000])
def test_limit_per_file_by_value(spark, n):
    """Ties at the cut, order values and files that are null, a file with half the rows, files with fewer rows."""
    made = [(None if i % 2 else f"f{i % 6}", None if i % 5 == 0 else i // 9, f"v{i % 4}", i) for i in range(400)]
    df = spark.createDataFrame(made, "`the file` string, a int, `b.c` string, id int")
    got = src.limit_per_file(df, n, ["a", "b.c"], "the file", ranked=0)
    assert got.columns == df.columns
    found = [tuple(r) for r in got.collect()]
    assert len(set(found)) == len(found) and set(found) <= set(made)
    for name in (None, "f0", "f2", "f4"):
        order = sorted(((r[1] is not None, r[1] or 0, r[2]) for r in made if r[0] == name))
        assert sorted((r[1] is not None, r[1] or 0, r[2]) for r in found if r[0] == name) == order[:n]
    assert src.limit_per_file(df.limit(0), n, ["a"], "the file", ranked=0).collect() == []


def test_limit_per_file_neither_ranks_nor_moves_rows(spark, plan):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("_file"), "id", F.lit("wide").alias("body"))
    text = plan(src.limit_per_file(df, 1200, ["id"]))
    assert "Window" not in text and "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_reconcile(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("c",)], "_file string")
    meta = spark.createDataFrame([("a", 3), ("b", 4)], "filename string, rowCount int")
    assert rows(src.reconcile_counts(df, meta)) == [
        ("a", 3, 2, 66, False), ("b", 4, 0, 0, False), ("c", 0, 1, None, False)]


FEEDS = {
    "firms/firms_20230630.gz": "nr,title,listed,seen_at,ID_BB_COMPANY\n7,Alpha,yes,2022-05-01 08:00:00,F7\n"
                               "8,Beta,no,2022-05-02 09:30:00,F8\n",
    "bonds/bonds_20230701.gz": "nr,coupon,matures,ID_BB_GLOBAL\n1,4.25,2031-12-15,BBG00X\n",
    "notes/notes_20230702.gz": "nr,remark\n5,\n",
    "odd/undated.gz": "a\n1\n",
}


def test_metadata(spark, tmp_path):
    for name, text in FEEDS.items():
        put(tmp_path / name, text)
    meta = profile.extract_metadata(spark, str(tmp_path))
    got = {r["filename"]: r for r in meta.collect()}
    firms = got["firms"]
    assert firms["relativePath"] == "firms/firms_20230630.gz" and firms["effectiveDate"] == "20230630"
    assert firms["rowCount"] == 2 and firms["error"] is None
    assert [tuple(c) for c in firms["columns"]] == [
        ("nr", "integer"), ("title", "text"), ("listed", "boolean"), ("seen_at", "timestamp"), ("ID_BB_COMPANY", "text")]
    assert [c["dataType"] for c in got["bonds"]["columns"]] == ["integer", "numeric", "date", "text"]
    assert [c["dataType"] for c in got["notes"]["columns"]] == ["integer", "text"]
    assert got["odd"]["effectiveDate"] is None and "undated" in got["odd"]["error"] and got["odd"]["rowCount"] == 1
    kinds = {r[0]: r[1] for r in profile.categorise(meta).collect()}
    assert kinds == {"firms": "company", "bonds": "asset", "notes": "exception", "odd": "exception"}


def test_metadata_types_come_from_all_rows(spark, tmp_path):
    body = "".join(f"{i}\n" for i in range(100)) + "late text\n"
    put(tmp_path / "f/f_20240101.gz", "a\n" + body)
    row = profile.extract_metadata(spark, str(tmp_path)).collect()[0]
    assert row["rowCount"] == 101 and row["columns"][0]["dataType"] == "text"
    row = profile.extract_metadata(spark, str(tmp_path), sample=100).collect()[0]
    assert row["rowCount"] == 101 and row["columns"][0]["dataType"] == "integer"


def test_files_without_text_are_listed_with_an_error(spark, tmp_path, rows):
    assert profile.extract_metadata(spark, str(tmp_path)).collect() == []
    put(tmp_path / "f/f_20240101.gz", "a,b\n1,2\n")
    put(tmp_path / "g/g_20240101.gz", "")
    put(tmp_path / "h/part-prices-20240101.csv.gz", "a\n1\n")
    got = {r["filename"]: (r["rowCount"], r["error"]) for r in profile.extract_metadata(spark, str(tmp_path)).collect()}
    assert got == {"f": (1, None), "g": (0, "no rows in g_20240101.gz"), "h": (1, None)}


def test_every_file_has_its_own_header(spark, tmp_path, rows):
    put(tmp_path / "a.csv", "id,a,b\n1,A,B\n")
    put(tmp_path / "b.csv", "id,b,a\n2,B,A\n" + "3,b,a\n" * 9 + '4,"x,y",z,EXTRA\n')
    df = src.read_text_csv(spark, f"{tmp_path}/*.csv")
    assert set(df.columns) == {"id", "a", "b", "column_4"}
    got = rows(df.filter("id IN ('1', '2', '4')").select("id", "a", "b", "column_4"))
    assert got == [("1", "A", "B", None), ("2", "A", "B", None), ("4", "z", "x,y", "EXTRA")]
    found = src.misfits(spark, f"{tmp_path}/*.csv").collect()
    assert {r["path"].rpartition("/")[2]: tuple(r)[1:] for r in found} == {"a.csv": (1, 0, 0), "b.csv": (11, 0, 1)}


def test_names_that_differ_in_case_only(spark, tmp_path, rows):
    df = src.read_text_csv(spark, put(tmp_path / "c.csv", "id,Account,ACCOUNT\n1,x,y\n"))
    assert df.columns == ["id", "Account", "ACCOUNT_2"] and rows(df) == [("1", "x", "y")]


def test_separator_of_the_whole_file(spark, tmp_path, rows):
    path = put(tmp_path / "s.csv", "a;b;c\n1;2;3\n4;5,6;7\n")
    assert src.read_text_csv(spark, path, sep="auto").columns == ["a", "b", "c"]


def test_one_header_job_for_all_files(spark, tmp_path):
    for i in range(40):
        put(tmp_path / f"f{i}.csv", f"a,b\n{i},x\n")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert src.read_text_csv(spark, f"{tmp_path}/*.csv").columns == ["a", "b"]
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)) < 10


def test_inventory(spark, tmp_path, rows):
    put(tmp_path / "d 1/a.csv", "x\n1\n")
    put(tmp_path / "d 1/b.CSV", "x\n1\n")
    put(tmp_path / "e/c.csv.gz", "x\n1\n")
    inv = inventory.file_inventory(spark, str(tmp_path))
    assert rows(inv.select("directory", "name")) == [("d 1", "a.csv"), ("e", "c.csv.gz")]
    assert "content" not in inv.columns and inv.filter("size > 0").count() == 2
    open(tmp_path / "e/zero.csv", "w").close()
    bad = inventory.require_nonempty(inventory.file_inventory(spark, str(tmp_path), empty_files=True)).filter("NOT ok").collect()
    assert [r["name"] for r in bad] == ["zero.csv"]
    with pytest.warns(UserWarning, match="nothing matches"):
        found = inventory.expand_paths(spark, [f"{tmp_path}/d 1/*", f"{tmp_path}/*/*.csv", f"{tmp_path}/none/*"])
        assert [r[0].rsplit("/", 1)[1] for r in found.collect()] == ["a.csv", "b.CSV", "zero.csv"]


def test_change_log_forms(spark, tmp_path, rows):
    nested = {"k1": {"a": {"column": "a", "previous_value": "1", "current_value": "2"}}, "k2": {}}
    path = put(tmp_path / "log.json", json.dumps(nested, indent=2))
    expected = [("k1", "a", "1", "2")]
    assert rows(documents.read_change_log(spark, path, lines=False)) == expected
    cells = documents.read_change_log(spark, path, lines=False)
    from feedops.operators.diff import change_documents

    sinks.write_change_log(change_documents(cells), str(tmp_path / "lines"))
    assert rows(documents.read_change_log(spark, str(tmp_path / "lines"))) == expected


def test_meta_json_array(spark, tmp_path):
    meta = [{"filename": "a", "rowCount": 2, "columns": [{"name": "x", "dataType": "text"}]}, {"filename": "b"}]
    df = documents.read_meta_json(spark, put(tmp_path / "m.json", json.dumps(meta)))
    assert {r["filename"]: r["rowCount"] for r in df.collect()} == {"a": 2, "b": None}


def test_staging(spark, rows):
    df = spark.createDataFrame([(1, "x")], "a int, `b c` string")
    name = staging.stage(df, "/in/My file-01.csv.gz")
    assert name.startswith("temp_My_file_01_csv_") and len(name.rsplit("_", 1)[1]) == 8
    assert spark.table(name).dtypes == [("a", "string"), ("b c", "string")]
    assert (name.lower(), True) in rows(staging.staged_tables(spark))
    assert rows(staging.preview(spark, name)) == [("1", "x")]


def test_round_trips(spark, tmp_path, rows):
    df = spark.createDataFrame([("a,b", 'q"q', ""), (None, "é", "x")], "x string, `y z` string, w string")
    for gz in (False, True):
        sinks.write_csv(df, f"{tmp_path}/csv{gz}", gzip=gz)
        assert rows(src.read_text_csv(spark, f"{tmp_path}/csv{gz}")) == rows(df)
    sinks.write_json(df, f"{tmp_path}/json")
    assert rows(spark.read.schema(df.schema).json(f"{tmp_path}/json")) == rows(df)
    records = spark.createDataFrame([("BBG01", {"a": None}), ("BBG12", {"b": "1"})], "id string, data map<string,string>")
    sinks.write_records(records, f"{tmp_path}/rec", prefix_len=1, skip=3)
    back = spark.read.option("basePath", f"{tmp_path}/rec").parquet(f"{tmp_path}/rec/prefix=1")
    assert [r["id"] for r in back.collect()] == ["BBG12"]


def test_ingest(spark, tmp_path, rows):
    schema = "id string, x string"
    put(tmp_path / "in/a.csv", "id,x\n1,a\n")
    put(tmp_path / "in/b.csv", "id,x\n2,b\n")
    run = lambda **k: ingest_incremental(
        spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", fmt="csv", options={"header": "true"}, **k)
    assert run() == 2
    assert run() == 0
    put(tmp_path / "in/c.csv", "id,x\n3,c\n")
    assert run() == 1
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("id", "x", "_file")) == [
        ("1", "a", "a.csv"), ("2", "b", "b.csv"), ("3", "c", "c.csv")]
    ingest_incremental(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out2", f"{tmp_path}/state2", fmt="csv",
                       options={"header": "true"}, skip_first=2)
    assert rows(spark.read.parquet(f"{tmp_path}/out2").select("id")) == [("3",)]


def test_root_forms(spark, tmp_path, rows):
    put(tmp_path / "feeds/EQ/a_20240101.csv", "x\n1\n")
    for root in (f"{tmp_path}/feeds", f"{tmp_path}/feeds/", f"file:{tmp_path}/feeds", f"file://{tmp_path}/feeds"):
        inv = inventory.file_inventory(spark, root)
        assert rows(inv.select("directory", "name")) == [("EQ", "a_20240101.csv")], root
    assert rows(src.read_feed(spark, inv).select("x", "_source_date")) == [("1", "20240101")]


def test_parquet_files_stay_bounded(spark, tmp_path):
    """A number of files is kept for a table that fits them; a larger one gets more, as even, and no row less."""
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 5 != 0, F.repeat(F.lit("é"), 50)).alias("t.x"), F.array(F.lit(1.5), F.lit(None)).alias("a"),
        F.create_map(F.lit("k"), F.col("id")).alias("m"), F.struct("id").alias("s"), F.lit(None).cast("binary").alias("b"),
    )
    for name, files, most, expected in (("few", 4, 1 << 28, 4), ("more", 4, 40_000, range(10, 30)), ("empty", 2, 1, 1)):
        sinks.write_parquet(df.filter("id < 0") if name == "empty" else df, str(tmp_path / name), files, file_bytes=most)
        sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / name)).groupBy(F.input_file_name()).count().collect()]
        parts = [p for p in os.listdir(tmp_path / name) if p.startswith("part-")]
        if name == "empty":
            assert parts and not sizes
            continue
        assert len(parts) in (expected if isinstance(expected, range) else [expected])
        assert sum(sizes) == 4000 and max(sizes) <= 1.2 * 4000 / len(parts) and min(sizes) >= 0.8 * 4000 / len(parts)
