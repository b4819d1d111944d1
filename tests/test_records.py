"""Records and cells by quote state, held against Spark's own reader and a plain state machine."""

import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedops.session import durable
from feedops.sources import csv as src
from feedops.sources import inventory
from feedops.sources.records import cells, lines, records, split_record


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def plain_records(text, sep=",", quote='"'):
    """Records of a text, one character after the other."""
    out, own, state = [], "", "start"
    for k, c in enumerate(text):
        if c == "\n" and state != "inside":
            out.append(own)
            own, state = "", "start"
            continue
        own += c
        if state == "inside":
            if c == quote:
                state = "closing"
        elif state == "closing" and c == quote:
            state = "inside"
        elif c == sep:
            state = "start"
        elif state == "start" and c == quote:
            state = "inside"
        else:
            state = "plain"
    out.append(own)
    return [r.removesuffix("\r") for r in out if r.strip()]


@pytest.mark.parametrize("size", ["64b", "128m"])
def test_records_across_splits(spark, tmp_path, size):
    rng = random.Random(5)
    texts = {}
    for name in ("a", "b", "c"):
        rows = []
        for i in range(60):
            row = [rng.choice(['5" pipe', "", "x", '"a ""b"""', '"one\ntwo"', '"one\n\n"', '"a,b\r\nc"', '"late"x', '"l\n"x,"y\n"', "é"]) for _ in range(3)]
            rows.append(",".join([str(i), *row]))
        texts[name] = "\n".join(rows) + rng.choice(["", "\n", "\r\n", "\n \n"])
        put(tmp_path / f"{name}.csv", texts[name])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = records(spark, [f"{tmp_path}/*.csv"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        own = sorted((tuple(r["at"]), r["line"]) for r in got if r["path"].endswith(f"/{name}.csv"))
        assert [line for _, line in own] == plain_records(text), name


def test_open_quote_takes_the_rest_of_its_file_only(spark, tmp_path):
    put(tmp_path / "a.csv", 'id,a\n1,"open\n2,x\n')
    put(tmp_path / "b.csv", "id,a\n3,y\n")
    assert sorted(r["line"] for r in records(spark, [f"{tmp_path}/*.csv"]).collect()) == ['1,"open\n2,x\n'.rstrip("\n"), "3,y", "id,a", "id,a"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text('a",\' ;', min_size=1, max_size=14).filter(str.strip), min_size=1, max_size=12))
def test_widths_are_those_of_sparks_reader(spark, tmp_path_factory, texts):
    path = put(tmp_path_factory.mktemp("w") / "w.csv", "\n".join(["h", *texts]) + "\n")
    names = ", ".join(f"c{i} string" for i in range(20))
    read = spark.read.schema(names).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "\x00").csv(path)
    wide = [max([i + 1 for i, v in enumerate(r) if v is not None], default=0) for r in read.collect()]
    counted = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(cells(F.col("t")))).collect()]
    assert len(wide) == len(counted)
    assert all(w <= c for w, c in zip(wide, counted)), (texts, wide, counted)
    assert [len(split_record(t)) for t in texts] == counted


def test_no_cell_is_lost(spark, tmp_path, rows):
    inch = put(tmp_path / "inch.csv", 'id,a,b\n1,5" pipe,6" pipe,LOST\n')
    assert rows(src.read_text_csv(spark, inch)) == [("1", '5" pipe', '6" pipe', "LOST")]
    assert tuple(src.misfits(spark, inch).collect()[0])[1:] == (1, 0, 1)
    spans = put(tmp_path / "spans.csv", 'id,a\n1,"x\ny"\n2,z,EXTRA\n3,""\n4,\n')
    df = src.read_text_csv(spark, spans, multi_line=True)
    assert df.columns == ["id", "a", "column_3"]
    assert rows(df) == [("1", "x\ny", None), ("2", "z", "EXTRA"), ("3", "", None), ("4", None, None)]
    assert tuple(src.misfits(spark, spans, multi_line=True).collect()[0])[1:] == (4, 0, 1)
    assert [tuple(r)[2:] for r in src.quarantine(spark, spans, multi_line=True).collect()] == [(3, 2, "2,z,EXTRA")]
    feed = src.read_feed(spark, spans, row_order=True, multi_line=True).orderBy("_row")
    assert [r["id"] for r in feed.collect()] == ["1", "2", "3", "4"]


def test_long_cells(spark, tmp_path):
    long = 'x""' * 200_000
    path = put(tmp_path / "long.csv", f'id,a\n1,"{long}\n{long}",2\n')
    row = src.read_text_csv(spark, path, multi_line=True).collect()[0]
    assert row["id"] == "1" and row["a"] == (long + "\n" + long).replace('""', '"') and row["column_3"] == "2"


@pytest.mark.parametrize("sep", [";", "\t", "|", ","])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_sniffed_separator_and_quote(spark, tmp_path, rows, sep, quote):
    cell = f"{quote}x{sep}y{quote}"
    body = "".join(f"{i}{sep}{cell if i % 3 else 'it is, well; 5'}{sep}z\n".replace("it is, well; 5", "plain") for i in range(9))
    path = put(tmp_path / "s.csv", f"a{sep}b{sep}c\n{body}")
    got = src.read_text_csv(spark, path, sep="auto", quote="auto")
    assert got.columns == ["a", "b", "c"]
    assert {r["b"] for r in got.collect()} == {"plain", f"x{sep}y"}


def test_require_rows(spark, tmp_path):
    for name, text in {"full": "a,b\n1,2\n3,4\n", "head": "a,b\n", "blank": " \n\n", "none": ""}.items():
        put(tmp_path / f"{name}.csv", text)
    found = src.require_rows(spark, inventory.file_inventory(spark, str(tmp_path)))
    got = {r["name"]: (r["ok"], r["row_count"], (r["error"] or "").rpartition(" in ")[0]) for r in found.collect()}
    assert got == {
        "full.csv": (True, 2, ""), "head.csv": (False, 0, "no rows"), "blank.csv": (False, 0, "no header line"), "none.csv": (False, 0, "no bytes"),
    }
    only = inventory.file_inventory(spark, str(tmp_path)).filter("name = 'none.csv'")
    assert [(r["ok"], r["row_count"]) for r in src.require_rows(spark, only).collect()] == [(False, 0)]


def test_misfits_move_counts_and_not_rows(spark, tmp_path, plan):
    """Rows joined to the header of their file would go to one task per file, which no join of that kind can split."""
    put(tmp_path / "in/a.csv", "\n \n1,2\n" + "3,4\n" * 300 + "5,6,7\n" * 5 + "8\n" * 2)
    put(tmp_path / "in/b.csv", "1\n2,3\n")
    put(tmp_path / "in/blank.csv", "\n \n")
    for size in ("64b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = src.misfits(spark, f"{tmp_path}/in/*.csv")
            text = plan(found)
            got = {r["path"].rpartition("/")[2]: (r["rows"], r["short_rows"], r["long_rows"]) for r in found.collect()}
            cut = Counter((r["path"].rpartition("/")[2], r["cells"], r["width"], r["line"]) for r in src.quarantine(spark, f"{tmp_path}/in/*.csv").collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == {"a.csv": (307, 2, 5), "b.csv": (1, 0, 1)}
        assert cut == {("a.csv", 3, 2, "5,6,7"): 5, ("a.csv", 1, 2, "8"): 2, ("b.csv", 2, 1, "2,3"): 1}
        assert "Join" not in text and text.split("\n\n")[0].count("Scan text") == 1
        before = text.split("\n\n")[0].rpartition("Exchange")[2]
        assert "HashAggregate" in before and "Sort" not in before


@pytest.mark.parametrize("size", ["64b", "128m"])
def test_first_lines_are_found_without_sorting_all_lines(spark, tmp_path, plan, size):
    put(tmp_path / "in/a.csv", "\n \nx,y\n" + "3,4\n" * 300 + "5,6,7\n" + "8\n" * 2)
    put(tmp_path / "in/b.csv", "y,x\n2,3\n")
    put(tmp_path / "in/blank.csv", "\n \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = lines(spark, [f"{tmp_path}/in/*.csv"])
        for found in (src._head_facts(read, [(",", '"')]), src._first_rows(read)):
            before = plan(found).split("\n\n")[0].rpartition("Exchange")[2]
            assert "Aggregate" in before and "Sort" not in before
        kept = durable(read)
        firsts = src._first_rows(kept).join(kept, F.col("first") == F.col("at")).collect()
        heads = {tuple(names): [p.rpartition("/")[2] for p in files] for (names, *_), files in src.headers_by_path(spark, [f"{tmp_path}/in/*.csv"]).items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert heads == {("x", "y", "column_3"): ["a.csv"], ("y", "x"): ["b.csv"]}
    assert sorted(r["line"] for r in firsts) == ["x,y", "y,x"]
