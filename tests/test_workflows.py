import gzip

import pytest

from feedops.operators import profile, workflows
from feedops.operators.discovery import latest_per_dir


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "EQUITY_A/a.20240101.csv.gz", "ID,price,FILEDATE\nBBG1,1,x\nBBG2,2,x\nBBG3,3,x\n")
    put(tmp_path / "EQUITY_A/a.20240102.csv.gz", "ID,price,FILEDATE\nBBG1,9,y\nBBG1,10,y\nBBG2,2,y\nBBG4,,y\n")
    put(tmp_path / "equity_b/b.20240201.csv.gz", "ID,name,price\nBBG1,one,77\nBBG9,nine,n.a.\n")
    put(tmp_path / "bonds/c.20240301.csv.gz", "ID,rate\nBBG1,5\n")
    return str(tmp_path)


def test_compare_latest(spark, root, rows):
    got = workflows.compare_latest(spark, f"{root}/EQUITY_A", "ID", order=["price"], nulls="strict")
    # the larger text is the later row here: 9 after 10
    assert rows(got["cells"]) == [("BBG1", "price", "1", "9")]
    assert rows(got["delta"].select("ID")) == [("BBG1",), ("BBG4",)]
    assert got["stats"].collect()[0]["removed_records"] == 1
    with pytest.raises(ValueError, match="two files"):
        workflows.compare_latest(spark, f"{root}/bonds", "ID")


def test_load_latest(spark, root, rows):
    target = spark.createDataFrame([("BBG1", {"rate": "1", "name": "old"})], "id string, data map<string,string>")
    got = workflows.load_latest(spark, root, target, "id", exclude="bonds")
    records = {r["id"]: r["data"] for r in got["records"].collect()}
    assert records["BBG1"] == {"rate": "1", "name": "one", "price": "77"}
    assert records["BBG9"] == {"name": "nine", "price": None} and set(records) == {"BBG1", "BBG2", "BBG4", "BBG9"}
    runs = {r["file_path"].rsplit("/", 1)[1]: r["rows_processed"] for r in got["runs"].collect()}
    assert runs == {"a.20240102.csv.gz": 4, "b.20240201.csv.gz": 2}
    assert tuple(got["keys"].collect()[0]) == ("BBG1", 3, "a.20240102.csv.gz,b.20240201.csv.gz")


def test_merge_latest(spark, root, rows):
    merged = workflows.merge_latest(spark, root, "equity", "ID")
    # price comes only from the newest file that has it; of equal keys the last line of a file counts
    assert rows(merged.select("ID", "name", "price", "_source_date", "FILEDATE")) == [
        ("BBG1", "one", "77", "20240201", "y"), ("BBG2", None, None, None, "y"), ("BBG4", None, None, None, "y"),
        ("BBG9", "nine", "n.a.", "20240201", None)]


@pytest.mark.parametrize("keep", [False, True])
def test_merge_latest_reads_one_file_per_header(spark, tmp_path, rows, plan, keep):
    for i in range(6):
        folder = tmp_path / f"feed {i}"
        folder.mkdir()
        head = "ID,a,b" if i % 2 else "ID,c"
        (folder / f"x_2024010{i + 1}.csv").write_text(f"{head}\nk{i},1{i},2{i}\nsame,3{i},4{i}\n" if i % 2 else f"{head}\nk{i},1{i}\nsame,3{i}\n")
    merged = workflows.merge_latest(spark, str(tmp_path), "feed", "ID", keep_all_keys=keep)
    found = rows(merged.select("ID", "a", "b", "c"))
    want = [("k4", None, None, "14"), ("k5", "15", "25", None), ("same", "35", "45", "34")]
    assert found == sorted([*want, *[(f"k{i}", None, None, None) for i in range(4)]] if keep else want)
    assert plan(merged).split("\n\n")[0].count("Scan csv") == (4 if keep else 2)


def test_entities(spark, root, rows):
    inv = latest_per_dir(workflows.feeds_under(spark, root))
    meta = profile.extract_metadata(spark, root)
    got = workflows.entities_from(spark, inv, meta, "ID")
    state = {r["ID"]: r for r in got["state"].collect()}
    assert (state["BBG1"]["price"], state["BBG1"]["name"], state["BBG1"]["rate"]) == ("77", "one", "5")
    history = rows(got["history"].filter("property = 'price'").select("id", "effective_date", "value"))
    assert history == [("BBG1", "20240102", "10"), ("BBG1", "20240201", "77"), ("BBG2", "20240102", "2")]


def test_last_row_of_a_file_wins(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "f_20240101.csv").write_text("id,v\na,9\na,1\n")
    (folder / "f_20240102.csv").write_text("id,v\na,8\na,2\n")
    out = workflows.compare_latest(spark, str(folder), "id")
    assert [tuple(r) for r in out["cells"].collect()] == [("a", "v", "1", "2")]
    assert [tuple(r) for r in out["delta"].collect()] == [("a", "2")] and out["delta"].columns == ["id", "v"]


def test_rows_of_many_batches_are_counted(spark, tmp_path):
    from feedops.streaming.ingest import ingest_incremental

    source = str(tmp_path / "src")
    spark.range(105).repartition(105).write.parquet(source)
    args = (spark, source, "id long", str(tmp_path / "sink"), str(tmp_path / "state"))
    assert ingest_incremental(*args, options={"maxFilesPerTrigger": "1"}) == 105
    assert ingest_incremental(*args) == 0
