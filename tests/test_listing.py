import fnmatch
import os
import re

import pytest
from pyarrow import fs

from feedops.sources import inventory, listing

FILES = ["a.csv", "d 1/b+c%20.csv", "d 1/x=1/é.csv.gz", "d 1/skip.txt", "_tmp/h.csv", "_k=1/i.csv", ".git/j.csv", "d2/.k.csv", "d2/_l.csv", "d2/zero.csv", "d2/m.csv._COPYING_"]


@pytest.fixture
def tree(tmp_path):
    for i, name in enumerate(FILES):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if "zero" in name else "x\n" * (i + 1))
    (tmp_path / "bare").mkdir()
    return str(tmp_path)


def test_the_same_files_as_the_listing_of_spark(spark, tree, rows):
    for root in (tree, tree + "/", f"file:{tree}", f"file://{tree}", [f"{tree}/d2", f"{tree}/d 1"]):
        want, got = inventory.file_inventory(spark, root), listing.list_files(spark, root)
        # Spark's scans give files of no bytes no time
        assert rows(got.drop("mtime")) == rows(want.drop("mtime")), root
        assert rows(got.filter("size > 0")) == rows(want.filter("size > 0"))
        assert got.schema.simpleString() == want.schema.simpleString()
    assert [r["name"] for r in listing.list_files(spark, tree, recursive=False).collect()] == ["a.csv"]
    assert [r["name"] for r in listing.list_files(spark, tree, suffixes=[".txt"]).collect()] == ["skip.txt"]
    assert len(listing.list_files(spark, tree, suffixes=[]).collect()) == 6


def test_odd_roots(spark, tree, rows):
    assert listing.list_files(spark, f"{tree}/bare").collect() == []
    assert [(r["name"], r["size"]) for r in listing.list_files(spark, f"{tree}/a.csv").collect()] == [("a.csv", 2)]
    assert listing.list_files(spark, [tree, tree]).count() == listing.list_files(spark, tree).count()
    with pytest.raises(Exception, match="FileNotFoundError"):
        listing.list_files(spark, f"{tree}/none")


def test_another_store(spark, rows):
    def in_memory(uri):
        store = fs._MockFileSystem()
        for folder in ("top", "top/d", "top/_x", "top/empty"):
            store.create_dir(folder)
        for name in ("top/a.csv", "top/d/b.csv", "top/_x/c.csv"):
            with store.open_output_stream(name) as out:
                out.write(b"12345")
        return store, uri.partition("mem://")[2]

    found = rows(listing.list_files(spark, "mem://top", opener=in_memory).select("path", "name", "size"))
    assert found == [("mem://top/a.csv", "a.csv", 5), ("mem://top/d/b.csv", "b.csv", 5)]
    assert [r["path"] for r in listing.match_files(spark, ["mem://top/*/?.csv"], in_memory).collect()] == ["mem://top/d/b.csv"]
    assert [r["size"] for r in listing.list_files(spark, "mem://top/a.csv", opener=in_memory).collect()] == [5]


def test_globs(spark, tree, rows):
    for patterns in ([f"{tree}/d*/*.csv"], [f"{tree}/{{d 1,d2}}/*"], [f"{tree}/d?/z[a-f]ro.csv", f"{tree}/*/zero.csv"], [f"{tree}/a.csv"], [f"{tree}/*/*/*.gz"]):
        # a folder that matches is entered there
        want = [r for r in rows(inventory.expand_paths(spark, patterns)) if "/x=1/" not in r[0] or "/*/*/" in patterns[0]]
        assert rows(listing.match_files(spark, patterns).select("path")) == want and want, patterns
    assert listing.match_files(spark, [f"{tree}/none/*.csv", f"{tree}/*.none"]).collect() == []
    assert listing.match_files(spark, []).collect() == []


@pytest.mark.parametrize("glob", ["*", "a*b", "?x", "[ab]c", "[!ab]c", "a.b+c", "x(1)", "[", "a{b", "f[0-9].csv"])
def test_one_level_of_a_glob(glob):
    names = ["a", "ab", "axb", "xx", "ac", "bc", "cc", "a.b+c", "aXb+c", "x(1)", "[", "a{b", "f7.csv", "f77.csv"]
    want = [n for n in names if fnmatch.fnmatchcase(n, glob)]
    assert [n for n in names if re.fullmatch(listing.glob_pattern(glob), n)] == want


def test_no_path_reaches_the_driver(spark, tree, monkeypatch):
    """Neither rows nor lists of files come back while a tree is listed."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("paths on the driver")

    for name in ("collect", "toLocalIterator", "inputFiles", "toPandas"):
        monkeypatch.setattr(DataFrame, name, refused)
    assert listing.list_files(spark, tree).count() == 5


def test_a_folder_that_goes_is_empty(tmp_path):
    task = listing._lister(None, False, False, listing.opened)
    import pyarrow as pa

    gone = pa.record_batch([pa.array([str(tmp_path / "gone")])], names=["path"])
    assert list(task(iter([gone]))) == []
    with pytest.raises(FileNotFoundError):
        list(listing._lister(None, False, True, listing.opened)(iter([gone])))
    for i in range(25):
        open(os.path.join(tmp_path, f"{i}.csv"), "w").close()
    here = pa.record_batch([pa.array([str(tmp_path)])], names=["path"])
    assert sum(b.num_rows for b in task(iter([here]))) == 25
