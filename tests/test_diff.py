import random

import pytest

from feedops.operators import diff as op

SCHEMA = "id string, a string, b string, ROWNUMBER string"


@pytest.fixture
def pair(spark):
    prev = spark.createDataFrame(
        [("1", "x", "1", "1"), ("2", "x", None, "2"), ("3", "x", "3", "3"), ("4", "x", "4", "4"), ("4", "y", "4", "5"),
         ("", "q", "q", "6"), (None, "q", "q", "7"), ("6", "s", "", "8")], SCHEMA)
    curr = spark.createDataFrame(
        [("1", "x", "1", "9"), ("2", "z", "2", "8"), ("4", "y", "5", "7"), ("5", "n", "n", "1"), ("5", "m", "n", "2"),
         ("6", "s", "t", "3")], SCHEMA)
    return prev, curr


ORDER = ["ROWNUMBER"]


def test_classify(pair, rows):
    got = dict(rows(op.classify(*pair, "id", ORDER)))
    # 4: the last row of the key counts on each side
    assert got == {"1": "unchanged", "2": "modified", "3": "deleted", "4": "modified", "5": "new", "6": "modified"}
    assert dict(rows(op.classify(*pair, "id", ORDER, columns=["a"])))["4"] == "unchanged"
    assert dict(rows(op.classify(*pair, "id", ORDER, ignore=["b"])))["6"] == "unchanged"


def test_cells_null_policies(pair, rows):
    tolerant = rows(op.cell_changes(*pair, "id", ORDER))
    assert tolerant == [("2", "a", "x", "z"), ("4", "b", "4", "5"), ("6", "b", "", "t")]
    strict = rows(op.cell_changes(*pair, "id", ORDER, nulls="strict"))
    assert strict == sorted([*tolerant, ("2", "b", None, "2")], key=str)
    with pytest.raises(ValueError, match="null policy"):
        op.cell_changes(*pair, "id", ORDER, nulls="other")


def test_documents_and_annotation(pair, rows):
    cells = op.cell_changes(*pair, "id", ORDER)
    docs = dict(rows(op.change_documents(cells)))
    assert docs["4"] == '{"b":{"column":"b","previous_value":"4","current_value":"5"}}'
    delta = op.delta_rows(*pair, "id", ORDER)
    assert rows(delta.select("id", "a", "b")) == [("2", "z", "2"), ("4", "y", "5"), ("5", "m", "n"), ("6", "s", "t")]
    noted = {r["id"]: r for r in op.annotate_changes(delta, cells, "id").collect()}
    assert noted["2"]["a"] == ("z", "Previous: x", True) and noted["2"]["b"] == ("2", None, False)
    assert noted["5"]["a"] == ("m", None, False)


@pytest.mark.parametrize("nulls", ["ignore", "strict"])
def test_annotation_from_one_join(pair, rows, nulls):
    cells, delta = op.cell_changes(*pair, "id", ORDER, nulls=nulls), op.delta_rows(*pair, "id", ORDER, nulls=nulls)
    one = op.annotated_delta(*pair, "id", ORDER, nulls=nulls)
    assert rows(one) == rows(op.annotate_changes(delta, cells, "id").select(one.columns)) and len(one.columns) > 1
    same = op.annotated_delta(pair[0], pair[0], "id", ORDER)
    assert same.columns == ["id"] and same.collect() == []


def test_stats(pair):
    got = op.diff_stats(*pair, "id", ORDER).collect()[0].asDict()
    assert got == {
        "current_row_count": 5, "delta_row_count": 4, "new_records": 1, "changed_records": 3, "removed_records": 1,
        "changed_columns": ["a", "b"],
    }
    prev, _ = pair
    same = op.diff_stats(prev, prev, "id", ORDER).collect()[0]
    assert (same["delta_row_count"], same["changed_columns"]) == (0, [])


def test_split(pair, rows):
    parts = op.split_changes(*pair, "id", ORDER)
    assert [r[0] for r in rows(parts["new"])] == ["5"] and parts["new"].columns == pair[1].columns
    assert rows(parts["deleted"]) == [("3", "x", "3", "3")]
    assert [r[0] for r in rows(parts["modified"])] == ["2", "4", "6"]
    keys = op.split_changes(*pair, "id", ORDER, keys_only=True)
    assert keys["modified"].columns == ["id"] and [r[0] for r in rows(keys["modified"])] == ["2", "4", "6"]


def test_headers(spark, pair, rows):
    prev, curr = pair
    wider = curr.withColumn("c", curr["a"])
    assert rows(op.cell_changes(prev, wider, "id", ORDER)) == rows(op.cell_changes(prev, curr, "id", ORDER))
    deleted = op.split_changes(prev.withColumn("old", prev["a"]), curr, "id", ORDER)["deleted"]
    assert rows(deleted.select("id", "old")) == [("3", "x")]
    with pytest.raises(ValueError, match="headers differ"):
        op.classify(prev, wider, "id", ORDER, require_same_header=True)
    with pytest.raises(ValueError, match="no key column"):
        op.classify(prev, curr, "nope")


def test_mixed_types_compare_as_text(spark, rows):
    prev = spark.createDataFrame([(1, 1.5), (2, 2.0)], "id int, v double")
    curr = spark.createDataFrame([("1", "1.5"), ("2", "2")], "id string, v string")
    assert rows(op.cell_changes(prev, curr, "id")) == [("2", "v", "2.0", "2")]


def test_match_ids(spark, rows):
    data = spark.createDataFrame(
        [("r1", "A", "Z"), ("r2", "B", "A"), ("r3", None, "C"), ("r4", None, "C")], "row string, ID_BB_GLOBAL string, ID_BB_UNIQUE string")
    keys = spark.createDataFrame([("A",), ("C",), ("Q",)], "key string")
    got = rows(op.match_ids(data, keys, "row"))
    assert got == [("A", "r1", "ID_BB_GLOBAL"), ("C", "r3", "ID_BB_UNIQUE"), ("C", "r4", "ID_BB_UNIQUE")]


@pytest.mark.parametrize("room", [64_000_000, 0])
def test_match_ids_shuffles_wanted_rows_only(spark, rows, plan, monkeypatch, room):
    monkeypatch.setattr(op, "SOUGHT_BYTES", room)
    data = spark.range(2000).selectExpr("id AS row", "CAST(id % 50 AS string) AS a", "CAST(id AS string) AS b", "CAST(NULL AS string) AS c")
    keys = spark.createDataFrame([("7",), ("1999",), ("1999",), (None,), ("none",)], "key string")
    found = op.match_ids(data, keys, "row", ["c", "a", "missing", "b"])
    assert rows(found) == sorted([("7", i, "a") for i in range(7, 2000, 50)] + [("1999", 1999, "b")], key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert (plan(found).count("BroadcastHashJoin") >= 3) or room == 0
    assert op.match_ids(data, keys, "row", ["missing"]).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, rows, seed):
    """Random snapshots in which one key holds a third of the rows."""
    rng = random.Random(seed)
    def snapshot():
        out = []
        for i in range(600):
            key = "hot" if i % 3 == 0 else f"k{rng.randrange(150)}"
            out.append((key, rng.choice(["x", "y", None]), rng.choice(["1", "2", ""]), f"{i:05d}"))
        return out

    old, new = snapshot(), snapshot()
    schema = "id string, a string, b string, ROWNUMBER string"
    prev, curr = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    p, c = {r[0]: r for r in old}, {r[0]: r for r in new}
    expected = []
    for k in p.keys() & c.keys():
        for name, i in (("a", 1), ("b", 2)):
            if p[k][i] != c[k][i]:
                expected.append((k, name, p[k][i], c[k][i]))
    order = lambda r: tuple((v is not None, str(v)) for v in r)
    assert rows(op.cell_changes(prev, curr, "id", ORDER, nulls="strict")) == sorted(expected, key=order)
    tolerant = [e for e in expected if None not in e]
    assert rows(op.cell_changes(prev, curr, "id", ORDER)) == sorted(tolerant, key=order)
    stats = op.diff_stats(prev, curr, "id", ORDER).collect()[0]
    assert stats["new_records"] == len(c.keys() - p.keys()) and stats["removed_records"] == len(p.keys() - c.keys())
    assert stats["changed_records"] == len({e[0] for e in tolerant}) and stats["current_row_count"] == len(c)


def test_plan(pair, plan):
    text = plan(op.diff_stats(*pair, "id", ORDER))
    assert text.count("WindowGroupLimit Partial") + text.count("Partial)") >= 2 or "WindowGroupLimit" in text
    # one shuffle per side, and the final single-row aggregate
    assert text.count("hashpartitioning") == 2 and "CartesianProduct" not in text


def test_fingerprint_tells_cells_apart(spark):
    from feedops.functions.fingerprints import fingerprint

    cells = [("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("", "ab"), ("a", "1:b"), ("a1:", "b"), (None, None), ("-", "-"), ("", "")]
    df = spark.createDataFrame(cells, "x string, y string")
    assert df.select(fingerprint(["y", "x"]).alias("f")).distinct().count() == len(cells)
    assert df.select((fingerprint(["y", "x"]) == fingerprint(["x", "y"])).alias("f")).distinct().collect()[0][0] is True


def test_repeated_keys_count_once_by_default(spark):
    prev = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "id string, v int")
    curr = spark.createDataFrame([("a", 9), ("a", 1), ("a", 4), ("a", 4)], "id string, v int")
    stats = op.diff_stats(prev, curr, "id").first()
    assert (stats["current_row_count"], stats["changed_records"], stats["new_records"], stats["removed_records"]) == (1, 1, 0, 0)
    cells = op.cell_changes(prev, curr, "id")
    assert [tuple(r) for r in cells.collect()] == [("a", "v", "3", "9")]
    assert op.change_documents(cells).count() == 1
    assert [tuple(r) for r in op.classify(prev, curr, "id").collect()] == [("a", "modified")]
    assert [tuple(r) for r in op.delta_rows(prev, curr, "id").collect()] == [("a", 9)]


def test_by_print(spark, rows, plan):
    """A repeated key counts by its largest fingerprint; wide rows stay where they are."""
    old = [("a", "1", "x"), ("a", "2", "y"), ("b", "1", None), ("c", "1", "x"), ("", "1", "x"), (None, "1", "x")]
    new = [("a", "2", "y"), ("a", "1", "x"), ("a", "1", "x"), ("b", "1", ""), ("d", "1", "x")]
    prev, curr = (spark.createDataFrame(r, "id string, a string, b string") for r in (old, new))
    found = op.classify(prev, curr, "id", op.BY_PRINT)
    assert rows(found) == [("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "new")]
    text = plan(found)
    moved = [part.split("Input")[1].split("\n")[0] for part in text.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert moved and all(" a#" not in m and " b#" not in m for m in moved)
    cells = rows(op.cell_changes(prev, curr, "id", op.BY_PRINT, nulls="strict"))
    assert cells == [("b", "b", None, "")]
