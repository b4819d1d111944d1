import hashlib

import pytest
from pyspark.sql import functions as F

from feedops.functions import values as v
from feedops.operators.mask import obfuscate


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("o")).collect()]


def test_null_tokens(spark):
    texts = ["", " ", "N.A.", "n.a.", "N/A", "null", "NIL", " none ", None, "0", "na", "x"]
    assert column(spark, texts, v.is_null_token("c")) == [True] * 9 + [False] * 3


@pytest.mark.parametrize(
    "text,declared,expected",
    [
        ("12", "integer", ("12", "integer", True)), ("007", "integer", ("7", "integer", True)),
        ("-3", "integer", ("-3", "integer", True)), ("12.9", "integer", ("12", "integer", True)),
        ("-12.9", "integer", ("-12", "integer", True)), ("1e5", "integer", ("1e5", "text", True)),
        ("A_1", "integer", ("A_1", "text", True)), ("1/2", "integer", (None, "invalid", False)),
        (" 12", "integer", (None, "invalid", False)), ("N.A.", "integer", (None, "null", True)),
        ("99999999999999999999", "integer", (None, "invalid", False)),
        ("12.50", "float", ("12.50", "float", True)), ("1e5", "float", ("1e5", "float", True)),
        ("NaN", "float", ("NaN", "float", True)), ("-inf", "float", ("-inf", "float", True)),
        ("1e999", "float", ("1e999", "text", True)), ("abc", "float", ("abc", "text", True)),
        ("1,5", "float", (None, "invalid", False)), ("12", "text", ("12", "text", True)),
        ("12", "date", ("12", "integer", True)), ("1.5", "date", ("1.5", "float", True)),
        ("2024-01-31", "date", ("2024-01-31", "text", True)), (None, "text", (None, "null", True)),
    ],
)
def test_convert(spark, text, declared, expected):
    got = column(spark, [text], v.convert("c", F.lit(declared)))[0]
    assert tuple(got) == expected


def test_document_typing(spark):
    cases = {
        "12": "number", "007": "number", "037833100": "number", "12.5": "number", "-3": "text", "1e5": "text", "12.": "text",
        "true": "boolean", "FALSE": "boolean", "f": "text", "2024-01-31": "date", "2024-01-31 10:00:00": "timestamp",
        "2024-01-31T10:00:00Z": "timestamp", "2024-13-01": "text", "2024-13-01 10:00:00": "text", "": "null", "n.a.": "null",
        " ": "text",
    }
    got = column(spark, list(cases), v.type_value("c"))
    assert [g["value_type"] for g in got] == list(cases.values())
    assert got[list(cases).index("037833100")]["value"] == "037833100"
    assert got[list(cases).index("FALSE")]["value"] == "false"


def test_inference_tests(spark):
    texts = ["12", "+5", " 12", "1.", ".5", "1e5", "Inf", "nan", "1e999", "0x10", "abc"]
    assert column(spark, texts, v.is_integer("c")) == [True, True] + [False] * 9
    assert column(spark, texts, v.is_number("c")) == [True, True, False, True, True, True, True, True, False, False, False]
    days = ["2024-02-29", "2023-02-29", "2024-1-5", "20240105"]
    assert column(spark, days, v.is_date("c")) == [True, False, False, False]
    moments = ["2024-01-05 10:20:30", "2024-01-05T10:20:30Z", "2024-01-05T10:20:30+02:00", "2024-01-05 10:20:30.25",
               "2024-01-05", "2024-01-05 25:00:00", "2024-01-05T10:20:30"]
    assert column(spark, moments, v.is_timestamp("c")) == [True, True, True, True, False, False, False]


def test_name_dates(spark):
    names = ["a.20240131.csv.gz", "a_20249999.gz", "nodate.csv", "x20240101y20250101.csv", "x1234567.csv", "id123456789.csv"]
    assert column(spark, names, v.name_date_text("c")) == ["20240131", "20249999", None, "20240101", None, "12345678"]
    days = column(spark, names, F.date_format(v.name_date("c"), "yyyyMMdd"))
    assert days == ["20240131", None, None, "20240101", None, None]


def test_clean_cell(spark):
    texts = ["a\x00b\x1fc\td\ne\rf", "", None, "x" * 40000]
    assert column(spark, texts, v.clean_cell("c", most=32000)) == ["abc\td\ne\rf", " ", " ", "x" * 32000]
    assert column(spark, texts[3:], v.clean_cell("c")) == texts[3:]


def test_names(spark):
    names = ["a--b..c.csv.gz", "_x y_.csv", ".hidden", "plain", "é1.csv"]
    assert column(spark, names, v.sanitize_name("c")) == ["a_b_c_csv", "x_y", "hidden", "plain", "1"]
    expected = [f"temp_{safe}_{hashlib.md5(n.encode()).hexdigest()[:8]}" for n, safe in zip(names, ["a_b_c_csv", "x_y", "hidden", "plain", "1"])]
    assert column(spark, names, v.staged_name("c")) == expected
    assert column(spark, ["BBG1"], v.prefix_path("c")) == ["B/B/G/1"]


def test_obfuscate(spark):
    df = spark.createDataFrame([("", 1), ("a", 2), ("ab", 3), ("abc", 4), ("héé!", 5), (None, 6)], "c string, i int")
    get = lambda method, **k: {r["i"]: r["c"] for r in obfuscate(df, ["c"], method, **k).collect()}
    assert get("mask") == {1: "", 2: "a", 3: "ab", 4: "a*c", 5: "h**!", 6: None}
    assert get("hash")[5] == hashlib.sha256("héé!".encode()).hexdigest()
    once, again, other = get("random", seed=1), get("random", seed=1), get("random", seed=2)
    assert once == again and once != other
    assert {i: None if t is None else len(t) for i, t in once.items()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: None}
    assert obfuscate(df, ["c"], "mask", max_rows=2).count() == 2
    with pytest.raises(ValueError, match="no such columns"):
        obfuscate(df, ["c", "zz"])
    with pytest.warns(UserWarning, match="hashing instead"):
        assert obfuscate(df, ["c"], "rot13").count() == 6
