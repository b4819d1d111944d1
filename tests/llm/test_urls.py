import pytest

from feedops.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def judge(spark, addresses, rules=RULES, **more):
    rows = [(i, u, "extra") for i, u in enumerate(addresses)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules, **more).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


def test_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "x://y://z.com/fr/": ("y:", "//z.com/fr/", None, "allow"),
        "http://b.com/de/a": ("b.com", "/de/a", "com/de/", "block"),
        "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "http://com/fr/1": ("com", "/fr/1", "com/fr/", "allow"),
        "http://xcom/fr/1": ("xcom", "/fr/1", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://q.org": ("q.org", "", None, "allow"),
        "http://q.org?a/b": ("q.org", "", None, "allow"),
        "HTTP://Ü.org/x\ny": ("Ü.org", "/x\ny", "org/", "allow"),
        "no scheme.org/": ("", "", None, "allow"),
    }
    got = judge(spark, list(cases))
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert judge(spark, [None, ""]) == {0: ("", "", None, "allow"), 1: ("", "", None, "allow")}
    assert judge(spark, []) == {}


def test_bad_hosts_are_blocked_and_shrink_to_their_domain(spark):
    bad = [f"http://spam.bad.com/de/{i}" for i in range(40)] + [f"http://more.bad.com/de/{i}" for i in range(40)]
    good = [f"http://fine.net/x/{i}" for i in range(60)]
    seen = ["http://spam.bad.com/en/1", "http://new.bad.com/en/1", "http://fine.net/en/1"]
    got = judge(spark, bad + good + seen, [("com/de/", "block"), ("fine.net/x/", "allow")])
    assert [got[140 + k][3] for k in range(3)] == ["block", "block", "allow"]


def test_further_outcomes_count(spark):
    outcomes = spark.createDataFrame([("http://odd.net/1", 1)] * 50 + [("http://ok.net/1", 0)] * 50 + [(None, 1), ("http://ok.net/2", None)], "url string, bad int")
    got = judge(spark, ["http://odd.net/9", "http://ok.net/9"], [], outcomes=outcomes)
    assert [got[k][3] for k in (0, 1)] == ["block", "allow"]


def test_strength_of_known_spread(spark):
    # units of 100 outcomes with shares 0.2 and 0.4 around 0.3: r = (100 - 21) / (21 * 99)
    units = spark.createDataFrame([(100.0, 20.0, 0.3), (100.0, 40.0, 0.3)] * 5, "n double, k double, parent double")
    r = (100 - 21) / (21 * 99)
    assert urls.strength(units).first()[0] == pytest.approx(1 / r - 1)


def test_main_path_is_native(spark, data, plan):
    from feedops.llm.queries import QUERIES

    text = plan(QUERIES["op3_host_reputation"](spark, data))
    assert "Python" not in text and "Arrow" not in text and "html" not in text
