import hashlib

from helpers import plain_hits

from feedops.llm import decontam

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short ITEM here"), (3, None), (4, "..."), (10, "short item here"), (5, "one")]
TEXTS = [
    "alpha Beta, gamma delta-epsilon zeta eta theta iota KAPPA rest", "x " * 30 + ITEMS[0][1] + " y", "a short item here, and a short item here", None, "", "…",
    "alpha beta gamma", "one one two", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu alpha beta", "ein ÖL und oneé",
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 0)], "doc_id long, text string, n_hit long")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def report(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def plain():
    out = []
    for i, t in [*enumerate(TEXTS), (2, TEXTS[2])]:
        words, hit, items = plain_hits(t, ITEMS)
        out.append((i, len(words), int(hit.sum()), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit.any())))
    return sorted(out)


def test_scan_equals_brute_force(spark):
    docs, items = frames(spark)
    assert report(decontam.scan(docs, items)) == plain()
    assert any(r[2] for r in plain())


def test_slices_of_the_test_set_give_the_same(spark):
    docs, items = frames(spark)
    assert report(decontam.scan(docs, items, slice_bytes=300)) == plain()
    assert len(list(decontam._slices(items, 10, 300))) > 2


def test_clean(spark):
    docs, items = frames(spark)
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in plain() if not r[5])
    cut = {r.doc_id: r.text for r in decontam.clean(docs, items, remove="spans").collect()}
    assert cut[2] == "a \n, and a \n"
    assert cut[3] is None and cut[6] == TEXTS[6]
    assert "theta" not in cut[1] and cut[1].startswith("x x") and cut[1].endswith(" y")


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontam.scan(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in decontam.scan(docs, items.limit(0)).collect())


def test_items_without_an_id_hit_and_count_once(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    other = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, f"{words} {other}"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), (None, other), ("q", other)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.scan(docs, items).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (12, 1, digest(""), True), 2: (24, 2, digest("q"), True), 3: (0, 0, digest(""), False)}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [3]
