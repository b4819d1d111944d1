import numpy as np
import pytest
from helpers import groups, plain_fingerprint

from feedops.llm import common, simhash


def test_fingerprints_of_odd_texts():
    for text in ("", None, " \n\t ", "One", "one two", "A b C d", "a b c d e f a b c d", "é È ü", "x " * 5000, " ".join(map(str, range(70_000))), "a b c d e", "a\x0bb\x0cc d e"):
        raw = text.encode() if text is not None else None
        assert simhash.fingerprint(raw) == plain_fingerprint(text), text


def test_every_pair_within_reach_shares_a_posting():
    rng = np.random.default_rng(3)
    for most in (3, 4, 5):
        for width in range(1, 8 - most + 1):
            masks = simhash.posting_masks(most, width)
            for _ in range(400):
                a = int(rng.integers(0, 1 << 63))
                b = a
                for bit in rng.choice(64, rng.integers(0, most + 1), replace=False).tolist():
                    b ^= 1 << bit
                assert any(a & m == b & m for m in masks)
    with pytest.raises(ValueError):
        simhash.posting_masks(4, 5)


def test_postings_take_more_positions_for_more_fingerprints():
    assert [simhash.posting_width(n, 4) for n in (0, 1 << 25, (1 << 25) + 1, 1 << 33, 1 << 60)] == [3, 3, 4, 4, 4]
    assert simhash.posting_width(1 << 40, 5) == 3 and simhash.posting_width(1, 6) == 2


def components_of(spark, values, most=4, width=3):
    rows = [(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)]
    links = simhash.links(spark.createDataFrame(rows, "fp long, doc long"), most, width)
    found = {r.node: r.root for r in common.components(links).collect()}
    return [found.get(i, i) for i in range(len(values))]


def plain_components(values, most=4):
    v = np.array(values, np.uint64)
    linked = [(i, int(j) + i + 1) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= most)]
    return groups(len(v), linked)


def test_links_equal_brute_force_with_hot_postings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = [int(x) for x in rng.integers(0, 1 << 63, 120)]
    chain = values[:6]
    for _ in range(12):
        chain = [v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for v in chain]
        values += chain
    center = values[0]
    values += [center ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)]
    values = sorted(set(values), key=values.index)
    want = plain_components(values)
    assert components_of(spark, values) == components_of(spark, values, width=4) == want
    monkeypatch.setattr(common.split_hot, "__defaults__", (8,))
    assert components_of(spark, values) == want


def test_near_copies_of_whole_table(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(documents).collect()}
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in documents.select("doc_id", "text").collect())
    want = plain_components([fp for _, fp in rows])
    assert got == {d: (format(fp, "016x"), rows[k][0]) for (d, fp), k in zip(rows, want)}


def test_odd_rows(spark):
    schema = "doc_id long, text string, fingerprint string"
    rows = [(3, None, "a"), (5, "", "b"), (9, " ", None), (7, "same text here for all", "c"), (7, "same text here for all", "c"), (None, "same text here for all", "d")]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_copies(spark.createDataFrame(rows, schema)).collect())
    same = format(plain_fingerprint(rows[3][1]), "016x")
    assert got == sorted([("3", "0" * 16, 3), ("5", "0" * 16, 3), ("9", "0" * 16, 3), ("7", same, 7), ("7", same, 7), ("None", same, None)])
    assert simhash.near_copies(spark.createDataFrame([], schema)).collect() == []
    stay = simhash.keep_first(spark.createDataFrame(rows, schema))
    assert stay.columns == ["doc_id", "text", "fingerprint"]
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["3", "7", "None"]


def test_components_of_a_long_path(spark):
    path = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")
    assert {r.root for r in common.components(path).collect()} == {0}
    zigzag = spark.createDataFrame([(i * 7 % 41, (i + 1) * 7 % 41) for i in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in common.components(zigzag).collect()} == {(i, 0) for i in range(41)}
    assert common.components(path.limit(0)).collect() == []
