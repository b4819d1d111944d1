import random
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedops.llm import toxicity as op

LABELS = "doc_id long, quality int, toxic int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_match(word, entries):
    """Entry and edits by comparing the word with every entry; an open entry with every beginning of it."""
    found = []
    for number, entry in enumerate(entries):
        term = entry.rstrip("*")
        if entry.endswith("*"):
            d = min(edits(term, word[:k]) for k in range(len(word) + 1))
            most = min(1, op.allowed(term))
        else:
            d, most = edits(term, word), op.allowed(term)
        if d <= most:
            found.append((d, entry.endswith("*"), number))
    return min(found, default=None)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.lists(st.text("abc", min_size=3, max_size=11), min_size=1, max_size=6, unique=True), st.integers(0, 3))
def test_automaton_equals_plain_distances(word, terms, open_ones):
    entries = sorted({t + "*" if k < open_ones and len(t) >= op.STEM else t for k, t in enumerate(terms)})
    found, expected = op.Automaton(entries).match(word), plain_match(word, entries)
    assert (found is None) == (expected is None)
    if found:
        assert found[1] == expected[0] and entries[found[0]].endswith("*") == expected[1]
        assert not (found[0] != expected[2] and not expected[1])


def test_automaton_stays_bounded():
    rng = random.Random(1)
    entries = ["abcabcabc", "bacbac", "ccabb*"]
    small, large = op.Automaton(entries, most=20), op.Automaton(entries)
    for _ in range(500):
        word = "".join(rng.choices("abc", k=rng.randint(1, 11)))
        assert small.match(word) == large.match(word)
        assert len(small.states) < 20 + 12


def lexicon():
    return op.Lexicon({"worthless": 4.0, "stupid": 4.0, "moron": 3.0})


def test_misspelled_terms_are_hits_and_familiar_words_are_not():
    own = lexicon()
    assert [h[1] for h in own.hits("a worthles, st*pid m0ron! and stupidd fools")[1]] == ["worthles", "st*pid", "m0ron", "stupidd"]
    own = lexicon()
    own.familiar = frozenset(["oron"])
    assert own.hits("oron") == (1, []) and len(own.hits("morom")[1]) == 1


def test_quotation_scores_below_abuse():
    own, clean = lexicon(), "the weather was fine and everybody went out to see the old mill"
    abuse = own.features(f"You stupid worthless moron. {clean}")
    quoted = own.features(f"They heard “you stupid worthless moron” there. {clean}")
    reported = own.features(f"The word stupid is short. {clean}")
    line = own.features(f"> you stupid worthless moron\nThat is no way to talk. {clean}")
    assert abuse[0] > quoted[0] > 0 and abuse[2] > line[2] > 0 and reported[0] < own.features(f"So very stupid all. {clean}")[0]


def test_windows_add_what_stands_close():
    own = lexicon()
    text = "stupid " + "x " * 5 + "moron " + "y " * 40 + "stupid"
    assert [(p, round(s, 6)) for p, s in own.windows(text)] == [(0, 7.0), (6, 7.0), (47, 4.0)]


def corpus(n=400):
    rng = random.Random(4)
    plain = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["grobblewit", "snarkhead", "vexpile", "muddlefop"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_and_catches_misspellings(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9001, rows[1][1] + " you snarkheed and muddlefob, grobllewit"), (9002, rows[2][1])], "doc_id long, text string")
    model = op.train(docs, spark.createDataFrame(labels, LABELS))
    assert {"grobblewit", "snarkhead", "vexpile", "muddlefop"} <= set(model.lexicon.entries)
    found = {r.doc_id: r for r in op.score(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [i for i in truth if found[i].held_out]
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert found[9001].predicted == 1 and found[9002].predicted == 0


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = op.score(docs, op.train(docs, labels)).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    hit = sum(r.predicted for r in rows if r.toxic)
    wrong = sum(r.predicted for r in rows if not r.toxic)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and wrong <= 0.01 * len(rows)


def test_odd_rows(spark):
    rows, labels = corpus(80)
    odd = [(None, "grobblewit"), (500, None), (501, ""), (501, ""), (502, " \n\t"), (503, "grobblewit " * 50_000), (504, "\x00퟿ ''")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows + odd], "doc_id long, text string, score int, toxic string")
    kinds = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (500, 0, None), (501, 1, 0), (7000, 1, 1)], LABELS)
    model = op.train(docs, kinds)
    found = [r for r in op.score(docs, model).collect() if r.doc_id is None or r.doc_id >= 500]
    assert len(found) == len(odd) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[500].score == by_id[501].score == by_id[502].score and by_id[501].predicted == 0 and by_id[503].predicted == 1
    assert by_id[None].held_out is False


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(0, 1, 0), (2, 1, 0)], None), ([(1, 0, None)], 0.5)])
def test_without_labels_of_both_kinds(spark, labels, share):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    got = op.score(docs, op.train(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len({r.score for r in got}) == 1 and (share is None or got[0].score == share)
    empty = docs.limit(0)
    assert op.score(empty, op.train(empty, spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 1), (4, 1, 0)], LABELS))).collect() == []


def test_fit_separates():
    x = np.array([[0.0], [0.1], [2.0], [2.1]])
    beta = op.fit(x, np.array([0.0, 0, 1, 1]), np.ones(4))
    assert beta[1] > 0 and beta[0] + beta[1] * 0.05 < 0 < beta[0] + beta[1] * 2
