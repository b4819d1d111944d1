import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from feedops.llm import quality


def test_tables_add_up_and_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.Model(x, y, rounds=30, pair_rounds=40)
    p = model.score(x)
    assert (0, 1) in model.pairs and ((p > 0.5) == (y > 0)).mean() > 0.95
    fine, rough = model.bins(x[:1])
    total = model.base + sum(t[k[0]] for t, k in zip(model.tables, fine)) + sum(t[rough[i][0], rough[j][0]] for (i, j), t in model.pairs.items())
    assert abs(1 / (1 + np.exp(-total)) - p[0]) < 1e-12


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_measures_are_finite(text):
    found = quality.measure(text)
    assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


def test_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (2, "", "z"), (3, "x " * 50_000, "z"), (None, "abc", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model is None
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5] * 5
    one = quality.train(docs, spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "doc_id long, quality int"))
    got = quality.score(docs, one).collect()
    assert len(got) == 5 and all(r.score > 0.5 and r.predicted == 1 for r in got)
    assert quality.score(docs.limit(0), one).collect() == []
