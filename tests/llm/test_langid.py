import numpy as np
import pyarrow as pa

from feedops.llm import langid


def test_gradients_equal_differences():
    network = langid.Network(["a", "b", "c"], hidden=4, seed=2)
    for k, v in network.w.items():
        network.w[k] = v.astype(np.float64)
    network.w["ga"] *= 0.8
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 102, (5, 9)).astype(np.int16)
    windows[3, 6:] = langid.PAD
    label = np.array([0, 1, 2, 1, 0])
    _, grad = network.gradients(windows, label)
    for name, at in (("ga", (0, 98, 1)), ("ca", (1, 99, 2)), ("gh", (0, 1, 2)), ("ch", (1, 2, 0)), ("out", (1, 3, 1)), ("bias", (2,))):
        old, step = network.w[name][at], 1e-2
        sides = []
        for sign in (1, -1):
            network.w[name][at] = old + sign * step
            sides.append(network.gradients(windows, label)[0])
        network.w[name][at] = old
        assert abs((sides[0] - sides[1]) / (2 * step) - grad[name][at]) < 2e-3, name


def test_windows_cover_every_byte():
    texts = pa.array(["abc", None, "", "é" * 200, "x" * langid.WINDOW])
    windows, row = langid.windows_of(texts)
    for i, t in enumerate(texts.to_pylist()):
        flat = windows[row == i].reshape(-1)
        assert bytes(flat[flat != langid.PAD].astype(np.uint8)).decode() == (t or "")
    assert langid.windows_of(pa.array([], pa.string()))[0].shape[0] == 0


def test_held_out_accuracy(spark, documents):
    got = langid.identify(documents).join(documents.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    long = got[got.held_out & (got.n_chars > 100)]
    assert len(got) == documents.count() and got.score.between(0, 1).all()
    assert (long.lang == long.lang_pred).mean() > 0.95


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, t, "en" if i % 2 else "de", "z") for i, t in enumerate(["der die das ist und " * 20, "the of and with this " * 20] * 8)]
    odd = [(100, None, "en", "a"), (101, "", "en", "a"), (102, "123 !!! 4", "en", "a"), (103, "the and with", None, "a"), (103, "the and with", None, "a"), (None, "die das und", "de", "a"), (104, "the with of " * 9000, "de", "a")]
    network = langid.train(spark.createDataFrame(rows, schema))
    found = [(r.doc_id, r.lang_pred) for r in langid.predict(spark.createDataFrame(odd, schema), network).collect()]
    assert sorted(found, key=str) == sorted([(100, "und"), (101, "und"), (102, "und"), (103, "en"), (103, "en"), (None, "de"), (104, "en")], key=str)
    kept = langid.keep_known(spark.createDataFrame(odd, schema), network, 0.6)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and sorted(str(r.doc_id) for r in kept.collect()) == ["103", "103", "104", "None"]
    nothing = langid.identify(spark.createDataFrame(odd, schema).filter("lang IS NULL"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []


def test_learns_only_outside_the_held_fold(spark):
    import zlib

    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "der die das ist und " * 10, "xx" if i in held else "de") for i in range(300)]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).labels == ["de"]
