import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from helpers import groups, plain_fingerprint, plain_hits

import corpus_pipeline
from feedops.llm import bpe, langid, pii, simhash


def test_run_equals_the_plain_stages(spark, data, documents):
    network = langid.train(documents)
    score = {r.doc_id: r.score for r in langid.predict(documents, network).collect()}
    least = corpus_pipeline.least_language(len(network.labels))
    rows = sorted((r.doc_id, r.text) for r in documents.collect() if score[r.doc_id] >= least)
    assert len(rows) > 0.9 * documents.count()
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4]
    first = groups(len(rows), near)
    assert 0 < sum(first[i] != i for i in range(len(rows)))
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {}
    rows = [r for r in rows if not any_hit(r[1], items, windows)]
    clean = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), corpus_pipeline.KEY).collect()}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in clean.items():
        ids = np.array(own.encode_ordinary(text), "<u4")
        want[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want and 0 < len(got) < documents.count()


def any_hit(text, items, cache):
    """Whether a word window of an item stands in the text; the first word of a window is looked for first."""
    if "first" not in cache:
        from helpers import plain_words

        cache["first"] = {}
        for item, other in items:
            words = plain_words(other)
            for at in range(max(1, len(words) - 9) if words else 0):
                cache["first"].setdefault(" ".join(words[at:at + 10]), item)
    from helpers import plain_words

    own = plain_words(text)
    return any(" ".join(own[i:i + 10]) in cache["first"] for i in range(len(own))) and bool(plain_hits(text, items)[1].any())


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "privacy", "tokens"]


def test_near_copies_are_those_of_op5(spark, data, documents):
    """The stage keeps one document of each group that the operator with its contract's lengths finds."""
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents, 4, 4).collect()}
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, documents, data).collect())
    assert kept == sorted(set(found.values())) and len(kept) < len(found)


def test_stages_keep_the_columns(spark, data, documents):
    docs = documents.limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).schema.simpleString() == docs.schema.simpleString()


def test_language_limit_rejects_noise(spark):
    """Most noise stays below the limit, and hardly a text of the languages learned."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    network = langid.train(docs)
    least = corpus_pipeline.least_language(len(network.labels))
    rng = random.Random(2)
    noise = [" ".join("".join(rng.choices("абвгдежзиклмнопрстуфхцчqwxzkjvQXZ0189+/", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(60)]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*noise, "1234 !!", ""])], "doc_id long, text string")
    kept = {r.doc_id for r in langid.keep_known(odd, network, least).collect()}
    assert len(kept) < len(noise) / 2 and not kept & {60, 61}
    long = docs.filter("length(text) > 200").select("doc_id", "text")
    assert langid.keep_known(long, network, least).count() >= 0.998 * long.count()


def test_limit_by_number_of_languages():
    assert [round(corpus_pipeline.least_language(k), 3) for k in (0, 1, 2, 4)] == [0.0, 0.0, 0.65, 0.475]
