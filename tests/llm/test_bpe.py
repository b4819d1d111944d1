import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import plain_ids, plain_merge
from hypothesis import given, settings
from hypothesis import strategies as st

from feedops.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
TEXTS = [
    "Hello world, it's 2024!  Two  spaces\n\n and\ttabs ", "", None, "ünïcödé façade 你好 🙂🙂", "a" * 3000, " " * 500 + "x", "the the the the",
    "the the the the", "<|endoftext|> is text", "don't DON'T we'll", "  x﻿", "0123456789" * 40,
]


@given(st.binary(min_size=1, max_size=90))
@settings(max_examples=150, deadline=None)
def test_merges_equal_the_plain_ones(word):
    assert bpe._merge_short(word, RANKS) == bpe._merge_long(word, RANKS) == plain_merge(word, RANKS)


@given(st.lists(st.integers(0, 2**31 - 1), max_size=50))
@settings(deadline=None)
def test_pack_round_trip(numbers):
    assert bpe.unpack(bpe.pack(np.array(numbers, np.int64))).tolist() == numbers


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "again"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_ids_equal_tiktoken_and_decode_back(docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN, buckets=5)
    got = [(r.doc_id, list(r.ids)) for r in coded.collect()]
    texts = [(i, t or "") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6]), (None, "no id")]
    order = {t: k for k, t in enumerate(texts)}
    assert sorted(map(str, got)) == sorted(str((i, own.encode_ordinary(t))) for i, t in order)\
        or sorted(map(str, got)) == sorted(str((i, own.encode_ordinary(t))) for i, t in texts)
    back = sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in bpe.decode(coded, PATH).collect())
    assert back == sorted((str(i), t) for i, t in texts)
    assert plain_ids(TEXTS[0], RANKS, public_tokenizers.PATTERN) == own.encode_ordinary(TEXTS[0])


def test_buckets_follow_the_partitions_and_hold_a_bounded_number_of_words(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for partitions in ("4", "3000", "90000"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(bpe.word_buckets(spark))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [bpe.WORD_BUCKETS, 3000, bpe.MOST_BUCKETS]
    want = sorted(map(str, bpe.encode(docs, PATH, public_tokenizers.PATTERN, buckets=1).collect()))
    assert sorted(map(str, bpe.encode(docs, PATH, public_tokenizers.PATTERN, buckets=1, held=2).collect())) == want


def test_blocks_of_few_words_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 3)
    monkeypatch.setattr(bpe, "CHUNK_DOCS", 2)
    for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN, buckets=2).collect():
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = plain_ids(text, RANKS, public_tokenizers.PATTERN) if len(text) < 600 else None
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if ids is not None:
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_no_rows(docs):
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    assert bpe.encode(docs.filter("text = ''"), PATH, public_tokenizers.PATTERN).first().ids == []
