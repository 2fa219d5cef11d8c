from __future__ import annotations

import random

import pytest

from voxelake.llm.encoding import Encoder, count_tokens, default_vocabulary, encode_corpus, merge_long, merge_short, read_ranks, token_statistics


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(default_vocabulary())


@pytest.fixture(scope="module")
def reference(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_any_text(ranks, reference):
    e, rng = Encoder(ranks), random.Random(1)
    letters = [chr(c) for c in range(300)] + list("\x85\xa0\u180e\u200b\u2028\u3000\u0301中😀١²Ⅰ\ufeff")
    for _ in range(5000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert e.encode(t) == reference(t)
    for t in ("<|endoftext|>", "a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(4000)), "", " \n\n x"):
        assert e.encode(t) == reference(t)


def test_both_ways_merge_alike(ranks):
    rng = random.Random(2)
    for _ in range(500):
        w = bytes(rng.choice(b"aeinrst lo\xc3\xa9") for _ in range(rng.randint(1, 120)))
        assert merge_short(w, ranks) == merge_long(w, ranks)


def test_corpus(spark, ranks, reference):
    data = [(1, None, 9), (2, "", 9), (3, "x" * 300_000, 9), (4, "Scan the lung.", 9), (4, "Scan the lung.", 9), (None, " ", 9)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted(((k, reference(t or "")) for k, t, _ in data), key=repr)
    n = {tuple(r) for r in count_tokens(df, keep=["doc_id"]).collect()}
    assert n == {(k, len(reference(t or ""))) for k, t, _ in data}
    assert sum(r.uses for r in token_statistics(encode_corpus(df)).collect()) == sum(len(reference(t or "")) for _, t, _ in data)
    assert encode_corpus(df.limit(0)).count() == 0
