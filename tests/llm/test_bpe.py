import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from terrametro.llm import bpe

TOKENS = bpe.read_ranks(None, P.path("byte_bpe_multi_50k.tiktoken"))
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 5)
    monkeypatch.setattr(bpe, "DIRECT", 3)
    return bpe.Encoder(TOKENS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabeéß're llvs'  \n\t,.!?09日本🙂"), max_size=90))
def test_tree_equals_library(text):
    leaf, direct = bpe.LEAF, bpe.DIRECT
    bpe.LEAF, bpe.DIRECT = 4, 3
    try:
        ids = bpe.Encoder(TOKENS, P.PATTERN).encode(text)
    finally:
        bpe.LEAF, bpe.DIRECT = leaf, direct
    assert ids == TRUTH.encode_ordinary(text)


def test_long_and_odd_texts(tight):
    rnd = random.Random(1)
    texts = ["", " ", "\n\n  x", "a" * 3001, "ab" * 900, "<|endoftext|>", " " * 500 + "z", "the cat's we'll 'Re " * 40, "é" * 333]
    texts += ["".join(rnd.choice("abc dé\n'st1 ") for _ in range(700)) for _ in range(20)]
    for text in texts:
        ids = tight.encode(text)
        assert ids == TRUTH.encode_ordinary(text)
        assert tight.decode_tree(ids, 4) == text.encode()


def test_columns(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = docs.select("doc_id", bpe.encode_column(docs.text, TOKENS, P.PATTERN, spark).alias("e")).select("doc_id", "e.ids", "e.decoded")
    got = got.withColumn("again", bpe.decode_column(got.ids, TOKENS, spark)).collect()
    assert [(r.ids, bytes(r.decoded), bytes(r.again)) for r in got] == [(TRUTH.encode_ordinary(t or ""), (t or "").encode(), (t or "").encode()) for _, t in rows]
    assert docs.limit(0).select(bpe.encode_column(docs.text, TOKENS, P.PATTERN, spark)).count() == 0
