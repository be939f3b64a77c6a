import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import encode as e

pytestmark = pytest.mark.skipif(not Path(e.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(e.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  \t x", "a" * 5000, "ab" * 3000, "-" * 3000, "the" * 999, "<|endoftext|>", "\x1c\x1d\x85\u2028 a", "👩\u200d💻🏽 ok", "năm 2025 — déjà vu 索引", "'s 've 'LL it's", "\ufeffx \ufffd"]


def test_odd_texts(exact):
    assert [x.tolist() for x in e.encode_batch(ODD)] == [exact(t) for t in ODD]
    assert e.encode_batch([None])[0].tolist() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(e.VOCABULARY)
    t.encode_special_tokens = True
    assert e.encode_batch([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_exact_merging_equals_the_verified_proposal():
    rnd, v = random.Random(5), e.vocabulary(e.VOCABULARY)
    words = [bytes(rnd.choice(b"aabcdeeehiinnorsttth ") for _ in range(rnd.randrange(1, 30))) for _ in range(500)]
    for w in words:
        proposal = v.propose(w)
        import numpy as np

        p = np.array(proposal)
        if v.compatible(p[:-1], p[1:]).all():
            assert proposal == v.merge(w)


def test_forgetting(monkeypatch, exact):
    monkeypatch.setattr(e, "REMEMBERED", 3)
    texts = ["one two three", "two three four five", "one six seven"] * 3
    assert [x.tolist() for x in e.encode_batch(texts)] == [exact(t) for t in texts]
    e.vocabulary(e.VOCABULARY).known.clear()


def test_spark(spark, exact):
    rows = [(i, t, "en", [1]) for i, t in enumerate([*ODD, None, "x" * 300_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids array<int>")
    got = {r.doc_id: r.ids for r in e.encode(df).collect()}
    assert got == {i: exact(t) if t else [] for i, t, *_ in rows}
    assert e.encode(df.limit(0)).count() == 0
