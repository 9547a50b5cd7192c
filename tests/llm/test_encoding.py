"""Operators 2 and 10 against the libraries whose vocabularies they read."""

import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from grantseek.llm import bpe, token_counts
from tests.llm.helpers import documents, hostile

RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = tokenizers.path("piece_bpe_32k.model")
ENCODING = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
AWKWARD = st.text(alphabet=st.sampled_from(list("aaabcdeth  \n\t'.!s01é日한🙂▁ 　 ")), max_size=120)


@settings(max_examples=200, deadline=None)
@given(AWKWARD | st.text(max_size=60))
def test_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    coder = bpe.loaded(RANKS, tokenizers.PATTERN)
    ids = coder.encode(text)
    assert ids.tolist() == ENCODING.encode_ordinary(text)
    assert coder.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, "aaab" * 700, " " * 2000 + "x", "\n" * 500, "é" * 700, "!" * 900, "thethe" * 400, "日本" * 400])
def test_long_matches(text):
    coder = bpe.loaded(RANKS, tokenizers.PATTERN)
    assert coder.encode(text).tolist() == ENCODING.encode_ordinary(text)


def test_joining_is_associative():
    coder, rnd = bpe.loaded(RANKS, tokenizers.PATTERN), random.Random(3)
    for _ in range(200):
        parts = ["".join(rnd.choice("aabbcdeth") for _ in range(rnd.randrange(0, 9))).encode() for _ in range(3)]
        a, b, c = (coder.tokens(p) for p in parts)
        assert coder.join(coder.join(a, b), c) == coder.join(a, coder.join(b, c)) == coder._merge(b"".join(parts))


def test_every_kind_of_space_and_letter():
    coder = bpe.loaded(RANKS, tokenizers.PATTERN)
    for c in [*range(0x300), 0x1680, *range(0x1ff0, 0x2070), 0x3000, 0x180e, 0xfeff, *range(0x4e00, 0x4e40), 0x1f600]:
        text = f"ab{chr(c)}c1{chr(c)}2 {chr(c)}{chr(c)} ,{chr(c)}."
        assert coder.encode(text).tolist() == ENCODING.encode_ordinary(text), hex(c)


def test_encoding_of_a_table(spark):
    docs = hostile(spark)
    texts = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in docs.collect())
    rows = bpe.encoding_digests(docs, RANKS, tokenizers.PATTERN).collect()
    want = sorted((d is None, d, len(ids := ENCODING.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(t.encode()).hexdigest()) for _, d, t in texts)
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    full = bpe.encoded(docs.where("doc_id = 10"), RANKS, tokenizers.PATTERN).first()
    assert full.ids == ENCODING.encode_ordinary("é ß 日本語 🙂 \u0000 x") and bytes(full.decoded).decode() == "é ß 日本語 🙂 \u0000 x"
    assert bpe.encoding_digests(docs.limit(0), RANKS, tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(AWKWARD | st.text(max_size=60))
def test_counts_of_every_prefix(text):
    text = text.encode("utf-8", "ignore").decode()
    counter = token_counts.loaded(PIECES)
    assert counter.count(text) == len(MODEL.encode(text))
    assert counter.prefix_counts(text).tolist() == [len(MODEL.encode(text[:i])) for i in range(len(text) + 1)]


def test_learned_words_count_the_same():
    counter, fresh = token_counts.loaded(PIECES), token_counts.PrefixCounter(PIECES)
    words = {"the", "then", "thenth,", "thenthe.", "the\n", "日本", "x!!", "zz\u0000"}
    fresh.learn(words)
    assert {w: fresh.words[w] for w in words} == {w: counter.count(w) for w in words} == {w: len(MODEL.encode(w)) for w in words}


def test_counts_of_a_table(spark):
    docs = hostile(spark)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(MODEL.encode(r.text or "")), n > 100) for r in docs.collect())
    got = token_counts.token_counts(docs, PIECES, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0


def test_truncation_to_budgets(spark):
    text = "The quick brown fox  jumps over\nthe lazy dog again and again"
    rows = token_counts.truncated(documents(spark, [(1, text), (2, None)]), PIECES, (0, 5, 1000)).collect()
    counts = [len(MODEL.encode(text[:i])) for i in range(len(text) + 1)]
    for r in rows:
        best = max(i for i, n in enumerate(counts) if n <= r.budget) if r.doc_id == 1 else 0
        assert (r.n_chars, r.n_tokens) == (best, counts[best] if r.doc_id == 1 else 0)
