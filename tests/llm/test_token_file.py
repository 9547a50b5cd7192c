"""Operator 11: Elias-Fano against plain lists, files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grantseek.llm import token_file
from grantseek.llm.elias_fano import EliasFano
from tests.llm.helpers import documents, hostile

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 40)), max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    code, used = EliasFano.from_buffer(memoryview(EliasFano.of(values).to_bytes() + b"rest"))
    assert used == len(EliasFano.of(values).to_bytes())
    assert code.values().tolist() == values.tolist() == code[np.arange(len(values))].tolist()
    assert [code[i] for i in range(len(values))] == values.tolist()
    for value in {0, 5, *values[:4].tolist(), int(values[-1]) + 1 if len(values) else 1}:
        assert code.last_at_most(value) == int(np.searchsorted(values, value, "right")) - 1


def test_elias_fano_is_small_and_refuses_disorder():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 100_000))
    bits = 8 * len(EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2 + np.log2(500) + 1.5
    with pytest.raises(ValueError, match="ascending"):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1]))[1]


AWKWARD = st.text(alphabet=st.sampled_from(list("aAbeéÉ'stTrev́İΣςﬁ1２ \n\t\x1c\x85 <|>endofx._-🙂日")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(AWKWARD | st.text(max_size=40) | st.just("a <|endoftext|> b<|startoftext|>c"), min_size=1, max_size=4))
def test_words_have_the_ids_of_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    coder = token_file.loaded(PATH, 2)
    assert [np.frombuffer(coder.encode(t), coder.dtype).tolist() for t in texts] == [ids_of(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAtTsSzßÀÿÖéµ×'.,!1$<|>")), max_size=12), max_size=8))
def test_plain_words_go_to_the_model(words):
    coder = token_file.loaded(PATH, 2)
    assert coder._direct
    assert np.frombuffer(coder.encode(" ".join(words)), coder.dtype).tolist() == ids_of(" ".join(words))


def test_a_segment_gives_single_documents():
    names, lists = [None, -5, -5, 7, 10**15], [[1], [], [65535, 2], [3, 4, 5], [2]]
    data = token_file.pack_segment(names, [np.array(x, "<u2").tobytes() for x in lists], 2, 3, 4) + b"\n"
    first, second = token_file.segments(data + data)
    assert (first.part, first.number, first.documents, second.doc_ids()) == (3, 4, 5, names)
    assert [first.doc_id(i) for i in range(5)] == names and [first.ids(i).tolist() for i in range(5)] == lists
    assert [first.document_at(k) for k in range(7)] == [0, 2, 2, 3, 3, 3, 4]
    with pytest.raises(ValueError, match="not a file"):
        token_file.Segment(memoryview(b"x" * 200))


def check(docs, rows):
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = ids_of(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in want] and [r[1] for r in got][0] == 0
    assert sorted(map(str, (r[:1] + r[2:] for r in got))) == sorted(map(str, (r[:1] + r[2:] for r in want)))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[-1][1] + got[-1][2] == start


def test_files_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(token_file, "RANGE_BYTES", 20_000)
    docs = hostile(spark).repartition(3)
    check(docs, token_file.file_digests(docs, PATH, 2).collect())
    assert token_file.file_digests(docs.limit(0), PATH, 2).count() == 0


def test_files_are_raw_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "RANGE_BYTES", 2_000)
    docs = documents(spark, [(k * 7 % 500 - 100, f"Word{k} and more\nwords {'x' * (k % 50)}") for k in range(500)]).repartition(5)
    path = str(tmp_path / "ids")
    token_file.write_token_files(docs, path, PATH, 2)
    files = sorted(p for p in (tmp_path / "ids").iterdir() if p.name.startswith("part-"))
    assert len(files) > 3
    segments = sorted((s for p in files for s in token_file.segments(p.read_bytes())), key=lambda s: (s.part, s.number))
    found = {i: s.ids(k).tolist() for s in segments for k, i in enumerate(s.doc_ids())}
    assert list(found) == sorted(found) == list(range(-100, 400))
    assert found == {r.doc_id: ids_of(r.text) for r in docs.collect()}
    again = {r.id: r.ids for r in token_file.read_token_files(spark, path).collect()}
    assert again == found
    check(docs, token_file.token_digests(spark, path).withColumnRenamed("id", "doc_id").collect())


def test_one_text_of_30_mb_and_many_segments(spark, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT", 1000)
    long = " ".join(f"w{i % 977} the" for i in range(4_000_000))
    assert len(long) > 30_000_000
    coder = token_file.loaded(PATH, 2)
    packed = coder.encode(long)
    period = " ".join(f"w{i} the" for i in range(977))
    ids = np.array(ids_of(period)[:-1], "<u2")
    whole = np.frombuffer(packed, "<u2")
    assert (whole[: len(ids) * 4000] == np.tile(ids, 4000)).all() and whole[-1] == 2
    docs = documents(spark, [(1, "x y"), (2, long[:3_000_000]), (3, "z"), (4, None)])
    check(docs, token_file.file_digests(docs, PATH, 2).collect())
