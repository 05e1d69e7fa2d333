from __future__ import annotations

import base64
import os

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import tokens as K

PATH = f"{K.DEFAULT_FOLDER}/{K.DEFAULT_FILE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabulary file is not here")


@pytest.fixture(scope="module")
def encode():
    return K.encoder(PATH)


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("other", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorstu  \n\t'.,=-_(){}0123456789éüñ中😀́ "), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_same_as_another_encoder(encode, other, text):
    assert encode(text) == other.encode_ordinary(text)
    assert other.decode_bytes(encode(text)) == text.encode()


def test_long_words(encode, other):
    for text in ("a" * 3000, "=" * 3000, "abcdefghij" * 300, " " * 999, "ö" * 500, "<|endoftext|>"):
        assert encode(text) == other.encode_ordinary(text)
    assert encode(None) == encode("") == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.data())
def test_prefixes_append_and_edit(data, more):
    v = K.load(PATH)
    whole = K.Prefixes(v, data)
    grown = K.Prefixes(v)
    for i in range(len(data)):
        grown.append(data[i : i + 1])
    assert grown.last == whole.last and b"".join(v.bytes[t] for t in whole.encode()) == data
    start = more.draw(st.integers(0, len(data)))
    end = more.draw(st.integers(start, len(data)))
    new = more.draw(st.binary(max_size=10))
    whole.edit(start, end, new)
    fresh = K.Prefixes(v, data[:start] + new + data[end:])
    assert whole.last == fresh.last and bytes(whole.data) == bytes(fresh.data)


def test_an_edit_works_out_little_again():
    v = K.load(PATH)
    text = " ".join(f"word{i}" for i in range(400)).encode()
    p = K.Prefixes(v, text)
    assert p.edit(10, 12, b"XYZ") < 400 and p.last == K.Prefixes(v, text[:10] + b"XYZ" + text[12:]).last


def test_words_join_to_the_text():
    text = "It's  a\n\n test, isn't it?\t 12 345 "
    assert "".join(regex.findall(K.PATTERN, text)) == text


def test_table(spark, other):
    rows = [(1, "Hello world", "a"), (2, "", "b"), (3, None, None), (1, "Hello world", "a")]
    got = {r.doc_id: r.ids for r in K.distinct_documents(K.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), PATH)).collect()}
    assert got == {1: other.encode_ordinary("Hello world"), 2: [], 3: []}
    assert K.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
