"""Word and token kernels against Python's own splitting and the tokenizers library."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayline.llm import bpe, kernels

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.lists(st.one_of(
    st.text(max_size=40),
    st.text("ab 's't're  \n\t12é 　'!?.,日😀½ll'd've'm\r\x0b\x1c\x85", max_size=40),
), min_size=1, max_size=20)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    words = kernels.words_of(pa.array(texts, pa.string()))
    raw = words.data.tobytes()
    found = [raw[a:b] for a, b in zip(words.starts, words.ends)]
    assert found == [w for t in texts for w in t.encode().split()]
    assert np.diff(words.first).tolist() == [len(t.encode().split()) for t in texts]
    by_hash = {}
    for word, number in zip(found, words.hashes.tolist()):
        assert by_hash.setdefault(number, word) == word


def test_chunks_cover_all_rows_and_keep_long_texts_whole(monkeypatch):
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 10)
    column = pa.array(["aa", None, "b" * 35, "", "cc", "dddddddd", "e"])
    ranges = list(kernels.chunks(column))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(column)
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert list(kernels.chunks(pa.array([], pa.string()))) == []


ENCODER = bpe.Encoder(PATH)
REFERENCE = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_tokenizer(texts):
    expected = [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in ENCODER.encode(texts)] == expected


def test_strings_of_special_tokens_and_a_full_table(monkeypatch):
    texts = ["x <|endoftext|> y<|endoftext|>", "<|endoftext|>", "", "don't we'll a  b\n\n c"]
    expected = [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in ENCODER.encode(texts)] == expected
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    small = bpe.Encoder(PATH)
    for text in ("one two", "three four five six seven", "one two"):
        assert small.encode([text])[0].tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
