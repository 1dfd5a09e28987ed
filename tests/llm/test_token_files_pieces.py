"""Distinct pieces of many texts at once, and what the encoder remembers."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from mediadate.llm import token_files
from mediadate.llm.common import text_parts
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["the", "The", "it's", "IT'S", "", "été", "ÉTÉ", "ÿ", "x1", "a.b,c", "!!", "漢字", "Σας", "İi", "<|endoftext|>", "end<|endoftext|>x", "é", "tab\tbed", " ", "'ll", "µ", "÷9"]


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("cached", [1, 30, 500_000])
def test_many_texts(kind, cached, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", cached)
    rng = random.Random(cached)
    encoder = token_files.PieceEncoder(PATH)
    for pool in (PIECES, PIECES[:11], PIECES):
        texts = [" ".join(rng.choices(pool, k=rng.randint(0, 30))).replace("  ", rng.choice(["  ", "\n "])) for _ in range(40)] + ["", " ", "\n"]
        got = encoder.encode(pa.array(texts, kind))
        assert [ids.tolist() for ids in got] == whole(texts)
        assert all(ids.dtype == np.dtype("<u4") for ids in got)
    assert encoder.encode(pa.array([], kind)) == []


def test_plain_pieces_are_known_by_their_parts():
    encoder = token_files.PieceEncoder(PATH)
    words, signs = ["one", "Two", "three", "été"], "!#$%&()*+,-./:;"
    texts = [f"{word}{sign}{other}" for word in words for sign in signs for other in words]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == whole(texts)
    assert not encoder.pieces and len(encoder.parts) == len(words) + len(signs) + 1  # and the space


def test_null_and_slices():
    texts = pa.array(["a b", None, "", "c d e", None, "f"])
    assert [ids.tolist() for ids in token_files.encode_texts(texts.slice(1, 4), PATH)] == whole(texts.slice(1, 4).to_pylist())


@pytest.mark.parametrize("most", [1, 7, 10, 1000])
def test_text_parts(most):
    texts = ["abc", None, "", "é" * 5, "x" * 50, "y", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = [part.to_pylist() for part in text_parts(batch, most)]
    assert [row["text"] for part in parts for row in part] == texts
    assert all(len(part) == 1 or sum(len((row["text"] or "").encode()) for row in part) <= most for part in parts)
