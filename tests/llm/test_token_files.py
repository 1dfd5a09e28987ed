import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mediadate.llm import registry, token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype("<u4")
    data = token_files.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (token_files.unpack(data, width, 1001) == ids).all()


@pytest.mark.parametrize("width", [7, 16])
def test_random_access(width, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    monkeypatch.setattr(token_files, "READ_IDS", 100)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << width, n).astype("<u4") for n in (0, 1, 63, 64, 65, 500, 0, 7, 128)]
    out = io.BytesIO()
    writer = token_files.PackedWriter(out, width)
    for ids in docs:
        writer.add(ids)
    assert writer.close() == len(out.getvalue())
    reader = token_files.PackedReader(pa.BufferReader(out.getvalue()))
    assert reader.docs == len(docs) and reader.ids == sum(map(len, docs))
    assert all((reader.document(k) == ids).all() for k, ids in enumerate(docs))
    assert [k for k, ids in reader.documents() if (ids == docs[k]).all()] == list(range(len(docs)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sdÉßïΣİ漢9!<|>#́ \n\t -end")), st.just(PATH))
def test_pieces_encode_like_whole_texts(text, path):
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if text else []
    assert token_files.encode_texts([text], path)[0].tolist() == want


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "two  spaces\nand lines"
    assert token_files.encode_texts([text], path)[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_query(spark, folder, rows):
    tokenizer = Tokenizer.from_file(PATH)
    got = registry.op10_token_files(spark, folder).collect()
    want = Counter()
    for row in rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[row[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))


def test_empty(empty):
    assert token_files.encode_documents(empty, PATH, 49_408, 2).collect() == []


def test_ids_that_do_not_fit_are_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        token_files.pack(np.array([1, 1 << 16]), 16)
