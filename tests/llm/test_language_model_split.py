"""Texts are split once, and long runs of equal high bits are searched from samples."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mediadate.llm import elias_fano, language_model
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aBÉİ漢\x00\x1c\x1f\x85\xa0\u2003 \t\n\x0b\x0c\r"))), st.sampled_from([pa.string(), pa.large_string()]))
def test_tokens(texts, kind):
    codes, words, sizes = language_model._tokens(pa.array(texts, kind))
    words = words.to_pylist()
    want = [[*WORD.findall((text or "").translate(LOWER)), ""] for text in texts]
    assert sizes.tolist() == [len(one) for one in want]
    assert [words[code] for code in codes] == [word for one in want for word in one]
    assert len(set(language_model._hashes(pa.array(words, kind)).tolist())) == len(words)


def test_texts_are_read_once(spark):
    docs = spark.createDataFrame([(k, f"a b c{k} a b") for k in range(40)], "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    counted = docs.withColumn("text", F.udf(seen, "string")("text"))
    assert len(language_model.score_documents(counted).collect()) == 40
    assert read.value == 40


def test_small_parts_of_text(docs, monkeypatch):
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(repr([r[n] for n in names]) for r in language_model.score_documents(docs).collect())
    monkeypatch.setattr(language_model, "TEXT_BYTES", 100)
    monkeypatch.setattr(language_model, "WORDS_HELD", 3)
    assert sorted(repr([r[n] for n in names]) for r in language_model.score_documents(docs).collect()) == want


@pytest.mark.parametrize("run", [1, 31, 32, 33, 64, 5000])
def test_samples_bound_the_search(run, monkeypatch):
    rng = np.random.default_rng(run)
    dense = np.concatenate([(k << 40) + np.unique(rng.integers(0, 1 << 14, run)) for k in range(0, 90, 3)])
    values = dense.astype(np.uint64)
    code = elias_fano.EliasFano(elias_fano.encode(values, 1 << 47, sampled=True))
    wanted = np.sort(np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 47, 500).astype(np.uint64)]))
    steps = []
    low = code._low
    monkeypatch.setattr(code, "_low", lambda index: (steps.append(len(index)), low(index))[1])
    index, equal = code.find(wanted)
    assert (index == np.searchsorted(values, wanted)).all() and (equal == np.isin(wanted, values)).all()
    assert len(steps) <= 16
