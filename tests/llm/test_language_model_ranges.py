"""Levels cut by entries, whatever the vocabulary."""

import numpy as np
from mediadate.llm import language_model
from test_language_model import compare


def test_ranges_split_hot_words(docs, monkeypatch):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = [tuple(r[n] for n in names) for r in language_model.score_documents(docs).collect()]
    monkeypatch.setattr(language_model, "WIDTH", 3)
    monkeypatch.setattr(language_model, "TOKENS_HELD", 500)
    monkeypatch.setattr(language_model, "ENTRIES", 37)
    compare(language_model.score_documents(docs).collect(), want)


def test_files_are_bounded_by_entries(spark, monkeypatch):
    monkeypatch.setattr(language_model, "ENTRIES", 50)
    rows = [(k, " ".join(f"hot w{(k * 37 + i) % 200}" for i in range(60))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.Builder(docs)
    encoded = language_model.settle(language_model.encode_corpus(docs, model.facts, model.files))
    model.add_bigrams(encoded)
    model.add_trigrams(encoded)
    assert model.facts["vocabulary"] < language_model.WIDTH
    for level in (2, 3):
        sizes = [*np.diff(model.facts[f"bases{level}"])]
        assert len(sizes) > 3 and max(sizes) <= 50
    hot = max(range(model.facts["vocabulary"]), key=lambda a: sum(s // model.facts["vocabulary"] == a for s in model.facts["starts2"]))
    assert sum(s // model.facts["vocabulary"] == hot for s in model.facts["starts2"]) > 2
