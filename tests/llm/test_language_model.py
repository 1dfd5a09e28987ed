import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from mediadate.llm import elias_fano, language_model, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = lambda doc: zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1
    tokens = [(doc, held(doc), [*WORD.findall((text or "").translate(LOWER)), "\n"]) for doc, text in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, out, words in tokens:
        if not out:
            one.update(words)
            two.update(zip(words, words[1:]))
            three.update(zip(words, words[1:], words[2:]))
    total, size, cut = sum(one.values()), len(one), language_model.DISCOUNT
    mass2, mass3 = Counter(), Counter()
    for (a, _), c in two.items():
        mass2[a] += c - cut
    for (a, b, _), c in three.items():
        mass3[a, b] += c - cut

    def p1(w):
        return (one[w] + 0.5) / (total + 0.5 * (size + 1))

    def p2(a, w):
        if not one[a]:
            return p1(w)
        return max(two[a, w] - cut, 0) / one[a] + (1 - mass2[a] / one[a]) * p1(w)

    def p3(a, b, w):
        if not two[a, b]:
            return p2(b, w)
        return max(three[a, b, w] - cut, 0) / two[a, b] + (1 - mass3[a, b] / two[a, b]) * p2(b, w)

    for doc, out, words in tokens:
        chances = [p1(words[0])] + [p2(*pair) for pair in [words[:2]] if len(pair) > 1] + [p3(*w) for w in zip(words, words[1:], words[2:])]
        base, score = (sum(math.log10(p) for p in ps) for ps in (map(p1, words), chances))
        yield doc, out, len(words), sum(one[w] > 0 for w in words), total, base, score


def compare(got, want):
    key = lambda r: (repr(r[0]), r[2], r[3], round(r[5], 6))
    got = sorted((tuple(r[n] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) < 5e-4 * w[2]


def test_query(spark, folder, rows):
    compare(registry.op9_language_model(spark, folder).collect(), list(brute([(r[0], r[1]) for r in rows])))


def test_small_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(language_model, "WIDTH", 3)
    monkeypatch.setattr(language_model, "TOKENS_HELD", 500)
    compare(language_model.score_documents(docs).collect(), list(brute([(r[0], r[1]) for r in rows])))


def test_probabilities_sum_to_one(spark):
    rows = [(k, "a b a c a b d a b a") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.Builder(docs)
    encoded = language_model.settle(language_model.encode_corpus(docs, model.facts, model.files))
    model.add_bigrams(encoded)
    model.add_trigrams(encoded)
    trie = language_model.Model(model.facts, model.files)
    known = np.arange(model.facts["vocabulary"])
    for a in known:
        for b in known:
            words = np.array([[a, b, w] for w in [*known, -1]])
            scores = trie.score(words.reshape(-1), np.arange(len(words)) * 3).reshape(-1, 3)
            # the unigram has half a count for one unknown word
            assert (10.0 ** scores[:, 2]).sum() == pytest.approx(1, abs=2e-3)


def test_held_out_text_is_better_predicted(spark):
    rows = [(k, "the cat sat on the mat and the dog sat on the log " * 5) for k in range(50)]
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r["held_out"] for r in got)
    assert all(r["score"] > 0.7 * r["base_score"] for r in got if r["held_out"])


@pytest.mark.parametrize(("n", "universe"), [(0, 9), (1, 1), (7, 7), (500, 90), (3000, 1 << 20), (4000, 1 << 61)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    code = elias_fano.EliasFano(elias_fano.encode(values, universe))
    wanted = np.concatenate([rng.integers(0, universe, 500).astype(np.uint64), values[:500]])
    index, equal = code.find(wanted)
    assert (index == np.searchsorted(values, wanted)).all() and (equal == np.isin(wanted, values)).all()
    if n:
        at = rng.integers(0, n, 500)
        assert (code.get(at) == values[at]).all()


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 100_000)).astype(np.uint64)
    parts = elias_fano.encode(values, 1 << 40)
    assert 8 * sum(part.nbytes for part in parts.values()) / 100_000 < 2 + 24 + 4


def test_empty(empty):
    assert language_model.score_documents(empty).collect() == []


def test_open_files_are_bounded(docs, monkeypatch):
    """Files are mapped again when the bytes held are few; the scores are the same."""
    want = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in language_model.score_documents(docs).collect()}
    monkeypatch.setattr(language_model, "ENTRIES", 5000)
    monkeypatch.setattr(language_model, "MAPPED_BYTES", 1 << 16)
    for r in language_model.score_documents(docs).collect():
        assert abs(want[r["doc_id"], r["n_tokens"], round(r["base_score"], 6)] - r["score"]) < 5e-4 * r["n_tokens"]
    opened = language_model.OrderedDict()
    monkeypatch.setattr(language_model, "worker_cache", lambda: {"model shards": opened})
    model = language_model.Builder(docs)
    encoded = language_model.settle(language_model.encode_corpus(docs, model.facts, model.files))
    model.add_bigrams(encoded)
    trie = language_model.Model(model.facts, model.files)
    trie.bigrams_of(np.arange(model.facts["vocabulary"]), np.zeros(model.facts["vocabulary"], np.int64))
    assert len(opened) > 0 and (len(opened) == 1 or sum(held.size for held in opened.values()) <= 1 << 16)


def test_runs_are_merged():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, 500, 200) << 40, return_counts=True) for _ in range(5)]
    packed = [language_model._run_row(0, *part) for part in parts]
    back = [language_model._run(row["entries"], row["keys"], row["counts"]) for row in packed]
    keys, counts = language_model._summed(*map(np.concatenate, zip(*back)))
    want = Counter()
    for part in parts:
        want.update(dict(zip(*(side.tolist() for side in part))))
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys) > 0).all()
