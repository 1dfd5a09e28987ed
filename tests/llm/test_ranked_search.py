import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from mediadate.llm import ranked_search, registry
from test_simhash import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    lists = [(doc, Counter(terms_of(text))) for doc, text in docs]
    sizes = [sum(counts.values()) for _, counts in lists]
    total, documents = sum(sizes), sum(size > 0 for size in sizes)
    df = Counter(term for _, counts in lists for term in counts)
    for item, text in items:
        asked = Counter(terms_of(text))
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in asked}
        scored = []
        for (doc, counts), size in zip(lists, sizes):
            m = 100 - 25 + (25 * size * documents) // max(1, total)
            score = sum(q * weight[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in asked.items() if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, doc, -score


def compare(got, want):
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == Counter(want)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choice(words[: rng.choice([5, 50, 400])]) for _ in range(rng.randint(0, 90)))) for k in range(700)]
    docs += [(k + 700, docs[k % 7][1]) for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for k in range(40)]
    return docs, items + items[:2] + [(None, docs[3][1]), (99, None), (98, "--- unknownterm"), (97, "w1 w1 w1 w2 w2")]


def test_query_and_sql(spark, folder, rows):
    got = registry.op11_ranked_search(spark, folder).collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    compare(got, brute([row[:2] for row in rows], items))


@pytest.mark.parametrize("block", [30, 1 << 13])
def test_search(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block * 300)
    monkeypatch.setattr(ranked_search, "CHUNK_ITEMS", 7 if block == 30 else 1000)
    docs, items = corpus
    got = ranked_search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20
    )
    compare(got.collect(), brute(docs, items))


def test_empty(spark, empty, docs):
    items = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []


def test_terms():
    texts = ["Ab c", None, "", "d--Ée9", "f", "_x^", "ÀÉ漢"]
    terms, owners = ranked_search.cut_terms(pa.array(["skipped", *texts]).slice(1))
    assert [t.decode() for t in terms.to_pylist()] == [t for text in texts for t in terms_of(text)]
    assert owners.tolist() == [k for k, text in enumerate(texts) for _ in terms_of(text)]


def block_of(texts, query, k=20):
    """A block, a chunk of one query and what the search needs of them, without files."""
    block = ranked_search.Block.of(pa.array(range(len(texts))), pa.array(texts))
    chunk = ranked_search.Chunk.__new__(ranked_search.Chunk)
    own = sorted(set(terms_of(query)))
    chunk.vocabulary = pa.array([t.encode() for t in own], pa.large_binary())
    counts = Counter(term for text in texts for term in set(terms_of(text)))
    chunk.weights = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * counts[t] + 1))) for t in own])
    chunk.terms, chunk.repeats = [np.arange(len(own))], [np.ones(len(own), np.int64)]
    chunk.all_pairs = [(a, a + 1) for a in range(len(own) - 1)]
    chunk.pairs = [[(a, a + 1, a) for a in range(len(own) - 1)]]
    impacts = ranked_search.Impacts(block, chunk, len(texts), int(block.lengths.sum()))
    return block, chunk, impacts, ranked_search.joint_maxima(impacts, chunk, k)


def test_pair_bounds_are_tighter_and_hold():
    """Terms that exclude each other in documents: single maxima add up, joint ones do not."""
    texts = [f"w{k % 4} filler{k} " + "w4 w5 " * (k % 50 == 0) for k in range(400)]
    block, chunk, impacts, (joint, floors) = block_of(texts, "w0 w1 w2 w3 w4 w5")
    pairs = [(a, b, int(joint[p])) for a, b, p in chunk.pairs[0]]
    most = impacts.most[chunk.terms[0]]
    order, sums = ranked_search.bounds(most, pairs)
    _, plain = ranked_search.bounds(most, [])
    assert all(a <= b for a, b in zip(sums, plain)) and sums[-1] < plain[-1]
    scores = np.zeros(len(texts), np.int64)
    for term in range(6):
        docs, own = impacts.postings(term)
        scores[docs] += own
    for few in range(len(order) + 1):
        part = np.zeros(len(texts), np.int64)
        for place in order[:few]:
            docs, own = impacts.postings(int(place))
            part[docs] += own
        assert part.max() <= sums[few]
    assert 0 < floors[0] <= np.sort(scores)[-20]
    skipped = sum(s < floors[0] for s in sums[1:])
    assert skipped >= sum(s < floors[0] for s in plain[1:])


def test_search_below_the_floor_finds_nothing():
    texts = ["a b", "a", "b", "c"] * 30
    _, chunk, impacts, (joint, _) = block_of(texts, "a b")
    found, scores = ranked_search.search_block(impacts, chunk, 0, joint, len(texts), 0)
    assert len(found) == 90
    best = int(scores.max())
    found, scores = ranked_search.search_block(impacts, chunk, 0, joint, len(texts), best)
    assert set(scores.tolist()) == {best} and len(found) == 30
    assert len(ranked_search.search_block(impacts, chunk, 0, joint, len(texts), best + 1)[0]) == 0
