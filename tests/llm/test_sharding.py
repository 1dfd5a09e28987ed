import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import ordered
from mediadate.llm import sharding


def least_capacity(sizes, shards):
    def fits(capacity):
        used, now = 1, 0
        for size in sizes:
            if now + size > capacity:
                used, now = used + 1, 0
            now += size
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("block", [3, 100_000])
def test_shards_are_minimax(docs, rows, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", block)
    placed = sharding.shard_documents(docs, shards=7).collect()
    assert ordered(r["doc_id"] for r in placed) == ordered(row[0] for row in rows)
    size = lambda text: len((text or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == Counter(
        (row[0], size(row[1]), zlib.crc32((row[1] or "").encode())) for row in rows
    )
    groups, first = Counter(), {}
    for doc, text, *_ in rows:
        groups[text] += size(text)
        first[text] = min((x for x in (doc, first.get(text)) if x is not None), default=None)
    order = sorted(groups, key=lambda t: (first[t] is None, first[t] or 0))
    total = Counter()
    slots = defaultdict(list)
    for r in placed:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(total.values()) == least_capacity([groups[t] for t in order], 7)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_equal_texts_stay_together(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(1, 50) for _ in range(40)]
    rows = [(k, rng.choice(texts)) for k in range(900)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    text_of, shards = dict(rows), defaultdict(set)
    for r in placed:
        shards[text_of[r["doc_id"]]].add(r["shard"])
    assert all(len(found) == 1 for found in shards.values())


def test_greedy_and_even_cuts():
    class Known(sharding.RunningTotals):
        def __init__(self, ends):
            self._ends, self._known, self.total = [ends[-1]], {0: ends}, ends[-1]
            self.largest = max(b - a for a, b in zip([0, *ends], ends))

    ends = [5, 6, 16, 17, 18, 30, 31]
    capacity, cuts = sharding.smallest_capacity(Known(ends), 3)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert max(sizes) <= capacity and cuts[-1] == 31
    assert sharding.greedy_cuts(Known(ends), capacity - 1, 3) is None


def test_empty(empty):
    assert sharding.shard_documents(empty, shards=3).collect() == []
