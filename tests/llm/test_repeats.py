import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from mediadate.llm import registry, repeats


def brute(rows, length):
    """Documents in order of id (null last) and text hash; equal ones of an id are one document."""
    twins = {}
    for doc, text in rows:
        twins.setdefault((doc is None, doc or 0, signed_hash(text)), text or "")
    seen, result = set(), {}
    for key in sorted(twins):
        data = twins[key].encode()
        covered, fresh = np.zeros(len(data), bool), []
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                covered[k : k + length] = True
            else:
                seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int), [0]])) == 1).sum())
        result[key] = (len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return Counter((doc, *result[doc is None, doc or 0, signed_hash(text)]) for doc, text in rows)


def signed_hash(text):
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def digest(frame):
    size = lambda spans: sum(s["end"] - s["start"] for s in spans)
    return Counter((r["doc_id"], r["n_bytes"], size(r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in frame.collect())


def test_query(spark, folder, rows):
    got = registry.op4_repeated_passages(spark, folder).collect()
    want = brute([(row[0], row[1]) for row in rows], 100)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


@pytest.mark.parametrize("group", [2, 20_000])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_shared_passages(spark, group, alphabet):
    rng = random.Random(group)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(rng.randint(10, 120)) for _ in range(6)]
    rows = []
    for k in range(150):
        text = "".join(make(rng.randint(0, 60)) + rng.choice(shared) for _ in range(rng.randint(0, 5)))
        rows.append((k, text))
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(300, "a" * 500), (301, "ab" * 300), (302, "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(repeats.remove_repeats(frame, length=30, width=8, group=group)) == brute(rows, 30)


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 101) for _ in range(5300))
    windows = Counter()
    for owners, starts, counts, *_ in repeats.phrases([text, b"", text[:40], text[:700]], 50, 12):
        for owner, start, count in zip(owners, starts, counts):
            windows.update((int(owner), int(start) + k) for k in range(count))
    want = [(0, k) for k in range(5300 - 49)] + [(3, k) for k in range(700 - 49)]
    assert windows == Counter(want)


def test_phrases_depend_on_content_alone():
    rng = random.Random(4)
    shared = bytes(rng.randrange(256) for _ in range(400))
    found = defaultdict(set)
    for number, before in enumerate((b"", b"x" * 77, bytes(range(200)))):
        for _, starts, counts, hashes, *_ in repeats.phrases([before + shared + before], 60, 16):
            for start, count, h in zip(starts - len(before), counts, hashes):
                found[number].add((int(start), int(count), int(h)))
    inner = [{p for p in found[k] if 60 <= p[0] <= 250} for k in range(3)]
    assert inner[0] and inner[0] == inner[1] == inner[2]


def test_remove_spans():
    assert repeats.remove_spans(b"0123456789", [(2, 4), (3, 6), (6, 7), (9, 10)]) == (b"01" + b"78", [(2, 7), (9, 10)])


def test_empty(empty):
    assert repeats.remove_repeats(empty).collect() == []
