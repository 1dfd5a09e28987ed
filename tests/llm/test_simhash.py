import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import sentence
from mediadate.llm import components, simhash
from mediadate.llm.common import join_lookup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, shingle=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    """Smallest id (null last) reachable over links, per row."""
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance:
                parent[find(i)] = find(j)
    low = {}
    for k, (doc, _) in enumerate(prints):
        low[find(k)] = min((x for x in (doc, low.get(find(k))) if x is not None), default=None)
    return [low[find(k)] for k in range(len(prints))]


def test_fingerprints_match_spark_hash(spark):
    row = spark.sql("select xxhash64('the of and Größe') as h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("the of and Größe".encode(), 42)


def test_groups(docs, rows):
    prints = [(row[0], brute_fingerprint(row[1])) for row in rows]
    groups = brute_components(prints, 4)
    got = simhash.near_duplicate_groups(docs).collect()
    want = Counter((doc, value, low) for (doc, value), low in zip(prints, groups))
    assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got) == want


@pytest.mark.parametrize("parts", [simhash.THREE_PARTS, simhash.TWO_PARTS])
@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_every_link_meets(parts, distance):
    rng = np.random.default_rng(distance)
    x = rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64)
    flips = [sum(1 << int(b) for b in rng.choice(64, distance, replace=False)) for _ in x]
    y = (x.view(np.uint64) ^ np.array(flips, np.uint64)).view(np.int64)
    (ax, ox, hx), (ay, oy, hy) = (simhash.anchor_copies(v, parts, distance) for v in (x, y))
    pairs = lambda a, o, keep: set(zip(a[keep].tolist(), o[keep].tolist()))
    every = np.ones(len(ax), bool), np.ones(len(ay), bool)
    met = (pairs(ax, ox, hx) & pairs(ay, oy, every[1])) | (pairs(ax, ox, every[0]) & pairs(ay, oy, hy))
    assert {o for _, o in met} == set(range(200))


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = random.Random(3)
    center = rng.getrandbits(63)
    values = {center}
    for _ in range(400):
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(60)))
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.fingerprint_links(frame, 4)).collect()}
    want = brute_components([(v, v) for v in values], 4)
    assert [roots.get(v, v) for v in values] == want


def test_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(7, 7), (2000, None)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert all(roots[k] == 0 for k in range(301)) and all(roots[k] == 1000 for k in range(1000, 1400))


def test_one_of_each_group_stays(docs, rows):
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    prints = [(row[0], brute_fingerprint(row[1])) for row in rows]
    named = brute_components(prints, 4)
    numbered = brute_components([(k, value) for k, (_, value) in enumerate(prints)], 4)  # an id can be in two groups
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(doc for doc, _ in set(zip(named, numbered)))


def test_copies_are_taken_out(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 120) for _ in range(30)]
    rows = [(k, texts[k % 30]) for k in range(300)]
    kept = simhash.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_empty(empty):
    assert simhash.near_duplicate_groups(empty).collect() == []
    assert simhash.keep_one_of_each_group(empty).collect() == []


def test_hot_fingerprint_is_spread(spark, monkeypatch):
    """Two thirds of the rows have one text; with tables too large to send, its rows meet their label in many tasks."""
    monkeypatch.setattr("mediadate.llm.simhash.join_lookup", lambda *a, **k: join_lookup(*a, **{**k, "at_most": 0}))
    rows = [(k, "one text that many rows have in common" if k % 3 else f"text {k} of its own") for k in range(3000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        groups = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
        sizes = [len(part) for part in groups.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 3000 and max(sizes) <= 1500
