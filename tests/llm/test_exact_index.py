import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import ordered
from mediadate.llm import exact_index, registry
from pyspark.sql import functions as F


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    for text, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        stays = [x == keep for x in ids]
        stays = [s and not any(stays[:k]) for k, s in enumerate(stays)]
        for doc, kept in zip(ids, stays):
            yield doc, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()


def compare(got, rows):
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == Counter(brute(rows))


def test_groups(docs, rows):
    compare(exact_index.exact_groups(docs).collect(), rows)


def test_query(spark, folder, rows):
    compare(registry.op12_exact_groups(spark, folder).collect(), rows)


def test_empty(empty):
    assert exact_index.exact_groups(empty).collect() == []


# Keys: all texts in one chain; a few keys with long chains; keys that share many leading bits.
KEYS = {
    "one": lambda text: F.length(text) * 0 + F.lit(7).cast("long"),
    "few": lambda text: F.xxhash64(F.length(text) % 5),
    "close": lambda text: F.shiftrightunsigned(F.xxhash64(text), 12),
}


@pytest.mark.parametrize("name", KEYS)
def test_chains_and_splits(spark, monkeypatch, name):
    monkeypatch.setattr(exact_index, "BUCKET", 3)
    monkeypatch.setattr(exact_index, "BLOCK_BYTES", 40)
    monkeypatch.setattr(exact_index, "FILE_BYTES", 100)
    monkeypatch.setattr(exact_index, "CACHED_BYTES", 60)
    monkeypatch.setattr(exact_index, "COMBINED_BYTES", 2000)
    rows = [(k, f"text {k % 97} " + "x" * (k % 13)) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    compare(exact_index.exact_groups(docs, KEYS[name]).collect(), rows)


def test_directory_doubles(monkeypatch, tmp_path):
    monkeypatch.setattr(exact_index, "BUCKET", 4)
    index = exact_index.ExtendibleIndex(1, exact_index.TextHeap(str(tmp_path / "a")))
    keys = [k << 55 for k in range(200)]
    for key in keys:
        index.add(key, str(key).encode(), 1, 1, 1)
    assert len(index.directory) == 1 << index.depth and index.depth > 4
    assert all(len(bucket.chains) <= 4 for bucket in index.directory)
    assert all(key in index.directory[index._slot(key)].chains for key in keys)
    spans = Counter(map(id, index.directory))
    assert all(spans[id(bucket)] == 1 << (index.depth - bucket.depth) for bucket in index.directory)


def test_find_texts(spark, docs, rows):
    files = exact_index.build_index(docs, 1 << 20)
    texts = [None, "", "a", "never seen", rows[8][1], rows[8][1] + " "]
    asked = spark.createDataFrame([(k, text, 5) for k, text in enumerate(texts)], "n int, text string, key int")
    known = {doc_text or "" for _, doc_text, *_ in rows}
    sizes = Counter(text or "" for _, text, *_ in rows)
    got = exact_index.find_texts(asked, files, "long").collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["n"]] or ""
        assert r["found"] == (text in known) and r["copies"] == (sizes[text] or None)
    none = exact_index.build_index(docs.limit(0), 0)
    assert ordered(r["found"] for r in exact_index.find_texts(asked, none, "long").collect()) == [False] * len(texts)


def test_hot_text_is_combined(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    compare(exact_index.exact_groups(docs).collect(), rows)
