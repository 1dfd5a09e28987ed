import hashlib
import re
from collections import Counter, defaultdict

from mediadate.llm import decontamination, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    windows = defaultdict(set)
    for item, own in items:
        own = words(own)
        for k in range(max(1, len(own) - 12) if own else 0):
            windows[tuple(own[k : k + 13])].add("" if item is None else str(item))
    mine, hit, found = words(text), set(), set()
    for size in {len(w) for w in windows}:
        for k in range(len(mine) - size + 1):
            if tuple(mine[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found |= windows[tuple(mine[k : k + size])]
    return len(mine), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(mine)


def test_query(spark, folder, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = registry.op6_decontaminate(spark, folder).collect()
    want = Counter((row[0], *brute(row[1], items)) for row in rows)
    assert Counter(tuple(r[n] for n in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == want
    assert any(r["n_hit"] for r in got)


def test_spans_lie_in_the_original(spark):
    item = "Wie GROß ist, der See; am Rande des alten Waldes nördlich der Stadt heute?"
    text = "Ärger! → wie groß ist -- der see am rande DES alten waldes nördlich der stadt 'heute' ja"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = decontamination.scan_documents(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert found["items"] == ["9"]
    cut = [text[s["start"] : s["end"]] for s in found["spans"]]
    assert cut[0].startswith("wie groß ist") and cut[-1].endswith("heute") and found["n_hit"] == 14


def test_chunks_and_columns(docs, rows, spark, monkeypatch):
    items = spark.createDataFrame([(k, f"the of {w}") for k, w in enumerate(["and", "tion", "end", "x1"])], "item_id long, text string")
    whole = decontamination.scan_documents(docs, items, prefix="_p_")
    assert whole.columns == [*docs.columns, "_p_n_words", "_p_n_hit", "_p_items", "_p_spans"]
    once = Counter((r["doc_id"], r["_p_n_hit"], tuple(r["_p_items"])) for r in whole.collect())
    monkeypatch.setattr(decontamination, "CHUNK", 1)
    parts = decontamination.scan_documents(docs, items, prefix="_p_").collect()
    assert Counter((r["doc_id"], r["_p_n_hit"], tuple(r["_p_items"])) for r in parts) == once
    clean = decontamination.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not (r["_p_n_hit"] and 20 * r["_p_n_hit"] >= r["_p_n_words"]) for r in parts)


def test_empty(empty, docs, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan_documents(empty, items).collect() == []
    assert all(r["n_hit"] == 0 for r in decontamination.scan_documents(docs, items).collect())
