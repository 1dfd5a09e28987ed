import hashlib
import re
from collections import Counter

import pytest
from mediadate.llm import registry, secret_scan

NAME = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KEY = "AKIA" + "Q7" * 8
CASES = [
    None, "", "no secret here", 'Token="abc123" and secret : xyz', "PASSWORD=pw token=short", "api-key=abcdef api_key = 'abcdef'",
    "secret:token:abcdefgh", "😀 token= abcdefg 😀 " + "0f" * 14 + " é " + KEY, KEY + KEY, "AKIAAKIA" + "A" * 14, "f" * 23 + " " + "f" * 24,
    "x" * 300 + " password = hunter22 " + "y" * 300, "token=abcdefg " * 700,
]


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    named = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = Counter(k for _, k, _ in spans)
    return counts[0], counts[1], counts[2], hashlib.sha256(named.encode()).hexdigest()


def digest(spark, folder, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return {r["doc_id"]: r for r in registry.op3_secret_scan(spark, str(folder)).collect()}


def test_base_spans(spark, tmp_path):
    got = digest(spark, tmp_path, CASES)
    for k, text in enumerate(CASES):
        assert tuple(got[k][n] for n in ("n_assign", "n_access", "n_hex", "base_sha256")) == brute(text), text


def test_query_on_hard_rows(spark, folder, rows):
    got = registry.op3_secret_scan(spark, folder).collect()
    want = Counter((row[0], *brute(row[1])) for row in rows)
    assert Counter(tuple(r[n] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in got) == want


BARE = "Zx9Kq2LmN8vT4rW7yB3c"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"deploy with {BARE} today", []),
        (f"user: alice then {BARE}", ["identifier", "secret"]),
        (f"user: alice {'-' * 500} {BARE}", []),
        (f"see https://db.example.com/x {BARE}", []),
        (f"https://db.example.com login=bob {BARE}", ["endpoint", "identifier", "secret"]),
        ("login=bob and https://db.example.com", []),
        (f"{KEY} {BARE}", ["access", "secret"]),
        ("token=abcdefgh user=carol", ["assign", "identifier"]),
        (f"{BARE} {BARE}", []),
    ],
)
def test_weak_parts_need_their_complement(spark, tmp_path, text, kinds):
    spans = digest(spark, tmp_path, [text])[0]["spans"]
    assert [span.split(":")[0] for span in spans.split(",") if span] == kinds


def test_dense_text_makes_no_pairs(spark, tmp_path):
    text = " ".join(f"user=n{k:05} {BARE}{k:05}" for k in range(1500))
    spans = digest(spark, tmp_path, [text, text])
    for k in (0, 1):
        kinds = Counter(span.split(":")[0] for span in spans[k]["spans"].split(","))
        assert kinds == {"identifier": 1500, "secret": 1500}


def test_no_python_in_the_plan(docs):
    plan = secret_scan.scan_secrets(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert secret_scan.scan_secrets(empty).collect() == []
