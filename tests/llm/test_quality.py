import re
from collections import Counter

from mediadate.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(docs, rows):
    got = quality.judge_documents(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter((row[0], *brute(row[1])) for row in rows)
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == want
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_host_verdict_is_shrunk(spark):
    good = " ".join(f"word{k} other{k}" for k in range(60))
    odd = " ".join(f"word{k} ##{k}" for k in range(60))
    rows = [(f"good{h}", good) for h in range(30) for _ in range(40)]
    rows += [("poor", odd)] * 60 + [("poor", good)] * 10 + [("tiny", odd)]
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    verdicts = {r["host"]: r for r in quality.judge_documents(docs).select("host", "host_poor", "host_rate").distinct().collect()}
    assert verdicts["poor"]["host_poor"] and not verdicts["tiny"]["host_poor"]
    assert 0 < verdicts["tiny"]["host_rate"] < 0.5
    kept = Counter(r["source"] for r in quality.keep_good(docs).collect())
    assert kept["poor"] == 10 and kept["tiny"] == 1 and kept["good0"] == 40


def test_keep_good_returns_the_columns(docs, rows):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = sum(r["kept"] for r in quality.judge_documents(docs).collect())
    assert kept.count() == want


def test_no_python_in_the_plan(docs):
    plan = quality.judge_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_prior_without_spread():
    assert quality.beta_prior(0, 0, 0, 0.0, 0.0) == (0.0, 5.0)
    mean, strength = quality.beta_prior(10, 1000, 100, 10.0, 100_000.0)
    assert mean == 0.1 and strength == 1e6


def test_empty(empty):
    assert quality.judge_documents(empty).collect() == []
    assert quality.keep_good(empty).collect() == []
