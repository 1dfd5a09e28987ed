import re
from collections import Counter, defaultdict

from conftest import ordered
from mediadate.llm import mixing
from mediadate.llm.registry import source_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def count(text):
    return len(WORD.findall(text or ""))


def expected_targets(sizes, weights, share, most):
    targets, open_ = {}, dict(weights)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * level >= most * sizes[s]]
        if not full:
            return targets | {s: w * level for s, w in open_.items()}
        for s in full:
            targets[s] = most * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def test_targets_and_copies(docs, rows):
    mixed = mixing.mix_documents(docs, source_weights(docs)).collect()
    sizes, taken = Counter(), Counter()
    for row in rows:
        sizes[row[3]] += count(row[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = expected_targets(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, 1.5, 2)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in mixed) == Counter((row[0], row[3], count(row[1])) for row in rows)
    for r in mixed:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert taken[source] <= target + 1e-6
    again = mixing.mix_documents(docs.repartition(2), source_weights(docs)).collect()
    assert ordered(map(tuple, again)) == ordered(map(tuple, mixed))


def test_many_documents_come_near(spark):
    rows = [(k, "w " * (1 + k * 7919 % 300), f"s{k % 4}" if k % 3 else "s0") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix_documents(docs, source_weights(docs)).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.005 * t for s, t in target.items())


def test_ranks_follow_the_odds(spark):
    """Pareto order sampling: heavier documents are in the sample more often, as their chances say."""
    rows = [(k, "w " * 10, "s", 1.0 if k % 2 else 3.0) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    weights = spark.createDataFrame([("s", 1)], "source string, weight int")
    mixed = mixing.mix_documents(docs, weights, share=0.4, weight_column="quality").collect()
    share = defaultdict(list)
    for r in mixed:
        share[r["doc_id"] % 2].append(r["copies"])
    light, heavy = (sum(share[k]) / len(share[k]) for k in (1, 0))
    assert abs(light - 0.2) < 0.03 and abs(heavy - 0.6) < 0.03


def test_weights_beyond_the_limit_are_certain(spark):
    rows = [(k, "w w", "s", 100.0 if k < 5 else 1.0) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    weights = spark.createDataFrame([("s", 1)], "source string, weight int")
    mixed = mixing.mix_documents(docs, weights, share=0.5, weight_column="quality").collect()
    assert all(r["copies"] == 2 for r in mixed if r["doc_id"] < 5)
    assert abs(sum(r["taken"] for r in mixed) - 200) <= 4


def test_repeat_documents(docs, rows):
    out = mixing.repeat_documents(docs, source_weights(docs))
    assert out.columns == docs.columns
    mixed = mixing.mix_documents(docs, source_weights(docs)).collect()
    want = Counter()
    for r in mixed:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], count(r["text"])) for r in out.collect())
    assert +want == got


def test_empty(empty):
    assert mixing.mix_documents(empty, source_weights(empty)).collect() == []
