import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from mediadate.llm import conversations as C
from mediadate.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, block long, kind string"
WORDS = ["One.", "two", "what?", "", " \t", "four!", "end . ", None, "é.x", "a" * 70_000 + "."]
PATTERN = re.compile(r"(s?(ua)+)?")


def make_rows(seed=5, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = rng.choice(["tool", None, "", "usher", "Ünd"]) if rng.random() < 0.06 else role
            rows.append((conv, rng.choice([turn, turn, turn, turn * 700, None]), role, rng.choice(WORDS), 1, "x"))
    rows += rows[7:9]
    return rows


def damaged(rows):
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        fault = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        for _ in range(0 if fault == 0 else 2 if fault == 3 else 1):
            yield conv, turn, "user" if fault == 4 else role, text


def least(rows):
    """Cost and audit by trying all edits, state by state; rows are (dead, truncated, initial)."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "")}

    def settle(found):
        for _ in range(4):
            for state, (cost, audit) in list(found.items()):
                goal, new = follow[state], (cost + 3, audit + "I")
                if goal not in found or new < found[goal]:
                    found[goal] = new
        return found

    for dead, truncated, initial in rows:
        found = {}
        for state, (cost, audit) in settle(best).items():
            options = [(state, 4, "D")]
            if not dead:
                more, goal = 3 * truncated, follow[state]
                options.append((goal, 3 + more, "R"))
                if initial == ("a" if goal == 3 else "u"):
                    options.append((goal, more, "K"))
                if initial == "s" and state == 0:
                    options.append((1, more, "K"))
            for goal, step, edit in options:
                new = cost + step, audit + edit
                if goal not in found or new < found[goal]:
                    found[goal] = new
        best = found
    return min(found for state, found in settle(best).items() if state in (0, 3))


def tie_order(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, hashlib.sha256(text.encode()).digest()[:16], role


def brute(rows, known):
    groups = {conv: [] for conv in known}
    for row in rows:
        groups[row[0]].append(row)
    for conv, own in groups.items():
        own.sort(key=tie_order)
        turns = [turn for _, turn, *_ in own if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts, symbols = set(), Counter(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((fault in ("blank", "duplicate"), fault == "truncated", role[:1]))
        illegal = sum(a[2] + b[2] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        cost, audit = least(symbols)
        repaired = [f"{role}:{text}" for _, role, text in apply(audit, own)]
        assert PATTERN.fullmatch("".join(line[:1] for line in repaired))
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        yield conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def apply(audit, own):
    last, rows = "", iter(own)
    for edit in audit:
        _, _, role, text = (0, 0, "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        yield edit, role, text
    assert next(rows, None) is None


def compare(got, want):
    names = ("conv_id", *C.SUMMARY, "audit", "repaired_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)


@pytest.fixture(scope="module")
def talk(spark):
    rows = make_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_repair_of_damaged_rows(talk):
    rows, frame = talk
    got = C.digest_repaired(C.repair_conversations(C.damage(frame), known=frame)).collect()
    compare(got, brute(damaged(rows), {row[0] for row in rows}))


def test_query_and_sql(spark, talk, tmp_path):
    import duckdb

    _, frame = talk
    frame.where("turn is not null").dropDuplicates(["conv_id", "turn"]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.op13_repair_conversations(spark, str(tmp_path)).collect()
    base = duckdb.connect()
    base.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    compare(got, base.execute(registry.SQL["op13_repair_conversations"]).fetchall())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.digest_repaired(C.repair_conversations(C.damage(none), known=none)).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "so"), (2, 5, "assistant", "Yes.")]
    got = C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in got if r["place"]) == [
        (1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "so"), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Yes."),
    ]
    assert {r["conv_id"]: (r["audit"], r["cost"], r["gaps"]) for r in got if not r["place"]} == {1: ("KDR", 10, 0), 2: ("IK", 3, 0)}


@pytest.mark.parametrize("group", [8, 1 << 12])
def test_long_conversation_in_blocks(spark, monkeypatch, group):
    """Half of the rows in one conversation, a part of them without turns; blocks are cut further if they are large."""
    monkeypatch.setattr(C, "GROUP_ROWS", group)
    monkeypatch.setattr(C, "TASK_SYMBOLS", 300)
    monkeypatch.setattr(C, "LOOKUP_BYTES", 10)
    rng = random.Random(1)
    rows = [(7, rng.choice([None, k, k, k]), rng.choice(["user", "assistant"]), f"text {rng.randrange(900)}" + rng.choice(".?  ")) for k in range(3000)]
    rows += [(k, 0, "user", "same.") for k in range(1000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = C.digest_repaired(C.repair_conversations(frame)).collect()
    compare(got, brute(rows, {row[0] for row in rows}))


def test_grammar_is_lossless_and_leaves_no_repeated_pair():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 3, rng.integers(1, 60)) for _ in range(80)] + [np.zeros(50, np.int64)]
    rules, written = C.re_pair(sequences, 9)

    def expand(symbol):
        return [symbol] if symbol < 9 else [x for side in rules[symbol - 9] for x in expand(side)]

    assert [[x for s in one for x in expand(s)] for one in written] == [one.tolist() for one in sequences]
    assert sum(map(len, written)) < sum(map(len, sequences)) / 3
    pairs = Counter(pair for one in written for pair in itertools.pairwise(one.tolist()))
    assert all(count < 2 for (a, b), count in pairs.items() if a != b)


def test_matrices_equal_the_plain_program():
    rng = random.Random(4)
    blocks = ["".join(rng.choice(C.SYMBOLS) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for block, matrix in zip(blocks, C.block_matrices(blocks)):
        whole = C.Conversation()
        whole.vector = C.product(whole.vector, C.unpack(C.pack(matrix)))
        told = whole.finish()
        assert (told["cost"], told["audit"]) == least([(c == "d", c.isupper(), c.lower()) for c in block])


def test_ropes_compare_like_texts():
    rng = random.Random(6)
    for _ in range(300):
        ropes = [rng.choice("DIKR") * rng.randint(1, 40) for _ in range(6)]
        one, two = ropes[0], ropes[0]
        for part in ropes[1:]:
            one = C.joined(one, part)
            two = C.joined(two, rng.choice([part, part, "K"]))
        assert C.before(one, two) == (C.flat(one) < C.flat(two))
