"""Distributed naming against serving the requests one by one."""

import random
from pathlib import PurePosixPath

import pytest

from mediadate.operators.naming import unique_destination

REQUESTS = "id long, folder string, name string"


def one_by_one(requests, existing):
    taken, answer = set(existing), {}
    for key, folder, name in sorted(requests):
        wish, number = name, 0
        while (folder, wish) in taken:
            number += 1
            path = PurePosixPath(name)
            wish = f"{path.stem} ({number}){path.suffix}"
        taken.add((folder, wish))
        answer[key] = wish
    return answer


def served(spark, requests, existing, bits):
    frame = spark.createDataFrame(requests, REQUESTS)
    taken = None if existing is None else spark.createDataFrame(existing, "folder string, name string")
    named = unique_destination(frame, taken, block_bits=bits)
    rows = named.collect()
    assert len(rows) == len(requests)
    return {r.id: r.dest_name for r in rows}


@pytest.mark.parametrize("bits", [2, 20])
def test_plain_names(spark, bits):
    rng = random.Random(bits)
    requests = [(i * 3, rng.choice("ab"), rng.choice(["x.jpg", "y.jpg", ".jpg", "file", "a.tar.gz"])) for i in range(200)]
    assert served(spark, requests, None, bits) == one_by_one(requests, [])


@pytest.mark.parametrize("bits, seed", [(2, 1), (20, 4)])
def test_mixed_names(spark, bits, seed):
    rng = random.Random(seed)

    def any_name():
        tail = "".join(f" ({rng.randint(0, 4)})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))
        return rng.choice("pq") + tail + rng.choice([".jpg", ".jpg", ""])

    # many small folders, so that one run holds many independent cases
    requests = [(i, f"f{rng.randint(0, 60)}", any_name()) for i in range(1500)]
    existing = [(f"f{rng.randint(0, 60)}", any_name()) for _ in range(150)]
    assert served(spark, requests, existing, bits) == one_by_one(requests, existing)


def test_literal_number_between_copies(spark):
    requests = [(1, "f", "a.jpg"), (2, "f", "a (1).jpg"), (3, "f", "a.jpg"), (4, "f", "a (3).jpg"), (5, "f", "a.jpg")]
    found = served(spark, requests, None, 20)
    assert found[3] == "a (2).jpg" and found == one_by_one(requests, [])


def test_one_name_holds_most_rows(spark):
    requests = [(i, "f", "IMG_0001.jpg" if i % 3 else f"IMG_0001 ({i}).jpg") for i in range(900)]
    existing = [("f", f"IMG_0001 ({i}).jpg") for i in range(1, 300, 7)]
    assert served(spark, requests, existing, 4) == one_by_one(requests, existing)


def test_one_numbered_family_holds_most_rows(spark):
    """Numbers asked for by name, before and after the overflow reaches them, on two levels; no pandas in the plan."""
    rng = random.Random(8)
    requests = []
    for i in range(1200):
        tail = f" ({rng.randint(1, 500)})" if rng.random() < 0.5 else ""
        requests.append((i, "f", f"IMG_0001{tail}{tail if rng.random() < 0.2 else ''}.jpg"))
    existing = [("f", f"IMG_0001 ({i}).jpg") for i in range(1, 300, 7)]
    assert served(spark, requests, existing, 4) == one_by_one(requests, existing)
    named = unique_destination(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(existing, "folder string, name string"))
    assert "Pandas" not in named._jdf.queryExecution().toString()
