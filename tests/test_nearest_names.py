"""The segment index of names loses no pair above the threshold and verifies few below it."""

import itertools
import random

import pytest

from lodestar.operators import curate as E


def pairs(spark, wanted, names, threshold):
    a = spark.createDataFrame([(n,) for n in wanted], "_a string")
    b = spark.createDataFrame([(n,) for n in names], "_b string")
    return {(r._a, r._b) for r in E.name_candidates(a, b, threshold).collect()}


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.95])
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(11)
    names = {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 24))) for _ in range(120)} | {"a" * n for n in range(1, 30)} | {"münchen süd", "日本語の名前", "x"}
    wanted = set()
    for n in sorted(names):
        for _ in range(2):
            t = list(n)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(t) + 1)
                t[k : k + 1] = rng.choice([[], ["x"], ["a", "b"], t[k : k + 2][::-1]])
            wanted.add("".join(t))
    wanted.discard("")
    found = pairs(spark, sorted(wanted), sorted(names), threshold)
    want = {(a, b) for a, b in itertools.product(wanted, names) if E.lcs_ratio(a, b) > threshold}
    assert want <= found and len(want) > 60


def test_candidates_are_few(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(200)]
    names = sorted({" ".join(rng.sample(words, 3)) for _ in range(500)})
    wanted = []
    for n in names[:150]:
        t = list(n)
        for _ in range(2):
            t[rng.randrange(len(t))] = "q"
        wanted.append("".join(t))
    found = pairs(spark, wanted, names, 0.85)
    matches = [1 for a, b in found if E.lcs_ratio(a, b) > 0.85]
    assert len(matches) >= 100 and len(found) <= 10 * len(matches)


def test_empty_tables(spark):
    assert pairs(spark, [], ["a"], 0.85) == set() == pairs(spark, ["a"], [], 0.85)
