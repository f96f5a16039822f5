"""Duplicate classes against a union-find over all pairs, with shards of large classes."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import duplicates as U

def rules():
    return [("phone", F.col("phone")), ("name", F.lower(F.trim("name")))]


def brute(rows):
    """id -> (rules, least id of its group), from all pairs of rows."""
    met, root = {}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            for rule, x, y in (("phone", a[1], b[1]), ("name", (a[2] or "").strip(" ").lower(), (b[2] or "").strip(" ").lower())):
                if a[0] != b[0] and x and x.strip() and x == y:
                    met.setdefault(a[0], set()).add(rule)
                    low, high = sorted((find(a[0]), find(b[0])))
                    root[high] = low
    return {i: (sorted(r), find(i)) for i, r in met.items()}


@pytest.mark.parametrize("shard_rows", [3, 100_000])
def test_members_equal_union_find(spark, shard_rows):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", " ", "1", *map(str, range(90))]), rng.choice([None, "", *(f"N{k} " for k in range(120))])) for i in range(150)]
    # A class of a third of the rows, and a chain that takes many steps to walk.
    rows += [(1000 + i, "hot", f"own {i}") for i in range(75)]
    rows += [(2000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(60)]
    random.Random(6).shuffle(rows)
    keys = U.duplicate_keys(spark.createDataFrame(rows, "id long, phone string, name string"), rules())
    got = U.duplicate_members(keys, U.duplicate_classes(keys), shard_rows).collect()
    assert {r.id: (r.rules, r.class_id) for r in got} == brute(rows)
    assert len(got) == len({r.id for r in got})


def test_summary_takes_the_best_row(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "a", "y", 3), (3, "b", "y", 3), (4, "z", "q", 9), (None, "a", "x", 10)], "id long, phone string, name string, s int")
    keys = U.duplicate_keys(df, rules())
    out = U.duplicate_summary(U.duplicate_members(keys, U.duplicate_classes(keys)), df, F.col("s"), ["phone", "name"]).collect()
    assert [tuple(r) for r in out] == [(1, 3, 2, 2, 2)]


def test_no_duplicates_and_no_rows(spark):
    for df in (spark.createDataFrame([(1, "a", "b"), (2, None, None)], "id long, phone string, name string"), spark.createDataFrame([], "id long, phone string, name string")):
        keys = U.duplicate_keys(df, rules())
        assert U.duplicate_members(keys, U.duplicate_classes(keys)).count() == 0


def test_connected_long_path(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = U.connected(links)
    assert out.count() == 401 and out.where("root <> 0").count() == 0
