"""Completions through the prefix table equal a scan of all entries."""

import random

from lodestar.operators import completion as C


def brute(prefixes, entries, caps, total):
    weights = {}
    for kind, text, w in entries:
        if text and text.strip():
            weights[kind, text] = weights.get((kind, text), 0.0) + (w or 0.0)
    out = []
    for i, p in prefixes:
        p, found = p.lower().lstrip(" "), []
        for o, kind in enumerate(caps):
            hits = sorted((-w, t) for (k, t), w in weights.items() if k == kind and len(t.strip()) >= C.LEAST <= len(p) and t.lower().strip(" ").startswith(p))
            found += [(o, w, t, kind) for w, t in hits[: caps[kind]]]
        out += [(i, kind, t, -w, r + 1) for r, (_, w, t, kind) in enumerate(sorted(found)[:total])]
    return sorted(out)


def test_completions_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 16))) for _ in range(300)] + ["Food bank calgary north", "food Bank calgary", None, " "]
    entries = [(rng.choice(["item", "popular", "other"]), t, rng.choice([None, 1.0, 2.0, 5.0])) for t in texts * 2]
    prefixes = list(enumerate(["a", "ab", "AB", "abc", " ba", "food bank calg", "food bank calgary n", "zz", "", "c ", "bb"]))
    caps = {"popular": 3, "item": 4}
    e = C.prefix_entries(spark.createDataFrame(entries, "kind string, text string, weight double"))
    table = C.prefix_table(e, 4)
    got = C.complete(spark.createDataFrame(prefixes, "prefix_id int, text string"), e, table, caps)
    assert sorted(map(tuple, got.select("prefix_id", "kind", "text", "weight", "rank").collect())) == brute(prefixes, entries, caps, 7)
    plan = table._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # a limit in every task, then one after the shuffle
    assert C.complete(spark.createDataFrame(prefixes, "prefix_id int, text string").limit(0), e, table, caps).count() == 0
    assert C.prefix_entries(e.select("kind", "text", "weight"), ["food"]).where("_t LIKE '%food%'").count() == 0
