"""Vector search in blocks and through cells, against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import vectors as X
from lodestar.plans.catalogue import QUERIES


def brute(queries, items, n, threshold):
    out = []
    for q, u in queries:
        scored = []
        for i, v in items:
            if i is None or v is None or len(u) != len(v) or not any(v) or not any(u):
                continue
            s = round(float(np.dot(np.float64(u), np.float64(v)) / np.linalg.norm(np.float64(u)) / np.linalg.norm(np.float64(v))), 6)
            if s > threshold:
                scored.append((-s, i))
        out += [(q, i, -s) for s, i in sorted(scored)[:n]]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(12, 8))
    items = [(i, (near[i % 12] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    same = [(1000 + i, items[0][1]) for i in range(60)]  # a third of the table is alike soon enough: ties end in the id
    odd = [(2000, [0.0] * 8), (2001, None), (None, items[1][1]), (2002, [1.0, 2.0])]
    asked = [(i, items[i][1]) for i in range(0, 400, 20)] + [(5000, [0.0] * 8), (5001, [2.0, 1.0])]
    frame = spark.createDataFrame(items + same + odd, "id long, embedding array<double>")
    return asked, items + same + odd, spark.createDataFrame(asked, "query_id long, vector array<double>"), frame


@pytest.mark.parametrize("rows", [20_000, 37])
def test_exact_search_equals_brute_force(vectors, monkeypatch, rows):
    monkeypatch.setattr(X, "PIECE_ROWS", rows)
    monkeypatch.setattr(X, "BLOCK_ROWS", max(7, rows // 100))
    asked, items, q, frame = vectors
    got = sorted((r.query_id, r.item_id, r.score) for r in X.exact_search(q, frame, 0.3, 15).collect())
    want = brute(asked, items, 15, 0.3)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_index_finds_what_the_exact_search_finds(vectors, monkeypatch, spark, tmp_path):
    monkeypatch.setattr(X, "PIECE_ROWS", 25)
    asked, items, q, frame = vectors
    index = X.VectorIndex.build(frame, X.fit_centres(frame, cells=12))
    assert index.rows.count() == 460  # every usable item, however common its cell
    exact = X.exact_search(q.where("query_id <> 5001"), frame, 0.3, 10)
    assert X.recall(X.index_search(q, index, 12, 0.3, 10), exact) == 1.0  # all cells: exact
    probes = X.probes_for(q.where("query_id <> 5001"), index, 0.97, 0.3, 10)
    assert probes < 6 and X.recall(X.index_search(q, index, probes, 0.3, 10), exact) >= 0.95
    index.save(str(tmp_path / "index"))
    again = X.VectorIndex.load(spark, str(tmp_path / "index"))
    assert X.recall(X.index_search(q, again, probes, 0.3, 10), X.index_search(q, index, probes, 0.3, 10)) == 1.0
    one = again.rows.where("cell = 3")
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString()  # a probe reads its cells only


def test_recall_on_the_given_vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    asked = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert X.recall(QUERIES["vector_topk"](spark, sf_dir), X.exact_search(asked, e, 0.1)) >= 0.95


def test_no_nested_loop_and_empty_tables(vectors):
    _, _, q, frame = vectors
    plan = X.exact_search(q, frame)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = frame.limit(0)
    assert X.exact_search(q, none).count() == 0 and X.exact_search(q.limit(0), frame).count() == 0
    centres = X.fit_centres(none)
    assert X.index_search(q, X.VectorIndex.build(none, centres), X.probes_for(q, X.VectorIndex.build(none, centres))).count() == 0


def test_memory_of_a_task_does_not_grow_with_its_queries():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"item_id": np.arange(20_000), "_v": list(rng.normal(size=(20_000, 16)))})

    def peak(n):
        queries = rows.head(n).rename(columns={"item_id": "query_id"})
        tracemalloc.start()
        found = X.best_pairs(queries, rows, 5, 0.1)
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, size

    few, small = peak(100)
    many, large = peak(2_000)
    assert large < small + 8e6 and many.query("query_id < 100").equals(few)
    assert (many.groupby("query_id").size() == 5).all() and len(many) == 10_000
