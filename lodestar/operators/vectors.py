"""Nearest vectors by cosine: exact in blocks, or through a stored index of cells.

Exact search compares a stated set of queries with all items. Both sides are dealt into pieces of bounded size by a hash of their ids, every
pair of pieces meets in one task as a matrix product, and each task hands on the best n items of each of its queries only.

The index deals items to the cell of their nearest centre; a query probes the cells whose centres are nearest to it. Centres are fitted on a
bounded sample, every item is indexed. How many cells a query must probe depends on the data (vectors without structure need most of them),
so ``probes_for`` measures it: the least number that finds a wanted share of the exact results of a few queries. A cell that holds very
many items is cut into pieces as well, so a common vector makes no large task.

Items and queries without an id, without a vector, or with a vector of length zero take no part. Vectors meet those of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.common import top

#: Rows of one piece of items and of one block of queries, and the scores that a task holds at a time.
PIECE_ROWS, BLOCK_ROWS = 20_000, 2_000
SCORES = 500_000
#: Rows that centres are fitted on, the most centres, and queries that the number of probes is measured on.
SAMPLE_ROWS, MAX_CELLS, SAMPLE_QUERIES = 20_000, 1024, 64


def _usable(df: DataFrame, key: str, vector: str, new: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return df.select(F.col(key).alias(new), v.alias("_v")).where(F.col(new).isNotNull() & (squares > 0))


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def best_of(scores: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n best scores above the threshold in each row; of equal scores the first columns."""
    if scores.shape[1] > n:
        last = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
        more, equal = scores > last, scores == last
        keep = more | (equal & (np.cumsum(equal, axis=1) <= n - more.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & (scores > threshold))


def best_pairs(queries: pd.DataFrame, rows: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """(query_id, item_id, score) of the n best items of each query, from vectors _v; SCORES scores at a time."""
    rows = rows.sort_values("item_id", kind="stable")
    asked_ids, item_ids, q, i = queries["query_id"].to_numpy(), rows["item_id"].to_numpy(), _matrix(queries["_v"]), _matrix(rows["_v"]).T
    step, parts = max(1, SCORES // len(rows)), []
    for k in range(0, len(q), step):
        scores = np.round(q[k : k + step] @ i, 6)
        r, c = best_of(scores, n, threshold)
        parts.append(pd.DataFrame({"query_id": asked_ids[k + r], "item_id": item_ids[c], "score": scores[r, c]}))
    return pd.concat(parts, ignore_index=True)


def _meet(asked: DataFrame, items: DataFrame, keys: list[str], n: int, threshold: float) -> DataFrame:
    """Best n of each group of queries (query_id, _v) and items (item_id, _v), then the best of all groups."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((asked, "query_id"), (items, "item_id"))]

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        return best_pairs(queries, rows, n, threshold)

    found = asked.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(best, ", ".join([*kinds, "score double"]))
    return top(found, ["query_id"], [F.desc("score"), F.col("item_id")], n)


def _pieces(key: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n) if isinstance(n, int) else n).cast("int")


def exact_search(query_vectors: DataFrame, items: DataFrame, threshold: float = 0.3, n: int = 20, key: str = "id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the n items of greatest cosine above the threshold for each of (query_id, vector).

    block: queries of one task, BLOCK_ROWS by default.
    """
    q, i = _usable(query_vectors, "query_id", "vector", "query_id"), _usable(items, key, vector, "item_id")
    blocks, pieces = (max(1, -(-df.count() // rows)) for df, rows in ((q, block or BLOCK_ROWS), (i, PIECE_ROWS)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = q.withColumn("_block", _pieces("query_id", blocks)).withColumn("_piece", every(pieces))
    i = i.withColumn("_piece", _pieces("item_id", pieces)).withColumn("_block", every(blocks))
    return _meet(q.withColumn("_size", F.size("_v")), i.withColumn("_size", F.size("_v")), ["_size", "_piece", "_block"], n, threshold)


def fit_centres(items: DataFrame, key: str = "id", vector: str = "embedding", cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means on at most SAMPLE_ROWS items, chosen by a hash of their ids.

    cells: by default the square root of the number of items, MAX_CELLS at most.
    """
    rows = _usable(items, key, vector, "item_id")
    total, size = rows.agg(F.count("*"), F.mode(F.size("_v"))).first()
    if not total:
        return np.zeros((0, 0))
    sample = rows.where(F.size("_v") == size).orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE_ROWS).toPandas()
    x = _matrix(sample["_v"])
    k = min(len(x), cells or max(1, min(MAX_CELLS, int(total**0.5))))
    centres = x[:k].copy()  # the sample is in the order of a hash, so its beginning is a sample too
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


@dataclass
class VectorIndex:
    """Every item (item_id, _v, cell) with the centre of its cell nearest to it."""

    centres: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, items: DataFrame, centres: np.ndarray, key: str = "id", vector: str = "embedding") -> VectorIndex:
        rows = _usable(items, key, vector, "item_id")
        return cls(centres, rows.where(F.size("_v") == centres.shape[1]).withColumn("cell", _cells(centres, 1)("_v")[0]))

    def save(self, path: str) -> None:
        """Items by cell, so that probes read the folders of their cells only, and the centres beside them."""
        self.rows.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/items")
        self.rows.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"]
        return cls(np.stack(centres.to_numpy()), spark.read.parquet(f"{path}/items"))


def _cells(centres: np.ndarray, n: int):
    """The n nearest cells of a vector, nearest first."""
    n = min(n, len(centres))

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            scores = _matrix(vectors) @ centres.T
            yield pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)), index=vectors.index)

    return nearest


def index_search(query_vectors: DataFrame, index: VectorIndex, probes: int, threshold: float = 0.3, n: int = 20) -> DataFrame:
    """As exact_search, among the items of the ``probes`` nearest cells of each query. All cells give the exact result."""
    q = _usable(query_vectors, "query_id", "vector", "query_id").where(F.size("_v") == index.centres.shape[1])
    asked = q.withColumn("cell", F.explode(_cells(index.centres, probes)("_v")))
    # One row per cell: bounded by the number of centres.
    sizes = F.broadcast(index.rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("_pieces")))
    loads = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = asked.join(sizes, "cell").join(loads, "cell").withColumn("_block", _pieces("query_id", F.col("_blocks"))).withColumn("_piece", every("_pieces"))
    items = index.rows.join(sizes, "cell").join(loads, "cell").withColumn("_piece", _pieces("item_id", F.col("_pieces"))).withColumn("_block", every("_blocks"))
    return _meet(asked.select("query_id", "_v", "cell", "_piece", "_block"), items.select("item_id", "_v", "cell", "_piece", "_block"), ["cell", "_piece", "_block"], n, threshold)


def probes_for(query_vectors: DataFrame, index: VectorIndex, share: float = 0.97, threshold: float = 0.3, n: int = 20) -> int:
    """The least number of probes that finds a share of the exact results of at most SAMPLE_QUERIES queries."""
    q = _usable(query_vectors, "query_id", "vector", "query_id").orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES)
    if len(index.centres) < 2:
        return max(1, len(index.centres))
    rows = q.collect()
    if not rows:
        return 1
    few = q.sparkSession.createDataFrame(rows, q.schema)
    exact = exact_search(few.withColumnRenamed("_v", "vector"), index.rows, threshold, n, "item_id", "_v")
    orders = few.select("query_id", F.posexplode(_cells(index.centres, len(index.centres))("_v")).alias("place", "cell"))
    found = exact.join(index.rows.select("item_id", "cell"), "item_id").join(orders, ["query_id", "cell"])
    places = np.sort(found.select("place").toPandas()["place"].to_numpy())
    return int(places[min(len(places) - 1, int(np.ceil(share * len(places))) - 1)]) + 1 if len(places) else 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, item_id) that were found."""
    keys = ["query_id", "item_id"]
    hit, total = exact.select(*keys).join(found.select(*keys).withColumn("_hit", F.lit(1)), keys, "left").agg(F.sum("_hit"), F.count("*")).first()
    return (hit or 0) / total if total else 1.0
