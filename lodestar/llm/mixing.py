"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. Targets: sources in order of code point (null last) get weights in turn; their shares of the wanted total stop at a
   multiple of each source's size, and the excess is shared again by weight until no target is above.
2. Blocks: the wanted words, in blocks of ``block`` words (by default 256, but at most a 64th of the least target, so that a small
   source comes near its own), go to sources by the highest quotients target / (2k + 1), and each
   source's blocks go to its shards in the same way by shard size. A shard is a fixed slice of a source by hash of the
   document, so that a source with a third of all rows is laid out by many tasks.
3. Selection: a shard's documents stand in seeded hash order, cut into blocks; its quota takes the first blocks, and further
   passes over the shard if it is larger than the shard. A document takes the words that the selected blocks hold of it.

One row per source, or per shard of one source (at most ``max_shards``; shards of a larger source hold more words), is all that meets
in a task for 1 and 2. The result depends on ids, texts and
the seed only, not on partitions.

Defined results: a null or wordless text has size 0 and takes 0; a null id is an id like others; null is a source of its own; repeated rows each take their
own part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodestar.llm.common import n_words, staged

WEIGHTS = (5, 2, 1)


def water_fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Shares of a total by weight that stop at caps; what a cap leaves over is shared again by weight."""
    out, free, left = [0.0] * len(caps), list(range(len(caps))), float(total)
    while free and left > 0:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * per >= caps[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * per
            break
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients share / (2k + 1); ties go to the earlier entry. Large counts start from a divisor."""
    total = math.fsum(shares)
    if seats <= 0 or total <= 0:
        return [0] * len(shares)
    s = np.asarray(shares, float)
    # A divisor that gives too few seats gives everyone a prefix of the seats that the quotients would.
    low, high = total / seats / 4, total / max(seats - len(s), 0.25) * 4 + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.floor(s / middle + 0.5).sum() > seats else (low, middle)
    given = np.floor(s / high * (1 - 1e-12) + 0.5).astype(np.int64)
    queue = [(-share / (2 * int(g) + 1), i) for i, (share, g) in enumerate(zip(shares, given, strict=True)) if share > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = queue[0]
        given[i] += 1
        heapq.heapreplace(queue, (-shares[i] / (2 * int(given[i]) + 1), i))
    return [int(g) for g in given]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int | None = None, shard_words: int = 500_000, max_shards: int = 4096, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row."""
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("size"), F.col(source).alias("source"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("_h")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["source"].tolist()
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode("utf-8", "surrogatepass")))
        pdf = pdf.iloc[order].reset_index(drop=True)
        sizes = [int(x) for x in pdf["source_size"]]
        own = [float(weights[i % len(weights)]) for i in range(len(sizes))]
        target = water_fill(own, [most * x for x in sizes], share * sum(sizes))
        pdf["target"] = target
        pdf["block"] = block or min(256, max(1, int(min((t for t in target if t > 0), default=1) / 64)))
        pdf["blocks"] = sainte_lague(target, round(math.fsum(target) / int(pdf["block"].iloc[0])))
        pdf["shards"] = [int(min(max_shards, max(1, -(-x // shard_words)))) for x in sizes]
        return pdf[["source", "source_size", "target", "block", "blocks", "shards"]]

    plan = staged(sources.groupBy(F.lit(1).alias("_one")).applyInPandas(targets, "source string, source_size long, target double, block long, blocks long, shards long"), "mix-sources")
    placed = rows.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, rows["source"].eqNullSafe(plan["source"])).select(rows["*"], "source_size", "target", "block", "blocks", "shards")
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.col("shards")))
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("blocks").alias("blocks"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard", ignore_index=True)
        pdf["quota"] = sainte_lague([float(x) for x in pdf["_words"]], int(pdf["blocks"].iloc[0]))
        return pdf[["source", "_shard", "_words", "quota"]].rename(columns={"source": "_source", "_shard": "_n"})

    quota = shards.groupBy("source").applyInPandas(quotas, "_source string, _n long, _words long, quota long")
    order = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("_end", F.sum("size").over(order))
    both = laid.join(quota, laid["source"].eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_n")))
    wanted = F.least(F.col("quota") * F.col("block"), (F.col("_words") * most).cast("long"))
    passes = F.when(F.col("_words") > 0, F.floor(wanted / F.col("_words"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), wanted - passes * F.col("_words") - (F.col("_end") - F.col("size"))))
    return both.select("doc_id", "size", "source", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"))
