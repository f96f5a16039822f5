"""Quality classifier by hierarchical empirical Bayes.

1. Document evidence: multinomial naive Bayes on hashed word shapes (letters, capitals, digits, the marks a word ends with, and
   whether it repeats the word before), as a mean log ratio per word that is scaled to a probability on the labelled texts.
2. Hosts and paths: grouped aggregation gives each host's and each path's number of documents and mean probability. Host means
   are shrunk to the global mean and path means to their host's posterior; how strongly is estimated from the data by the
   method of moments, so that sparse sites stay near their parent.
3. A document's log odds add what its path's posterior says beyond the global mean.

``documents`` has no address, so by default a host is a ``source`` and a path is a ``lang`` within it; both are parameters.
Naive Bayes is fitted on at most ``max_labelled`` labelled documents (the least by hash of the id); the site statistics cover all.

Defined results: null host or path values are values of their own; a null or wordless text has the prior as evidence; without
labels of both kinds every document has evidence one half; repeated rows count as often as they occur; an empty table gives an
empty result. Texts are used whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import WORD_BYTES, staged

SHAPES = 4096
_CLASSES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def shape_counts(text: str | None) -> np.ndarray:
    """Counts of hashed word shapes of a whole text."""
    out = np.zeros(SHAPES, np.int64)
    if not text:
        return out
    words = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass"))
    seen: dict[bytes, int] = {}
    before = None
    for w in words:
        key = w.translate(_CLASSES) + (b"\0" if w == before else b"")
        seen[key] = seen.get(key, 0) + 1
        before = w
    for key, n in seen.items():
        out[zlib.crc32(_RUNS.sub(rb"\1", key)) % SHAPES] += n
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float, float, float]:
    """(log ratio per shape, slope, offset, prior probability of good)."""
    own = labels.select(F.col(doc_id).alias("_l"), F.col(label).cast("int").alias("_y")).where("_l IS NOT NULL AND _y IN (0, 1)").groupBy("_l").agg(F.max("_y").alias("_y"))
    own = own.orderBy(F.xxhash64("_l"), "_l").limit(max_labelled)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(own), F.col("_id") == F.col("_l")).select("_y", "_text")
    rows = staged(rows, "quality-sample")

    def count(parts):
        total = np.zeros((2, SHAPES), np.int64)
        docs_ = np.zeros(2, np.int64)
        for pdf in parts:
            for y, t in zip(pdf["_y"], pdf["_text"], strict=True):
                total[y] += shape_counts(t)
                docs_[y] += 1
        for y in (0, 1):
            seen = np.flatnonzero(total[y])
            yield pd.DataFrame({"y": y, "shape": np.append(seen, -1), "n": np.append(total[y][seen], docs_[y])})

    found = rows.mapInPandas(count, "y int, shape int, n long").groupBy("y", "shape").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros((2, SHAPES)), np.zeros(2)
    for r in found:
        if r["shape"] < 0:
            n[r["y"]] = r["n"]
        else:
            counts[r["y"], r["shape"]] = r["n"]
    if not n.all():
        return np.zeros(SHAPES), 0.0, 0.0, 0.5
    p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SHAPES)
    ratio = np.log(p[1]) - np.log(p[0])

    def score(parts):
        for pdf in parts:
            yield pd.DataFrame({"y": pdf["_y"], "s": [mean_ratio(t, ratio) for t in pdf["_text"]]})

    sample = rows.mapInPandas(score, "y int, s double").toPandas()
    x, y = sample["s"].to_numpy(), sample["y"].to_numpy(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on the two scaling parameters, with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        grad = np.array([((q - y) * x).sum() + 0.1 * a, (q - y).sum() + 0.1 * b])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return ratio, float(a), float(b), float(n[1] / n.sum())


def mean_ratio(text: str | None, ratio: np.ndarray) -> float:
    c = shape_counts(text)
    n = c.sum()
    return float((c * ratio).sum() / n) if n else 0.0


def _shrunk(mean: Column, n: Column, parent: Column, strength: Column) -> Column:
    return (mean * n + parent * strength) / (n + strength)


def _strength(stats: DataFrame, mean: str, n: str, parent: str) -> Column:
    """Pseudo-documents of the parent, by the method of moments: spread within a site over spread between sites."""
    m, k = F.col(mean), F.col(n)
    between = F.sum(k * (m - F.col(parent)) * (m - F.col(parent))) / F.sum(k)
    within = F.sum(k * m * (1 - m)) / F.sum(k)
    return stats.agg(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(within / F.greatest(between, F.lit(1e-6)), F.lit(1.0)))).alias("s")).scalar()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, site_weight: float = 0.5, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", **options) -> DataFrame:
    """(doc_id, p_doc, host_posterior, path_posterior, p_good, kept) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, label=label, **options))

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        ratio, a, b, prior = model.value
        s = np.array([mean_ratio(t, ratio) for t in texts])
        empty = np.array([not t or not WORD_BYTES.search(t.encode("utf-8", "surrogatepass")) for t in texts], bool)
        return pd.Series(np.where(empty, prior, 1 / (1 + np.exp(-np.clip(a * s + b, -20, 20)))))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), evidence(F.col(text)).alias("p_doc"))
    rows = staged(rows, "quality-evidence")
    paths = staged(rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.avg("p_doc").alias("m")), "quality-paths")
    total = paths.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g")).scalar()
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("hm")).withColumn("g", total)
    hosts = hosts.withColumn("hp", _shrunk(F.col("hm"), F.col("hn"), F.col("g"), _strength(hosts, "hm", "hn", "g")))
    hosts = staged(hosts.select(F.col("_host").alias("_h"), "hp", "g"), "quality-hosts")
    both = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    both = both.withColumn("pp", _shrunk(F.col("m"), F.col("n"), F.col("hp"), _strength(both, "m", "n", "hp")))
    both = both.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "hp", "pp", "g")

    def odds(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    known = rows.join(both, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    z = odds(F.col("p_doc")) + site_weight * (odds(F.col("pp")) - odds(F.col("g")))
    good = 1 / (1 + F.exp(-z))
    return known.select("doc_id", "p_doc", F.col("hp").alias("host_posterior"), F.col("pp").alias("path_posterior"), good.alias("p_good"), (good >= threshold).alias("kept"))
