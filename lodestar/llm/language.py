"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed character n-grams over its lower-cased letters. Spherical k-means gives
each language a few centroids; the language of the centroid with the largest cosine wins, and a text that is much farther
from it than that centroid's own training texts is rejected.

The model is fitted on at most ``per_lang`` labelled texts of each language (a fixed choice by hash of the id); every text
is judged whole. The centroids are small (languages x clusters x buckets floats) and are sent to the executors.

Defined results: a null text or one without letters gets ``und``, score 0 and is rejected, as is every text when nothing
could be learned. Rows with a null id or null language are never learned from. Ties go to the first language by code point.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.llm.common import staged

BUCKETS = 4096
ORDERS = (1, 2, 3)
#: Code points and texts that share one matrix.
CHUNK_CHARS, CHUNK_TEXTS = 2_000_000, 512
#: Languages whose sizes are sent to all tasks; more are joined by shuffle.
MAX_BROADCAST_LANGS = 10_000
RESULT = "lang_pred string, score double, rejected boolean"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append("" if text is None or text is pd.NA else text.lower())
        size += len(part[-1])
        if size >= CHUNK_CHARS or len(part) >= CHUNK_TEXTS:
            yield part
            part, size = [], 0
    if part:
        yield part


def ngram_counts(texts: list[str]) -> np.ndarray:
    """A row of hashed n-gram counts per lower-cased text; runs of other than letters count as one space."""
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts) + 2), [1, *(len(t) + 1 for t in texts), 0])[: len(codes)] - 1
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    stay = letter.copy()
    stay[1:] |= letter[:-1]
    codes, doc, letter = codes[stay], doc[stay], letter[stay]
    flat, total = [], len(texts) * BUCKETS
    for n in ORDERS:
        if len(codes) < n:
            continue
        end = len(codes) - n + 1
        h = np.full(end, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + end]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        fit = letter[:end] if n == 1 else doc[:end] == doc[n - 1 :]
        flat.append(doc[:end][fit] * BUCKETS + (h[fit] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    counts = np.bincount(np.concatenate(flat), minlength=total) if flat else np.zeros(total)
    return counts[:total].reshape(len(texts), BUCKETS).astype(np.float32)


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit rows and each row's own; starts from the mean and then the farthest rows, so reruns agree."""
    first = x.mean(axis=0)
    chosen = [int((x @ first).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                c[j] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = [], [], []
        for part in _chunks(texts):
            counts = ngram_counts(part)
            has = counts.any(axis=1)
            if not len(self.langs):
                lang, score, rejected = lang + ["und"] * len(part), score + [0.0] * len(part), rejected + [True] * len(part)
                continue
            cosine = unit_rows(counts, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(part)), best], 0.0, 1.0)
            lang += [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            score += np.where(has, top, 0.0).astype(float).tolist()
            rejected += (~has | (top < self.floors[best])).tolist()
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, clusters: int = 3, per_lang: int = 1000, slack: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn centroids from labelled texts that are not held out."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_id")))
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    few = sizes.count() <= MAX_BROADCAST_LANGS
    near = rows.join(F.broadcast(sizes) if few else sizes, "_lang").where(share < F.lit(2.0 * per_lang) / F.col("_n"))
    pick = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id", "_text")
    sample = staged(near.withColumn("_k", F.row_number().over(pick)).where(F.col("_k") <= per_lang).select("_lang", "_text"), "language-sample")

    def document_counts(parts):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in parts:
            for part in _chunks(pdf["_text"]):
                counts = ngram_counts(part) > 0
                seen += counts.sum(axis=0)
                n += len(part)
        yield pd.DataFrame({"bucket": np.arange(-1, BUCKETS), "n": np.concatenate(([n], seen))})

    found = sample.select("_text").mapInPandas(document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in found}
    n = seen.get(-1, 0)
    idf = np.log((1.0 + n) / (1.0 + np.array([seen.get(b, 0) for b in range(BUCKETS)]))).astype(np.float32) + np.float32(1.0)

    def cluster(key, pdf):
        texts = pdf["_text"].sort_values(ignore_index=True)
        x = np.concatenate([unit_rows(ngram_counts(part), idf) for part in _chunks(texts)])
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        c, own = spherical_kmeans(x, clusters)
        cosine = (x @ c.T)[np.arange(len(x)), own]
        floors = [float(np.quantile(cosine[own == j], 0.01)) * slack if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [key[0]] * len(c), "centroid": [r.tolist() for r in c], "floor": floors})

    learned = sorted(sample.groupBy("_lang").applyInPandas(cluster, "lang string, centroid array<float>, floor double").collect(), key=lambda r: (r["lang"], r["floor"]))
    centroids = np.array([r["centroid"] for r in learned], np.float32).reshape(len(learned), BUCKETS)
    return Model(idf, [r["lang"] for r in learned], centroids, np.array([r["floor"] for r in learned]))


def predictor(docs: DataFrame, model: Model):
    """A function from a text column to a struct column (RESULT)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts)

    return predict


def identify(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row."""
    model = model or fit(docs, doc_id=doc_id, text=text, lang=lang)
    predict = predictor(docs, model)
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), predict(F.col(text)).alias("_r")).select("doc_id", "held_out", "_r.*")
