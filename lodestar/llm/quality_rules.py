"""Quality rules: base counts of a text and the log-likelihood ratio of its hashed n-grams between trusted and raw text.

Two multinomials over ``BUCKETS`` hashed character n-grams are counted: one over trusted documents, one over all documents of
the table. A document's score is the mean of log(p_trusted / p_raw) over its n-grams, so length cancels out; it is kept if it
passes the base rules and its score reaches a fixed threshold. Nothing is drawn at random.

Trusted documents are at most ``max_trusted`` ids (the least by hash), which bounds what is sent to the executors; the raw
counts cover every text whole. Partial counts are one row per bucket and task.

Defined results: a null or wordless text has no words and fails the base rules; n-grams do not cross texts; without trusted
documents every score is 0; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import SPACES, WORD_BYTES, mix64

BUCKETS = 1 << 16
ORDERS = (1, 2)
#: Share of words in repeated three-word windows, least words, least score.
MIN_WORDS, THRESHOLD = 50, -0.5
CHUNK_CHARS = 1_000_000
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass"))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    repeated = 0
    if len(ids) >= 3:
        pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        window = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = window[2][window[1]] > 1
        hit = np.zeros(len(ids), bool)
        for k in range(3):
            hit[k : k + len(twice)] |= twice
        repeated = int(hit.sum())
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of texts and the number of each one's text; white space counts as one space."""
    clean = [" ".join(t.split()) if t else "" for t in texts]
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(clean)), [len(t) for t in clean])
    buckets, docs = [], []
    for n in ORDERS:
        end = len(codes) - n + 1
        if end <= 0:
            continue
        h = np.full(end, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + end]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        one = doc[:end] == doc[n - 1 :]
        buckets.append((mix64(h[one]) % np.uint64(BUCKETS)).astype(np.int64))
        docs.append(doc[:end][one])
    none = np.zeros(0, np.int64)
    return np.concatenate(buckets or [none]), np.concatenate(docs or [none])


def _chunks(texts: pd.Series):
    part, size = [], 0
    for text in texts:
        part.append(None if text is None or text is pd.NA else text)
        size += len(part[-1] or "")
        if size >= CHUNK_CHARS or len(part) >= 2000:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(docs: DataFrame, trusted: DataFrame, max_trusted: int = 20_000, smooth: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(p_trusted / p_raw) per bucket; ``trusted`` is a frame whose doc_id column names the trusted documents."""
    ids = trusted.select(F.col(doc_id).alias("_t")).where("_t IS NOT NULL").distinct().orderBy(F.xxhash64("_t"), "_t").limit(max_trusted)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(ids), F.col("_id") == F.col("_t"), "left").select("_text", F.col("_t").isNotNull().alias("_in"))

    def count(parts):
        raw, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in parts:
            inside = pdf["_in"].to_numpy(bool)
            at = 0
            for part in _chunks(pdf["_text"]):
                bucket, doc = ngrams(part)
                raw += np.bincount(bucket, minlength=BUCKETS)
                own += np.bincount(bucket[inside[at : at + len(part)][doc]], minlength=BUCKETS)
                at += len(part)
        seen = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": seen, "raw": raw[seen], "own": own[seen]})

    found = rows.mapInPandas(count, "bucket int, raw long, own long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toPandas()
    raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]], own[found["bucket"]] = found["raw"], found["own"]
    if not own.sum():
        return np.zeros(BUCKETS)
    return np.log((own + smooth) / (own.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS))


def scores(texts: list[str | None], ratio: np.ndarray) -> np.ndarray:
    bucket, doc = ngrams(texts)
    n = np.bincount(doc, minlength=len(texts))
    return np.bincount(doc, ratio[bucket], minlength=len(texts)) / np.maximum(n, 1)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, RESULT) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf(RESULT)
    def result(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for part in _chunks(texts):
            for t, s in zip(part, scores(part, shared.value), strict=True):
                c = base_counts(t)
                failed = c[0] < MIN_WORDS or 100 * c[4] > 50 * c[0]
                rows.append((*c, failed, float(s), not failed and bool(s >= threshold)))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return docs.select(F.col(doc_id).alias("doc_id"), result(F.col(text)).alias("_r")).select("doc_id", "_r.*")
