"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents into word sequences, builds a suffix array per shard (a run of documents of bounded size)
and binary-searches every benchmark suffix in it. A suffix can only match a benchmark window of L words if its next L
words all belong to the benchmark's vocabulary, so other suffixes are left out of the array: the sort stays small and no
match is lost. A document lies whole in one task, so nothing is shuffled.

The benchmark is sent to the executors only while it has at most ``max_words`` words; a larger one is searched in groups
of items, one pass over the documents per group, and the hits are merged per document.

Defined results: a null or wordless text has no words and no hits; an item without words never occurs; repeated item rows
and repeated documents are judged alike; items with a null id count as one item with the id ``""``; an empty benchmark
leaves every document clean. Texts of any length are used whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import staged

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the documents that share one suffix array.
SHARD_WORDS = 1_000_000
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Windows:
    """The distinct windows of some benchmark items as rows of word numbers, and which items have them where."""

    def __init__(self, rows: list[tuple[str, str | None]], size: int):
        self.size = size
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        self.tokens: list[np.ndarray] = []
        known: dict[tuple, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        for item, text in rows:
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            if not len(own):
                continue
            n = len(self.items)
            self.items.append("" if item is None else str(item))
            self.tokens.append(own)
            length = min(size, len(own))
            for at in range(len(own) - length + 1):
                k = known.setdefault(tuple(own[at : at + length].tolist()), len(known))
                if k == len(self.places):
                    self.places.append([])
                self.places[k].append((n, at))
        self.lengths = np.array([len(k) for k in known], np.int64)
        self.rows = np.zeros((len(known), size), np.int64)
        for i, k in enumerate(known):
            self.rows[i, : len(k)] = k
        self.shortest = int(self.lengths.min()) if len(known) else 0


class SuffixArray:
    """Suffixes of a shard that can match a window, in order of their first ``size`` words (0 ends a document)."""

    def __init__(self, tokens: np.ndarray, windows: Windows):
        self.tokens, self.size = tokens, windows.size
        ends = np.flatnonzero(tokens == 0)
        run = ends[np.searchsorted(ends, np.arange(len(tokens)))] - np.arange(len(tokens)) if len(tokens) else ends
        at = np.flatnonzero(run >= max(1, windows.shortest))
        self.keys = tokens[np.minimum(at[:, None] + np.arange(self.size), len(tokens) - 1)] if len(at) else np.zeros((0, self.size), np.int64)
        self.keys[np.arange(self.size) >= run[at][:, None]] = 0
        order = np.lexsort(self.keys.T[::-1]) if len(at) else np.zeros(0, np.int64)
        self.suffixes, self.keys = at[order], self.keys[order]

    def bound(self, rows: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search, all rows at once: how many suffixes stand before (upper: before or with) each row's prefix."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.suffixes))
        inside = np.arange(self.size) < lengths[:, None]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            gap = np.where(inside, self.keys[np.minimum(middle, len(self.keys) - 1)] - rows, 0)
            first = (gap != 0).argmax(axis=1)
            sign = np.sign(gap[np.arange(len(rows)), first])
            before = (sign <= 0 if upper else sign < 0) & open_
            low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
        return low

    def occurrences(self, windows: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """(window, places in the shard) of each window that occurs."""
        if len(self.suffixes) and len(windows.rows):
            low, high = (self.bound(windows.rows, windows.lengths, upper) for upper in (False, True))
            for k in np.flatnonzero(high > low):
                yield int(k), self.suffixes[low[k] : high[k]]


def shards(texts: pd.Series, vocabulary: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    """Word numbers of runs of texts, a 0 after each text; where each text starts; which texts these are."""
    get, parts, starts, total, first = vocabulary.get, [], [], 0, 0
    for i, text in enumerate(texts):
        own = words(text)
        starts.append(total)
        parts.append(np.fromiter((get(w, 0) for w in own), np.int64, len(own)))
        parts.append(np.zeros(1, np.int64))
        total += len(own) + 1
        if total >= SHARD_WORDS or i == len(texts) - 1:
            yield np.concatenate(parts), np.array([*starts, total], np.int64), range(first, i + 1)
            parts, starts, total, first = [], [], 0, i + 1


def hit_spans(texts: pd.Series, windows: Windows) -> list[tuple[int, np.ndarray, np.ndarray, set[str]]]:
    """Of each text: number of words, starts and ends of the hit stretches, ids of the items with an occurring window."""
    out = []
    for tokens, starts, numbers in shards(texts, windows.vocabulary):
        cover, found = np.zeros(len(tokens) + 1, np.int64), [set() for _ in numbers]
        for k, places in SuffixArray(tokens, windows).occurrences(windows):
            np.add.at(cover, places, 1)
            np.add.at(cover, places + windows.lengths[k], -1)
            items = {windows.items[n] for n, _ in windows.places[k]}
            for doc in np.unique(np.searchsorted(starts, places, "right") - 1):
                found[doc] |= items
        hit = np.cumsum(cover[:-1]) > 0
        for j in range(len(numbers)):
            own = np.flatnonzero(np.diff(np.concatenate(([0], hit[starts[j] : starts[j + 1] - 1].astype(np.int8), [0]))))
            out.append((int(starts[j + 1] - starts[j] - 1), own[::2], own[1::2], found[j]))
    return out


def _digest(n: int, n_hit: int, items) -> tuple:
    listed = sorted(items, key=lambda x: x.encode("utf-8", "surrogatepass"))
    return n, n_hit, len(listed), hashlib.sha256(",".join(listed).encode("utf-8", "surrogatepass")).hexdigest(), n_hit > 0 and 20 * n_hit >= n


def _groups(benchmark: DataFrame, item: str, text: str, size: int, max_words: int) -> Iterator[Windows]:
    """The benchmark in groups of about max_words words at most; each is gathered alone."""
    rows = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).alias("_text"))
    total = rows.agg(F.sum(F.regexp_count("_text", F.lit(WORD_SQL)))).first()[0] or 0
    n = max(1, -(-total // max_words))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k)
        yield Windows([tuple(r) for r in part.distinct().collect()], size)


def judge(docs: DataFrame, benchmark: DataFrame, size: int = 13, item: str = "item_id", item_text: str = "text") -> Column:
    """A struct column (RESULT) over a text column named ``text`` for a benchmark of bounded size."""
    [windows] = _groups(benchmark, item, item_text, size, 1 << 62)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @F.pandas_udf(RESULT)
    def result(texts: pd.Series) -> pd.DataFrame:
        rows = [_digest(n, int((ends - starts).sum()), items) for n, starts, ends, items in hit_spans(texts, shared.value)]
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, max_words: int = 2_000_000, keep_columns: bool = False, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Judge each document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A document is contaminated if it has a hit word and its hit words are a twentieth of its words or more. With
    ``keep_columns`` the clean documents come back with their own columns instead. Every row gives a row, beyond ``max_words``
    benchmark words too, where hits are merged by id and text.
    """
    groups = -(-(benchmark.agg(F.sum(F.regexp_count(item_text, F.lit(WORD_SQL)))).first()[0] or 0) // max_words)
    if groups <= 1:
        verdict = judge(docs, benchmark, size, item, item_text)
        if keep_columns:
            return docs.where(~verdict(F.col(text))["contaminated"])
        return docs.select(F.col(doc_id).alias("doc_id"), verdict(F.col(text)).alias("_r")).select("doc_id", "_r.*")
    key = F.struct(F.col(doc_id).alias("doc_id"), F.sha2(text, 256).alias("digest"))
    parts = None
    for windows in _groups(benchmark, item, item_text, size, max_words):
        hits = _hits(docs.sparkSession.sparkContext.broadcast(windows))
        part = docs.select(key.alias("_key"), hits(F.col(text)).alias("_h"))
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("_key").agg(F.max("_h.n_words").alias("n"), F.collect_set("_h").alias("h"))
    result = staged(merged.select(F.col("_key"), _merge()(F.col("n"), F.col("h.starts"), F.col("h.ends"), F.col("h.items")).alias("_r")), "contamination")
    if keep_columns:
        bad = result.where("_r.contaminated").select("_key")
        return docs.join(bad, key.eqNullSafe(bad["_key"]), "left_anti")
    # Rows that repeat share a verdict; each has its own row in the result, as on the small path.
    rows = docs.select(key.alias("_own"))
    return rows.join(result, rows["_own"].eqNullSafe(result["_key"])).select("_own.doc_id", "_r.*")


def _hits(shared):
    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(n, s.tolist(), e.tolist(), sorted(i)) for n, s, e, i in hit_spans(texts, shared.value)], columns=["n_words", "starts", "ends", "items"])

    return hits


def _merge():
    @F.pandas_udf(RESULT)
    def merged(n: pd.Series, starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for total, s, e, i in zip(n, starts, ends, items, strict=True):
            spans = sorted((int(a), int(b)) for x, y in zip(s, e, strict=True) for a, b in zip(x, y, strict=True))
            hit, reach = 0, 0
            for a, b in spans:
                hit += max(0, b - max(a, reach))
                reach = max(reach, b)
            rows.append(_digest(int(total), hit, {x for part in i for x in part}))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return merged


def longest_matches(docs: DataFrame, benchmark: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_words: int = 2_000_000) -> DataFrame:
    """Longest verbatim match of each document with each item that shares a window with it.

    Rows (doc_id, item_id, doc_word, item_word, length): places count words from 0; of equally long matches the first in
    the document, then in the item, is named.
    """
    out = None
    for windows in _groups(benchmark, item, item_text, size, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        found = _longest(shared)
        part = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found(F.col(text))).alias("_m")).select("doc_id", "_m.*")
        out = part if out is None else out.unionByName(part)
    return out


def _longest(shared):
    @F.pandas_udf("array<struct<item_id: string, doc_word: long, item_word: long, length: long>>")
    def found(texts: pd.Series) -> pd.Series:
        w, out = shared.value, []
        for tokens, starts, numbers in shards(texts, w.vocabulary):
            best: list[dict[int, tuple]] = [{} for _ in numbers]
            for k, places in SuffixArray(tokens, w).occurrences(w):
                docs_ = np.searchsorted(starts, places, "right") - 1
                for n, at in w.places[k]:
                    own = w.tokens[n]
                    for p, d in zip(places.tolist(), docs_.tolist(), strict=True):
                        if at and p > starts[d] and tokens[p - 1] == own[at - 1]:
                            continue  # part of a match that starts earlier
                        room = min(len(own) - at, int(starts[d + 1]) - 1 - p)
                        same = tokens[p : p + room] == own[at : at + room]
                        length = room if same.all() else int(same.argmin())
                        best[d][n] = min(best[d].get(n, (0,)), (-length, p - int(starts[d]), at))
            out += [sorted(({"item_id": w.items[n], "doc_word": p, "item_word": q, "length": -length} for n, (length, p, q) in x.items()), key=lambda m: (m["item_id"], m["doc_word"])) for x in best]
        return pd.Series(out, index=texts.index, dtype=object)

    return found
