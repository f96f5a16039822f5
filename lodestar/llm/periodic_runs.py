"""Periodic runs of words, by an online sparse diagonal DP.

A run (start, length, period) is a stretch of words whose smallest period is ``period``, that no neighbouring word extends and that is at
least ``least_words`` and ``least_periods`` periods long. Word i lies on the diagonal of lag q if word i - q is the same; a diagonal that
matches m words in a row and then ends is a stretch of m + q words.

Following every earlier occurrence of every word is quadratic where a word is frequent, so only the diagonals that can emit are followed.
For lags of q in [s, 2s), s a power of two, a word takes part with the 2s words that end at it, and increments one lag: that of the
nearest earlier place where these 2s words stand. This loses nothing. Inside a run of period q, 2s >= q words cannot stand nearer than q,
or by Fine and Wilf's theorem the run had a smaller period; so from its (q + 2s)-th word on, all words of the run increment lag q, one
after another, and the first word after it does not. The other way round, a stretch of one lag that is long enough has no smaller period, as
that lag would have been nearer. There is one step per word and power of two; words whose last 2s words stand at one place only
drop out of all longer ones, so that plain text is left after a few.

A document lies whole in one task, in blocks of documents of a bounded number of words; nothing is shuffled.

Defined results: null, empty and blank texts have no words, no runs and the empty text as their collapsed text; texts of any length are
used whole; repeated rows are judged alike, each with its own row; an empty table gives an empty result; columns other than the named
ones are not read. A null id plants nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of the documents that are worked on together; a longer document is a block of its own.
BLOCK_WORDS = 500_000
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_ARROW = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])


def plant(words: list[bytes], seed: int | None) -> list[bytes]:
    """Words of a document with a planted repeat: of every tenth seed, the words from some place on repeat with some period."""
    n = len(words)
    if seed is None or seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key among the distinct ones, and the index of its nearest earlier equal or -1. Keys stand in the order of the text."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank, before = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    before[order] = np.where(new, -1, np.concatenate(([0], order[:-1])))
    return rank, before


def diagonal_runs(tokens: np.ndarray, lengths: np.ndarray, least_words: int = 6, least_periods: int = 4) -> np.ndarray:
    """Rows (document, start, length, period) of the runs in documents that stand one behind the other, in that order.

    tokens: word numbers, different in every document; lengths: words of each document.
    """
    starts = np.cumsum(lengths) - lengths
    longest, found, size = int(lengths.max(initial=0)), [], 1
    at = np.arange(len(tokens))
    own, _ = _ranks(tokens)
    ids = own  # of the ``size`` words that end at each place of ``at``
    while size * least_periods <= longest and len(at):
        # Twice as many words: those that end here and those that end ``size`` places earlier, both of which must stand elsewhere too.
        place = np.full(len(tokens), -1, np.int64)
        place[at] = ids
        at = at[at >= size]
        left, right = place[at - size], place[at]
        at, key = at[left >= 0], (left * (len(tokens) + 1) + right)[left >= 0]
        ids, before = _ranks(key)
        lag = np.where(before >= 0, at - at[before], 0)
        lag[(lag < size) | (lag >= 2 * size)] = 0
        # A diagonal goes on where the next word increments the same lag.
        on = np.flatnonzero(lag)
        first = np.ones(len(on), bool)
        first[1:] = (at[on[1:]] != at[on[:-1]] + 1) | (lag[on[1:]] != lag[on[:-1]])
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(on))[: len(head)] - 1
        begin, end, period = at[on[head]], at[on[tail]] + 1, lag[on[head]]
        begin = begin - period - 2 * size + 1
        good = end - begin >= np.maximum(least_words, least_periods * period)
        found.append(np.stack([begin[good], (end - begin)[good], period[good]], axis=1))
        again = np.bincount(ids, minlength=1)[ids] > 1
        at, ids, size = at[again], ids[again], size * 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    doc = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = np.column_stack([doc, rows[:, 0] - starts[doc], rows[:, 1:]]) if len(rows) else np.zeros((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _block(texts: list[list[bytes]], least_words: int, least_periods: int) -> Iterator[dict]:
    lengths = np.array([len(w) for w in texts], np.int64)
    tokens = np.empty(int(lengths.sum()), np.int64)
    at = total = 0
    for words in texts:
        known: dict[bytes, int] = {}
        number = known.setdefault
        tokens[at : at + len(words)] = [number(w, len(known)) for w in words]
        tokens[at : at + len(words)] += total
        at, total = at + len(words), total + len(known)
    rows = diagonal_runs(tokens, lengths, least_words, least_periods)
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for k, words in enumerate(texts):
        runs = rows[bounds[k] : bounds[k + 1], 1:].tolist()
        if runs:
            out = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                out[start + period] += 1
                out[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(out[:-1]) == 0)]
        yield {"n_words": int(lengths[k]), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": b" ".join(words)}


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 6, least_periods: int = 4, seed: str | None = None) -> DataFrame:
    """Runs of each document and its text without the repeats: (doc_id, n_words, runs, collapsed).

    Runs stand in the order of start, then period. A word is dropped from ``collapsed`` (its words, one space between) if a run holds it
    after the run's first period. seed: name of a column of unsigned numbers; where it is a multiple of ten, a repeat is planted first.
    """
    planted = F.col(seed).cast("long") if seed else F.lit(None).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"), planted.alias("_seed"))
    kind = next(f.dataType for f in rows.schema if f.name == "doc_id")

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                # Splitting bytes at ASCII white space gives the words of the pattern [^\x20\x09-\x0D]+.
                held.append(plant(value.split() if value else [], batch.column(2)[i].as_py()))
                size += len(held[-1])
                if size >= BLOCK_WORDS or i == batch.num_rows - 1:
                    out = pa.RecordBatch.from_pylist(list(_block(held, least_words, least_periods)), _ARROW)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), *out.columns], ["doc_id", *_ARROW.names])
                    first, held, size = i + 1, [], 0

    done = rows.mapInArrow(worked, f"doc_id {kind.simpleString()}, {RESULT}")
    return done.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(runs: DataFrame) -> DataFrame:
    """Of each document the number of its runs, the longest one, and checksums of all runs and of the collapsed text."""
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = runs.select("doc_id", "runs", "collapsed", best.alias("_b"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period", F.floor(1000 * F.col("_b.length") / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
