"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. In a suffix array such strings are neighbours with a
common prefix of ``length`` or more; but an array of all suffixes is many times the corpus. Three things keep what is exchanged small:

*Sampled suffixes.* Of the k-byte strings inside each ``length``-byte window the one of least hash is its anchor, so equal windows have
equal anchors at equal places. Only suffixes at anchors are sorted, about one in 80. Each carries the bytes to its right and left that the
windows of this anchor cover (right, left), which is all that decides about them.
*Distinguishing prefixes.* An anchor whose k bytes stand nowhere else in the corpus cannot be part of a repeat. Such anchors are found by
counting hashes, before any string is exchanged.
*Front coding.* A task sorts its suffixes, folds equal ones, and sends each as the length of its common prefix with the one before and the
bytes after it. Runs are cut at the same places of the sort order (the hash of the first k bytes leads it, so equal cuts are balanced).

The receiver merges the runs by a loser tree that compares common-prefix lengths first: of two heads the one that shares more with the
last output is smaller, and only heads that share equally much are compared, from the first byte not known to be equal. Nothing is
compared twice. The merged order gives each suffix its common prefix with its neighbours; the bytes to the left are ordered the same way
inside each group of equal anchors. A window that takes o bytes from the left repeats if another suffix agrees with it on length - o bytes
to the right and o to the left. All repeated windows of one anchor hold it, so what they cover is one stretch: the verdict of a suffix.
Verdicts go back to the run they came from, which knows the places of each folded suffix.

A group of more than ``hot_group`` anchors (a k-byte string in very many documents) is not merged in one task: its windows become rows,
counted with a combine before the shuffle. The result is the same.

Defined results: a null text is the empty text; texts shorter than ``length`` stay; strings never cross documents, and rows that repeat
are each other's repeats; texts of any length are used whole; strings are judged on the input, so all copies of a passage go, the first
too; null and repeated ids are kept; an empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import mix64, release, staged

#: Bytes hashed at once and bytes of texts sorted as one run; a longer text is a block, or a run, of its own.
BLOCK_BYTES, RUN_BYTES = 250_000, 4_000_000
#: Anchors of the corpus for each part of the sort order.
PART_ANCHORS = 100_000
#: Rows of an Arrow batch while texts go through tasks, and the setting that bounds them.
BATCH_ROWS, _BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
_PLACE = np.uint64(31)
RUNS = "run string, part int, prefix binary, size binary, bytes binary, left_size binary, left_bytes binary, times binary, entry binary, row binary, at binary"


# -- anchors -----------------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling: of two halves, which overlap where k is no power of two."""
    h, size = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    while size < k:
        step = min(size, k - size)
        if len(h) <= step:
            return h[:0]
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]
        h ^= h >> np.uint64(29)
        size += step
    return mix64(h)


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first and last window start) of the anchors of documents data[first:last] that stand one behind the other."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = gram_hashes(data, k)
    # The leading bits of a hash, then its place: the least is the leftmost of the least hashes. Places need fewer than 31 bits.
    y = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = length - k + 1, 1
    while size < width:
        step = min(size, width - size)
        y = np.minimum(y[:-step], y[step:])
        size += step
    place = (y & np.uint64((1 << 31) - 1)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int64)
    long_ = last - first >= length
    np.add.at(inside, first[long_], 1)
    np.add.at(inside, last[long_] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(starts):
        return none, none, none, none
    own = place[starts]
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    tail = np.append(head[1:], len(starts)) - 1
    # The least hashes are all small: they are mixed once more, as what follows is cut by their leading bits.
    return mix64(h[own[head]] + np.uint64(1)).view(np.int64), own[head], starts[head], starts[tail]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, size: int, packed: bool = True) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows and their texts, about ``size`` bytes of them. packed: the texts are compressed."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        first, held, total = 0, [], 0
        for i, value in enumerate(batch.column(column)):
            text = value.as_py()
            held.append((unpack(text) if packed else text) if text else b"")
            total += len(held[-1])
            if total >= size or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first), held
                first, held, total = i + 1, [], 0


def _lists(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _with_anchors(length: int, k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in _blocks(batches, 1, BLOCK_BYTES, packed=False):
            size = np.array([len(t) for t in texts], np.int64)
            last = np.cumsum(size)
            h, at, lo, hi = anchors(np.frombuffer(b"".join(texts), np.uint8), last - size, last, length, k)
            doc = np.searchsorted(last, at, "right")
            bounds, off = np.searchsorted(doc, np.arange(len(texts) + 1)), (last - size)[doc]
            lists = [_lists(bounds, h, pa.int64()), *(_lists(bounds, x - off, pa.int32()) for x in (at, lo, hi))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) if t else b"" for t in texts], pa.binary()), *lists], ["doc_id", "_text", "hash", "at", "lo", "hi"])

    return found


# -- runs --------------------------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes already."""
    n = min(len(a), len(b))
    gap = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (gap.bit_length() + 7 >> 3)


def sorted_run(suffixes: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, list[tuple[bytes, bytes]], np.ndarray]:
    """Suffixes (hash and right, left) in order and folded: order of the given ones, the distinct ones, entry of each in order."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    distinct, entry = [], np.zeros(len(order), np.int64)
    for j, i in enumerate(order):
        if not distinct or suffixes[i] != distinct[-1]:
            distinct.append(suffixes[i])
        entry[j] = len(distinct) - 1
    return np.array(order, np.int64), distinct, entry


def front_coded(entries: list[tuple[bytes, bytes]], times: np.ndarray) -> list[bytes]:
    """Columns prefix, size, bytes, left_size, left_bytes, times of a sorted run."""
    prefix = [0, *(common_prefix(a[0], b[0]) for a, b in zip(entries, entries[1:], strict=False))] if entries else []
    tails = [e[0][p:] for e, p in zip(entries, prefix, strict=True)]
    lefts = [e[1] for e in entries]
    pack = lambda x: np.array(x, np.int32).tobytes()
    return [pack(prefix), pack([len(t) for t in tails]), b"".join(tails), pack([len(t) for t in lefts]), b"".join(lefts), pack(np.minimum(times, 2))]


class Run:
    """Reads a front-coded run; ``head`` is the next suffix, ``shared`` its common prefix with the last output, ``entry`` its number."""

    def __init__(self, row):
        ints = lambda x: array("i", x)  # noqa: E731  four bytes each
        self.prefix, self.size, self.bytes = ints(row.prefix), ints(row.size), row.bytes
        self.left_size, self.left_bytes, self.times = ints(row.left_size), row.left_bytes, ints(row.times)
        self.entry, self.at, self.left_at, self.head, self.left, self.shared = -1, 0, 0, b"", b"", 0
        self.next()

    def next(self) -> None:
        self.entry += 1
        if self.entry == len(self.prefix):
            self.head = None
            return
        self.shared = self.prefix[self.entry]
        end, left_end = self.at + self.size[self.entry], self.left_at + self.left_size[self.entry]
        self.head, self.left = self.head[: self.shared] + self.bytes[self.at : end], self.left_bytes[self.left_at : left_end]
        self.at, self.left_at = end, left_end


def merged(runs: list[Run]) -> Iterator[tuple[bytes, bytes, int, int, int, int]]:
    """(suffix, left, prefix shared with the suffix before, run, entry, times) of all runs in order, by a loser tree."""
    n = 1 << max(0, len(runs) - 1).bit_length()
    losers: list[int] = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix is then that with the winner."""
        x, y = (runs[i] if i < len(runs) else None for i in (a, b))
        if x is None or x.head is None:
            return b, a
        if y is None or y.head is None or x.shared > y.shared:
            return a, b
        if x.shared < y.shared:
            return b, a
        p = common_prefix(x.head, y.head, x.shared)
        if x.head[p : p + 1] <= y.head[p : p + 1]:
            y.shared = p
            return a, b
        x.shared = p
        return b, a

    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if n > 1 else 0
    while best < len(runs) and runs[best].head is not None:
        run = runs[best]
        yield run.head, run.left, run.shared, best, run.entry, run.times[run.entry]
        run.next()
        node = best + n >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


# -- verdicts ----------------------------------------------------------------------------------------------------------------


def _by_pairs(rights: list[bytes], lefts: list[bytes], shared: list[int], length: int, skip: int) -> list[tuple[int, int] | None]:
    """Of each suffix the least and greatest number of left bytes of its windows that another suffix repeats; all pairs of a few."""
    out: list[tuple[int, int] | None] = [None] * len(rights)
    low, high = [length + skip - len(r) for r in rights], [len(x) for x in lefts]
    for i in range(len(rights)):
        right = 1 << 30
        for j in range(i + 1, len(rights)):
            right = min(right, shared[j] - skip)
            a = max(low[i], low[j], length - right)
            b = min(high[i], high[j])
            if a <= b:
                b = min(b, common_prefix(lefts[i][::-1], lefts[j][::-1]))
                if a <= b:
                    for x in (i, j):
                        out[x] = (min(out[x][0], a), max(out[x][1], b)) if out[x] else (a, b)
    return out


def _by_order(rights: list[bytes], lefts: list[bytes], shared: list[int], length: int, skip: int) -> list[tuple[int, int] | None]:
    """The same for many suffixes: neighbours in the order of the right and of the left bytes fall into groups at every depth."""
    n = len(rights)
    low, high = np.array([length + skip - len(r) for r in rights]), np.array([len(x) for x in lefts])
    turned = [x[::-1] for x in lefts]
    order = sorted(range(n), key=turned.__getitem__)
    left_shared = np.array([0, *(common_prefix(turned[a], turned[b]) for a, b in zip(order, order[1:], strict=False))])
    right_shared, least, most = np.array(shared) - skip, np.full(n, 1 << 30), np.full(n, -1)
    step = max(1, 250_000 // n)
    for o in range(int(low.min()), int(high.max()) + 1, step):
        depths = np.arange(o, min(o + step, int(high.max()) + 1))
        right = np.cumsum(right_shared[:, None] < length - depths, axis=0)
        left = np.empty_like(right)
        left[order] = np.cumsum(left_shared[:, None] < depths, axis=0)
        key = np.where((low[:, None] <= depths) & (depths <= high[:, None]), right * (n + 1) + left, -1 - np.arange(n)[:, None])
        by = np.argsort(key, axis=0, kind="stable")
        ordered = np.take_along_axis(key, by, axis=0)
        same = np.zeros((n + 1, len(depths)), bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        twin = np.empty((n, len(depths)), bool)
        np.put_along_axis(twin, by, same[1:] | same[:-1], axis=0)
        some = twin.any(axis=1)
        least[some] = np.minimum(least[some], depths[twin[some].argmax(axis=1)])
        most[some] = np.maximum(most[some], depths[len(depths) - 1 - twin[some][:, ::-1].argmax(axis=1)])
    return [(int(a), int(b)) if b >= 0 else None for a, b in zip(least, most, strict=True)]


def verdicts(group: list[tuple[bytes, bytes, int, int, int, int]], length: int, skip: int) -> Iterator[tuple[int, int, int, int]]:
    """(run, entry, least, greatest number of left bytes) of the suffixes of one anchor that have repeated windows. skip: bytes of the hash."""
    if not group or (len(group) == 1 and group[0][5] < 2):
        return
    known: dict[tuple[bytes, bytes], int] = {}
    shared, times, members, lowest = [], [], [], 1 << 30
    for suffix, left, common, run, entry, n in group:
        lowest = min(lowest, common)
        k = known.setdefault((suffix, left), len(known))
        if k == len(shared):
            shared.append(lowest)
            times.append(0)
            lowest = 1 << 30
        times[k] += n
        members.append((run, entry, k))
    rights, lefts = [x[0] for x in known], [x[1] for x in known]
    some = [None] if len(known) == 1 else (_by_pairs if len(known) <= 8 else _by_order)(rights, lefts, shared, length, skip)
    for run, entry, k in members:
        if times[k] > 1:
            yield run, entry, length + skip - len(rights[k]), len(lefts[k])
        elif some[k]:
            yield run, entry, *some[k]


def _merge(length: int, k: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[tuple[int, int, int]]] = {}
        group: list = []

        def close():
            for run, *verdict in verdicts(group, length, 8):
                found.setdefault(run, []).append(tuple(verdict))
            group.clear()

        for x in merged([Run(r) for r in rows.itertuples(index=False)]):
            if x[2] < 8 + k:
                close()
            group.append(x)
        close()
        out = [(rows["run"].iloc[r], rows["part"].iloc[r], *map(list, zip(*sorted(v), strict=True))) for r, v in found.items()]
        return pd.DataFrame(out, columns=["run", "part", "entry", "least", "most"])

    return work


def _make_runs(length: int, bits: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches, 1, RUN_BYTES):
            row, cols = batch.column(0).to_pylist(), [batch.column(c).to_pylist() for c in (2, 3, 4, 5, 6)]
            suffixes, places, hot_ = [], [], []
            for r, text, *lists in zip(row, texts, *cols, strict=True):
                for h, at, lo, hi, hot in zip(*lists, strict=True):
                    suffixes.append((h.to_bytes(8, signed=True) + text[at : hi + length], text[lo:at]))
                    places.append((r, at))
                    hot_.append(hot)
            for hot in (False, True):
                own = [i for i, x in enumerate(hot_) if x == hot]
                order, distinct, entry = sorted_run([suffixes[i] for i in own])
                place = np.array([places[i] for i in own], np.int64).reshape(-1, 2)[order]
                times = np.bincount(entry, minlength=len(distinct))
                part = np.array([-1 if hot else int.from_bytes(d[0][:8]) >> 64 - bits for d in distinct], np.int64)
                run, out = uuid.uuid4().hex, []
                bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(distinct)]
                for i, j in zip(bounds, bounds[1:], strict=False):
                    if i < j:
                        a, b = np.searchsorted(entry, [i, j])
                        ints = [(entry[a:b] - i).astype(np.int32), place[a:b, 0], place[a:b, 1].astype(np.int32)]
                        out.append([run, int(part[i]), *front_coded(distinct[i:j], times[i:j]), *(x.tobytes() for x in ints)])
                if out:
                    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 9]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in RUNS.split(", ")])

    return made


def _hot_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pandas().itertuples(index=False):
            run, out = Run(r), []
            while run.head is not None:
                out.append((r.run, run.entry, run.left + run.head[8:], len(run.left), run.times[run.entry]))
                run.next()
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["run", "entry", "bytes", "left", "times"])


def _hot_verdicts(runs: DataFrame, length: int) -> DataFrame:
    """Verdicts of groups that are too large for one task: their windows are rows, counted with a combine before the shuffle."""
    own = runs.where("part < 0").mapInArrow(_hot_suffixes, "run string, entry int, bytes binary, left int, times int")
    windows = own.select("run", "entry", "times", "left", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("_i"))
    windows = windows.select("run", "entry", "times", (F.col("left") - F.col("_i")).alias("o"), F.expr(f"substring(bytes, _i + 1, {length})").alias("w"), F.col("left"), F.col("_i"))
    # A window's place in relation to its anchor is part of it, and follows from its bytes.
    twice = windows.groupBy("w").agg(F.sum("times").alias("n")).where("n > 1").select("w")
    some = windows.join(twice, "w").groupBy("run", "entry").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    listed = some.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("entry", "least", "most"))).alias("_v"))
    return listed.select("run", F.lit(-1).alias("part"), *(F.col(f"_v.{c}").alias(c) for c in ("entry", "least", "most")))


def _stretches(length: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pandas().itertuples(index=False):
                entry, row, at = np.frombuffer(r.entries, np.int32), np.frombuffer(r.row, np.int64), np.frombuffer(r.at, np.int32)
                k = np.searchsorted(r.entry, entry)
                known = np.flatnonzero(np.append(r.entry, -1)[k] == entry)
                if len(known):
                    k, at = k[known], at[known].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row[known]), pa.array(at - np.array(r.most)[k]), pa.array(at - np.array(r.least)[k] + length)], ["_row", "start", "end"])

    return found


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the given stretches, which may overlap or touch."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    for batch, texts in _blocks(batches, 1, RUN_BYTES):
        rows = []
        for text, starts, ends in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            kept, spans, reach = [], [], -1
            for start, end in sorted(zip(starts or (), ends or (), strict=True)):
                if start > reach:
                    kept.append(text[max(reach, 0) : start])
                    spans.append([start, end])
                reach = max(reach, end)
                spans[-1][1] = reach
            kept.append(text[max(reach, 0) :])
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], b"".join(kept)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def _staged(df: DataFrame, label: str) -> DataFrame:
    """As staged, with small batches."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        return staged(df, label)
    finally:
        spark.conf.set(_BATCH, before)


def remove_repeats(docs: DataFrame, length: int = 200, k: int | None = None, hot_group: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document without its repeated bytes: (doc_id, n_bytes, n_removed, n_spans, spans, kept).

    spans: the maximal removed stretches (start, end) in bytes of the text; kept: the rest, as bytes, as a cut may fall into a character.
    k: bytes of an anchor, by default a sixth of ``length``.
    """
    k = k or max(1, length * 4 // 25)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_with_anchors(length, k), f"doc_id {kind}, _text binary, hash array<long>, at array<int>, lo array<int>, hi array<int>")
    texts = _staged(found.withColumn("_row", F.monotonically_increasing_id()), "suffix-texts")
    total = texts.agg(F.sum(F.size("hash"))).first()[0] or 0
    bits = max(1, (total // PART_ANCHORS).bit_length())

    each = texts.select("_row", F.inline(F.arrays_zip("hash", "at", "lo", "hi")))
    # A table of its own, so that the join may split a hot hash among tasks.
    often = staged(each.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1"), "suffix-often")
    columns = ("hash", "at", "lo", "hi", "hot")
    shared = each.join(often, "hash").withColumn("hot", F.col("_n") > hot_group).groupBy("_row").agg(F.collect_list(F.struct(*columns)).alias("_s"))
    asked = texts.select("_row", "_text").join(shared, "_row").select("_row", "_text", *(F.col(f"_s.{c}").alias(c) for c in columns))
    runs = _staged(asked.mapInArrow(_make_runs(length, bits), RUNS), "suffix-runs")

    release(often)
    sent = runs.where("part >= 0").select("run", "part", "prefix", "size", "bytes", "left_size", "left_bytes", "times")
    told = sent.groupBy("part").applyInPandas(_merge(length, k), "run string, part int, entry array<int>, least array<int>, most array<int>")
    if not runs.where("part < 0").isEmpty():
        told = told.unionByName(_hot_verdicts(runs, length))
    told = _staged(told, "suffix-verdicts")
    back = runs.select("run", "part", F.col("entry").alias("entries"), "row", "at").join(told, ["run", "part"])
    stretches = back.mapInArrow(_stretches(length), "_row long, start long, end long").groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_c"))
    whole = texts.select("_row", "doc_id", "_text").join(stretches, "_row", "left").select("doc_id", "_text", F.col("_c.start").alias("_s"), F.col("_c.end").alias("_e"))
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    return whole.mapInArrow(_without, shape)
