"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset verification.

A document is the multiset of its five-word shingles (a shorter text is one shingle). BagMinHash (Ertl, 2018): every
(shingle, weight interval) owns a Poisson process in time whose points fall on random registers; the intervals (0,1], (1,2],
(2,4], (4,8] ... discretise the weights hierarchically, each process has its interval's width as rate, and a point counts for
a document if its place in the interval lies below the shingle's weight there. The earliest point per register is the
signature, so two registers agree with exactly the weighted Jaccard similarity as probability. A process stops once it is
later than all registers.

Equal texts are folded first; from then on a text is a number. Texts with an equal band of registers are candidates; candidates
are verified on whole multisets. A group of thousands does not become all its pairs: in each bucket the most central text is
compared with the others, texts that this links are one class, a text of another class is compared with the rest, and what is still
apart is joined exactly by rare-shingle prefixes with size and positional filters.

Defined results: one row per distinct (id, text), with the number of rows that it stands for; (class_id, class_digest), the least
id of the class and the digest of that row's text, names the class, so that equal ids with different texts mix nothing. Null or
wordless texts and rows with a null id are classes of their own (their own id and digest). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import WORD_BYTES, components, mix64, release, staged, unit

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles of the texts whose registers are filled together.
CHUNK = 400_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    words = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * _STEP + h[k : k + len(out)])
    return out


def registers(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash registers of weighted sets (elements, integer weights): arrival times, inf for an empty set."""
    h = np.full((len(sets), m), np.inf)
    flat = h.reshape(-1)
    element = np.concatenate([e for e, _ in sets]) if sets else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if sets else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    seeds, docs, weights, lows, rates = [], [], [], [], []
    low, level = 0, 0
    while (fit := weight > low).any():
        element, weight, doc = element[fit], weight[fit], doc[fit]
        high = 1 if level == 0 else 2 * low
        seeds.append(mix64(element + mix64(np.array([level + 1], np.uint64))))
        docs.append(doc)
        weights.append(weight)
        lows.append(np.full(len(doc), low))
        rates.append(np.full(len(doc), high - low))
        low, level = high, level + 1
    if not seeds:
        return h
    seed, doc, weight, low, rate = (np.concatenate(x) for x in (seeds, docs, weights, lows, rates))
    time = np.zeros(len(seed))
    while len(seed):
        seed = seed + _STEP
        time = time - np.log(unit(mix64(seed))) / rate
        seed = seed + _STEP
        point = mix64(seed)
        place = low + rate * unit(mix64(point ^ _STEP))
        counts = place <= weight
        np.minimum.at(flat, (doc * m + (point % np.uint64(m)).astype(np.int64))[counts], time[counts])
        on = time < h.max(axis=1)[doc]
        seed, doc, weight, low, rate, time = (x[on] for x in (seed, doc, weight, low, rate, time))
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of registers."""
    bits = h.view(np.uint64).reshape(len(h), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(h), 1))
    for k in range(rows):
        out = mix64(out * _STEP + bits[:, :, k])
    return out.view(np.int64)


def signature(bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE):
    """A function from a text column to its band keys (null without words)."""

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        out, part, load = [], [], 0
        for i, text in enumerate(texts):
            part.append(np.unique(shingles(text, size), return_counts=True))
            load += len(part[-1][0])
            if load >= CHUNK or i == len(texts) - 1:
                for (e, _), k in zip(part, band_keys(registers(part, bands * rows), bands, rows), strict=True):
                    out.append(k if len(e) else None)
                part, load = [], 0
        return pd.Series(out, index=texts.index, dtype=object)

    return keys


def multiset(size: int = SHINGLE):
    """A function from a text column to its multiset as a set: the k-th occurrence of a shingle is an element of its own."""

    @F.pandas_udf("array<long>")
    def elements(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            s = np.sort(shingles(text, size))
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else s
            nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s)))) if len(s) else s
            out.append(mix64(s + nth.astype(np.uint64) * _STEP).view(np.int64) if len(s) else np.zeros(0, np.int64))
        return pd.Series(out, index=texts.index, dtype=object)

    return elements


def _similar(both: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b, sa, sb) those with Jaccard of at least threshold."""
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("_c", common).where(F.col("_c") >= threshold * (F.size("sa") + F.size("sb") - F.col("_c")) - 1e-9).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a, b = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return _similar(pairs.join(b, "b").join(a, "a"), threshold)


def _with_class(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of buckets with their class."""
    if roots is None:
        return members.withColumn("c", F.col("id"))
    return members.join(roots, "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")


def _mixed(named: DataFrame, again: bool) -> DataFrame:
    """(key, hub, hub_class) of the buckets that hold several classes: the most central member, again the one of the last class.

    Only aggregates of a bucket meet in a task, never its members.
    """
    rank = F.struct("c", "weight", -F.col("id")) if again else F.struct("weight", -F.col("id"))
    stats = named.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.max_by(F.struct("id", "c"), rank).alias("_hub")).where("_low < _high")
    return stats.select("key", F.col("_hub.id").alias("hub"), F.col("_hub.c").alias("hub_class"))


def _hub_pairs(named: DataFrame, again: bool) -> DataFrame:
    """Hubs with the members of other classes in their buckets."""
    return named.join(_mixed(named, again), "key").where("c <> hub_class").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates among sets (id, c, s) of different classes c: rare elements first, prefix, size and place filters."""
    flat = sets.select("id", "c", F.size("s").alias("n"), F.explode("s").alias("e"))
    often = flat.groupBy("e").agg(F.count("*").alias("df"))
    placed = flat.join(often.where("df > 1"), "e")
    # An element of one set only comes before all others and never matches: it counts by its number alone.
    ordered = placed.groupBy("id", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    alone = F.col("n") - F.size("o")
    post = ordered.select("id", "c", "n", F.posexplode(F.slice("o", 1, F.greatest(F.lit(0), keep - alone).cast("int"))).alias("_p", "_e"), alone.alias("_alone"))
    post = post.select("id", "c", "n", F.col("_e.e").alias("e"), (F.col("_p") + F.col("_alone")).alias("p"))
    x, y = (post.select(F.col("id").alias(f"{k}"), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), "e", F.col("p").alias(f"p{k}")) for k in "ab")
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("ca") < F.col("cb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (room >= need)
    return x.join(y, "e").where(fits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_rows, class_id, class_digest): digest is the MD5 of the text, null for a null text."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text).alias("digest"), F.col(text).alias("_text"))
    sig = staged(own.select("doc_id", "digest", signature(bands, rows, size)(F.col("_text")).alias("keys")), "near-signatures")
    worded = sig.where(F.col("doc_id").isNotNull() & F.col("keys").isNotNull())
    folded = worded.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("keys").alias("keys"))
    folded = staged(folded.select(F.monotonically_increasing_id().alias("id"), "digest", "first", "keys"), "near-folded")

    bucket = folded.select("id", F.explode("keys").alias("key"))
    shared = bucket.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = bucket.join(shared, "key")
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = staged(members.drop("n").join(weight, "id"), "near-members")

    wanted = folded.join(members.groupBy("id").agg(F.lit(True).alias("_in")), "id").select("id", "digest", "first")
    texts = own.join(wanted.withColumnRenamed("digest", "_digest"), (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("_digest")))
    sets = staged(texts.dropDuplicates(["id"]).select("id", multiset(size)(F.col("_text")).alias("s")), "near-sets")

    links, roots = None, None
    for again in (False, True):
        found = _verified(_hub_pairs(_with_class(members, roots), again), sets, threshold)
        last, links = links, staged(found if links is None else links.unionByName(found), "near-links")
        before, roots = roots, components(links, "near-classes")
        release(*(x for x in (last, before) if x is not None))
    named = _with_class(members, roots)
    rest = named.join(_mixed(named, False), "key", "left_semi").groupBy("id").agg(F.min("c").alias("c"))
    left = staged(sets.join(rest, "id"), "near-rest")
    if left.select("id").head(1):
        last, links = links, staged(links.unionByName(_verified(prefix_pairs(left, threshold), sets, threshold)), "near-links")
        before, roots = roots, components(links, "near-classes")
        release(last, before)
    release(members, sets, left)
    classes = folded.select("id", "digest", "first").join(roots, "id", "left").select("digest", "first", F.coalesce("root", "id").alias("_class"))
    heads = classes.groupBy("_class").agg(F.min(F.struct("first", "digest")).alias("_head"))
    classes = classes.join(heads, "_class").select("digest", "_head")
    named = sig.groupBy("doc_id", "digest").agg(F.count("*").alias("n_rows"), (F.count("keys") > 0).alias("_w")).join(classes, "digest", "left")
    within = F.col("_w") & F.col("doc_id").isNotNull()
    return named.select("doc_id", "digest", "n_rows", *(F.when(within, F.col(f"_head.{a}")).otherwise(F.col(b)).alias(c) for a, b, c in (("first", "doc_id", "class_id"), ("digest", "digest", "class_digest"))))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents without all but the first of each class. Of rows equal in id (null too) and text one stays."""
    classes = staged(near_duplicates(docs, doc_id=doc_id, text=text, **options), "near-result")
    gone = ~F.col("doc_id").eqNullSafe(F.col("class_id")) | ~F.col("digest").eqNullSafe(F.col("class_digest"))
    marked = classes.where(gone | (F.col("n_rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), gone.alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_own"), F.md5(text).alias("_md5"))
    left = rows.join(marked, F.col("_own").eqNullSafe(F.col("_id")) & F.col("_md5").eqNullSafe(F.col("_digest")), "left").where(~F.coalesce("_gone", F.lit(False)))
    once, repeated = left.where("_gone IS NULL"), left.where("_gone IS NOT NULL").dropDuplicates(["_own", "_md5"])
    return once.select("_row.*").unionByName(repeated.select("_row.*"))
