"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Byte offsets where tokens of both tokenizers end cut a text into groups; every A token of a group is linked with every B token of it. Most
groups hold one token of each, with the same bytes. An array of vocabulary length gives, for each A id, the B id of the same bytes, so
such links need no pair: a task counts the documents that have them in one vector of vocabulary length. Only pairs of irregular groups
that the map does not hold go through a shuffle, already counted per task.

Both tokenizers are byte-exact and join nothing across a space that follows a visible character: A's pattern takes at most one leading
space into a token, B has no piece with a space after anything else (both are checked when the files are loaded). So a text is the row of
its words, each with the space before it, and a word is encoded and grouped once per block of texts, or not at all while it is among the
``KNOWN`` words that the worker keeps.

Counts of pairs come back to the documents in two ways. The identity vector and the most frequent irregular pairs, at most ``hot_pairs``
of them, are broadcast (bounded by the vocabulary and the parameter). All rarer pairs are joined by shuffle; none of those is frequent,
as the threshold between the two is a count of documents, so that join has no hot key.

Defined results: a null or empty text, and one whose tokens do not give back its bytes (B reads U+2581 as a space), has no tokens: zeros
and an empty ``groups``; texts of any length are used whole; special tokens inside texts are plain text; rows that repeat are counted
and answered row by row; an empty table gives an empty result; null ids are kept; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm.common import release, staged

#: Words kept by a worker, and characters of the texts that are worked on together; a longer text is a block of its own.
KNOWN, BLOCK_CHARS = 400_000, 2_000_000
#: Distinct pairs that a task holds before it hands on their counts.
HELD_PAIRS = 1_000_000
SPACE = "▁"
#: Fixed value: the pattern of the byte-level pre-tokenizer, which splits a text before the merges.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, one behind the other."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a row of ids."""
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@dataclass(frozen=True)
class Pair:
    """The two tokenizers' files, given by their bytes, so that tasks need no path."""

    a_json: bytes
    b_model: bytes

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        return cls(Path(a_path).read_bytes(), Path(b_path).read_bytes())


def _hangs(word: str) -> bool:
    """Whether a space after this word may belong to a token that begins in it."""
    return not word or word[-1] == SPACE or word[-1].isspace() or not word[-1].isprintable()


class Aligner:
    """Encodes words by both tokenizers and keeps their groups and links in flat arrays."""

    def __init__(self, files: Pair):
        described = json.loads(files.a_json)
        if described["pre_tokenizer"]["type"] != "ByteLevel" or not described["pre_tokenizer"]["use_regex"] or described["normalizer"] or described["model"]["type"] != "BPE":
            raise ValueError("tokenizer A is not a plain byte-level BPE")
        letters, special = _byte_letters(), {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        # Merges stand in the order of their ids, so the ids are the ranks.
        self.encode_a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode_b = sentencepiece.SentencePieceProcessor(model_proto=files.b_model)
        a_tokens = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            a_tokens[i] = token
        b_tokens = []
        for i in range(self.encode_b.get_piece_size()):
            piece = self.encode_b.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} holds a space after another character")
            b_tokens.append(bytes([int(piece[3:5], 16)]) if self.encode_b.is_byte(i) else piece.replace(SPACE, " ").encode())
        if any(re.search(r"[^\s] ", t.decode("utf-8", "replace")) for t in a_tokens):
            raise ValueError("a token holds a space after a visible character")
        self.a, self.b = Vocabulary(a_tokens), Vocabulary(b_tokens)
        same = {t: i for i, t in enumerate(b_tokens) if self.encode_b.is_byte(i)}
        same |= {t: i for i, t in enumerate(b_tokens) if not (self.encode_b.is_byte(i) or self.encode_b.is_control(i) or self.encode_b.is_unknown(i))}
        #: For each A id the B id of the same bytes, or -1.
        self.identity = np.array([same.get(t, -1) for t in a_tokens], np.int64)
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        #: Of each word: tokens of A and B, groups, links; whether its bytes come back; whether the next word may hang on to it; its uses.
        self.sizes, self.exact, self.open_, self.uses = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
        self.pair_start, self.codes, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the words that were used most: those used twice or more, or none if they are too many."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > KNOWN // 2:
            kept = kept[:0]
        per = np.diff(self.pair_start)[kept]
        at = np.repeat(self.pair_start[kept] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        new = {int(k): j for j, k in enumerate(kept)}
        self.known = {w: new[k] for w, k in self.known.items() if k in new}
        self.groups = [self.groups[k] for k in kept]
        self.sizes, self.exact, self.open_, self.uses = self.sizes[kept], self.exact[kept], self.open_[kept], np.zeros(len(kept), np.int64)
        self.pair_start, self.codes, self.links = np.concatenate([[0], np.cumsum(per)]), self.codes[at], self.links[at]

    def _one(self, word: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Tokens of one word, none if they do not give back its bytes."""
        raw = b" " + word.encode("utf-8", "surrogatepass")
        a, b = self.encode_a.encode_to_numpy(" " + word, disallowed_special=()).astype(np.int64), np.array(self.encode_b.encode(word), np.int64)
        exact = self.a.joined(a).tobytes() == raw == self.b.joined(b).tobytes()
        return (a, b, True) if exact else (a[:0], b[:0], False)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and B of words, one word behind the other, and which words' bytes come back."""
        text = " ".join(words)
        if len(words) > 1 or not _hangs(words[0]):  # words that hang come one by one
            a, b = self.encode_a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(self.encode_b.encode(text), np.int64)
            if self.a.joined(a).tobytes() == (" " + text).encode("utf-8", "surrogatepass") == self.b.joined(b).tobytes():
                return a, b, np.ones(len(words), bool)
        a, b, exact = zip(*map(self._one, words), strict=True)
        return np.concatenate(a), np.concatenate(b), np.array(exact, bool)

    def learn(self, words: list[str]) -> None:
        """Encode and group words, each with a space before it, all in one pass over flat arrays."""
        if not words:
            return
        closed = [w for w in words if not _hangs(w)]
        words = closed + [w for w in words if _hangs(w)]
        bounds = [*range(0, len(closed), 1000), *range(len(closed), len(words) + 1)]
        a, b, exact = map(np.concatenate, zip(*[self._encode(words[i:j]) for i, j in zip(bounds, bounds[1:], strict=False) if j > i], strict=True))
        size = np.where(exact, [len(w.encode("utf-8", "surrogatepass")) + 1 for w in words], 0)
        ends_a, ends_b, ends = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b]), np.cumsum(size)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb, of_group = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), np.searchsorted(ends, cuts)
        count_a, count_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        per_word = [np.bincount(of_group, x, len(words)).astype(np.int64) for x in (count_a, count_b, np.ones(len(cuts)), count_a * count_b)]
        # Every A token meets the B tokens of its group.
        per = count_b[ga]
        left = np.repeat(a, per)
        right = b[np.repeat(first_b[ga] - (np.cumsum(per) - per), per) + np.arange(per.sum())] if len(a) else left
        word, code = np.repeat(of_group[ga], per), left << 32 | right
        order = np.lexsort((code, word))
        word, code = word[order], code[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(new)
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        single = [f"{text_a[i]}|{text_b[j]}" if x == 1 == y else f"{','.join(text_a[i : i + x])}|{','.join(text_b[j : j + y])}" for i, j, x, y in zip(first_a.tolist(), first_b.tolist(), count_a.tolist(), count_b.tolist(), strict=True)]
        till = np.cumsum(per_word[2]).tolist()
        self.groups += [";".join(single[i:j]) for i, j in zip([0, *till], till, strict=False)]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.stack(per_word, axis=1)])
        self.exact, self.open_ = np.concatenate([self.exact, exact]), np.concatenate([self.open_, np.arange(len(words)) >= len(closed)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.pair_start = np.concatenate([self.pair_start, self.pair_start[-1] + np.cumsum(np.bincount(word[at], minlength=len(words)))])
        self.codes, self.links = np.concatenate([self.codes, code[at]]), np.concatenate([self.links, np.diff(np.append(at, len(new)))])

    def numbers(self, words: list[str]) -> list[int]:
        """Numbers of words, new ones learnt first."""
        try:
            return [self.known[w] for w in words]
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in self.known])
            return [self.known[w] for w in words]

    def cut(self, text: str) -> list[int]:
        """A text as numbers of words, none if its tokens do not give back its bytes."""
        if not text:
            return []
        words = text.split(" ")
        ids = self.numbers(words)
        open_ = self.open_[ids]
        if open_.any():
            # A space after a space, at the end, or after an invisible character may belong to a token of the word before.
            whole = [words[0]]
            for joins, w, ahead in zip(open_.tolist(), words[1:], range(len(words) - 2, -1, -1), strict=False):
                if joins or not (w or ahead):
                    whole[-1] += " " + w
                else:
                    whole.append(w)
            ids = self.numbers(whole)
        if not self.exact[ids].all():
            ids = self.numbers([text])
            return ids if self.exact[ids[0]] else []
        return ids

    def block(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of each text, and (text, pair, links) of its distinct linked pairs."""
        if len(self.known) > KNOWN:
            self.forget()
        self.learn([w for w in {w for t in texts if t for w in t.split(" ")} if w not in self.known])
        ids = [self.cut(t) for t in texts]
        n = len(self.known)
        keys, times = np.unique(np.concatenate([np.array(x, np.int64) + k * n for k, x in enumerate(ids)]) if ids else np.zeros(0, np.int64), return_counts=True)
        doc, word = np.divmod(keys, max(n, 1))
        self.uses += np.bincount(word, minlength=n)
        per = np.diff(self.pair_start)[word]
        at = np.repeat(self.pair_start[word] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        doc, code, links = np.repeat(doc, per), self.codes[at], self.links[at] * np.repeat(times, per)
        order = np.lexsort((code, doc))
        doc, code, links = doc[order], code[order], links[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(new)
        return ids, doc[at], code[at], np.add.reduceat(links, at) if len(at) else links

    def regular(self, code: np.ndarray) -> np.ndarray:
        """Pairs that the identity map holds."""
        return self.identity[code >> 32] == (code & 0xFFFFFFFF)


@cache
def _aligner(files: Pair) -> Aligner:
    return Aligner(files)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts, first, size = batch.column(column).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BLOCK_CHARS or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), [t or "" for t in texts[first : i + 1]]
                first, size = i + 1, 0


def _shared(spark: SparkSession, files: Pair):
    """A function that gives a task the worker's aligner."""
    sent = spark.sparkContext.broadcast(files)
    return lambda: _aligner(sent.value)


def align(docs: DataFrame, files: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment of each text: (doc_id, n_a, n_b, n_groups, n_links, groups), groups as ``a1,a2|b1;a3|b2,b3``."""
    rows, aligner = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), _shared(docs.sparkSession, files)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def worked(batches):
        for batch, texts in _blocks(batches, 1):
            one = aligner()
            ids = one.block(texts)[0]
            sizes = np.array([one.sizes[x].sum(axis=0) for x in ids]).reshape(-1, 4)
            groups = [";".join([one.groups[i] for i in x]) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sizes.T), pa.array(groups, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    return rows.mapInArrow(worked, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string")


def pair_counts(docs: DataFrame, files: Pair, text: str = "text") -> DataFrame:
    """How many documents hold each pair linked: (a, b, regular, n_docs). regular: the identity map holds the pair."""
    rows, aligner = docs.select(F.col(text).alias("_text")), _shared(docs.sparkSession, files)

    def counted(batches):
        one = aligner()
        vector, held = np.zeros(len(one.identity), np.int64), pd.Series(dtype=np.int64, index=pd.Index([], dtype=np.int64))
        waiting: list[np.ndarray] = []

        def rows_of(code, n):
            return pa.RecordBatch.from_arrays([pa.array(code >> 32, pa.int32()), pa.array(code & 0xFFFFFFFF, pa.int32()), pa.array(one.regular(code)), pa.array(n, pa.int64())], ["a", "b", "regular", "n_docs"])

        for _, texts in _blocks(batches, 0):
            _, _, code, _ = one.block(texts)
            known = one.regular(code)
            vector += np.bincount(code[known] >> 32, minlength=len(vector))
            waiting.append(code[~known])
            if sum(map(len, waiting)) >= HELD_PAIRS:
                held, waiting = _added(held, waiting), []
                if len(held) >= HELD_PAIRS:
                    yield rows_of(held.index.to_numpy(), held.to_numpy())
                    held = held.iloc[:0]
        held = _added(held, waiting)
        yield rows_of(held.index.to_numpy(), held.to_numpy())
        some = np.flatnonzero(vector)
        yield rows_of(some << 32 | one.identity[some], vector[some])

    parts = rows.mapInArrow(counted, "a int, b int, regular boolean, n_docs long")
    return parts.groupBy("a", "b", "regular").agg(F.sum("n_docs").alias("n_docs"))


def _added(held: pd.Series, waiting: list[np.ndarray]) -> pd.Series:
    code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
    return held.add(pd.Series(n, index=code), fill_value=0).astype(np.int64)


def _hot_threshold(counts: DataFrame, hot_pairs: int) -> int:
    """Least number of documents, a power of two, that at most ``hot_pairs`` irregular pairs reach."""
    sizes = dict(counts.where("NOT regular").groupBy(F.floor(F.log2("n_docs")).alias("k")).count().collect())
    total, least = 0, 1 << 62
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > hot_pairs:
            break
        least = 1 << k
    return least


def score(docs: DataFrame, files: Pair, hot_pairs: int = 1 << 18, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its sizes, links to the best partner of their A id, and counts summed over its links.

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). A pair's count is the number of documents that hold it
    linked; an A id's best pairs are those of its highest count, ties included.
    """
    spark = docs.sparkSession
    counts = staged(pair_counts(docs, files, text), "pair-counts")
    # One row per A id at most: bounded by the vocabulary.
    best = counts.groupBy("a").agg(F.max("n_docs").alias("best"))
    least = _hot_threshold(counts, hot_pairs)
    near = counts.where(F.col("regular") | (F.col("n_docs") >= least)).select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("code"), "n_docs").toPandas().sort_values("code")
    tops = best.toPandas()
    sent = spark.sparkContext.broadcast((near["code"].to_numpy(np.int64), near["n_docs"].to_numpy(np.int64), tops["a"].to_numpy(np.int64), tops["best"].to_numpy(np.int64)))
    rows, aligner = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), _shared(spark, files)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def worked(batches):
        one = aligner()
        hot, n_docs, a, b = sent.value
        highest = np.zeros(len(one.identity), np.int64)
        highest[a] = b
        for batch, texts in _blocks(batches, 1):
            ids, doc, code, links = one.block(texts)
            at = np.minimum(np.searchsorted(hot, code), max(len(hot) - 1, 0))
            known = hot[at] == code if len(hot) else np.zeros(len(code), bool)
            n = np.where(known, n_docs[at], 0) if len(hot) else np.zeros(len(code), np.int64)
            sums = np.zeros((len(texts), 2), np.int64)
            np.add.at(sums, doc, np.stack([links * (known & (n == highest[code >> 32])), links * n], axis=1))
            sizes = np.array([one.sizes[x].sum(axis=0) for x in ids]).reshape(-1, 4)
            shas = [hashlib.sha256(";".join([one.groups[i] for i in x]).encode()).hexdigest() if x else "" for x in ids]
            rest = np.flatnonzero(~known)
            till = np.searchsorted(doc[rest], np.arange(len(texts) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(till, pa.int32()), pa.array(x[rest], pa.int64())) for x in (code, links)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sizes.T), *map(pa.array, sums.T), pa.array(shas, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "codes", "links"])

    shape = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, codes array<long>, links array<long>"
    own = staged(rows.mapInArrow(worked, shape).withColumn("_row", F.monotonically_increasing_id()), "alignments")
    rare = counts.where(~F.col("regular") & (F.col("n_docs") < least)).join(F.broadcast(best), "a").select(((F.col("a").cast("long") * (1 << 32)) + F.col("b")).alias("code"), "n_docs", (F.col("n_docs") == F.col("best")).alias("top"))
    asked = own.select("_row", F.explode(F.arrays_zip("codes", "links")).alias("_p")).select("_row", F.col("_p.codes").alias("code"), F.col("_p.links").alias("links"))
    more = asked.join(rare, "code").groupBy("_row").agg(F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("n_docs")).alias("_sum"))
    out = staged(own.drop("codes", "links").join(more, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256"), "alignment-scores")
    release(counts, own)
    sent.unpersist()
    return out
