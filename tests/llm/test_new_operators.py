"""Token alignment, suffix de-duplication and periodic runs against brute force, with the odd cases of each docstring."""

import collections
import hashlib
import random
import types

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lodestar.llm import periodic_runs as P, suffix_dedup as S, token_alignment as T
from lodestar.llm.queries import PERIODIC_RUNS_SQL, QUERIES, TOKENIZERS
from tests.compare import connection

FILES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


# -- periodic runs -------------------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(w[t] == w[t - d] for t in range(s + d, j)) for d in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_diagonals_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
            w = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4))
                for i in range(a, min(n, a + p * rng.randint(3, 8))):
                    w[i] = w[a + (i - a) % p]
            docs.append(w)
        for d, got in zip(docs, P._block(docs, 6, 4), strict=True):
            assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == brute_runs(d)


def test_planted_repeats():
    words = [b"%d" % i for i in range(50)]
    g = 13
    a, p = g % 50, 1 + (50 - g % 50) // (3 + g % 8)
    want = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert P.plant(words, 130) == want and P.plant(words, 131) == words == P.plant(words, None) and P.plant([], 130) == []


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b " * 9), (4, "a b " * 9), (None, "x " * 6), (5, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect()]
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 18, [(0, 18, 2)], "a b"), (4, 18, [(0, 18, 2)], "a b"), (None, 6, [(0, 6, 1)], "x"), (5, 30_000, [(0, 30_000, 1)], "word")]
    digest = {r.doc_id: r for r in P.digest(P.periodic_runs(docs)).collect()}
    assert digest[1].start is None and digest[1].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert tuple(digest[4])[1:6] == (1, 0, 18, 2, 9000) and digest[4].runs_sha256 == hashlib.sha256(b"0,18,2\n").hexdigest()
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_the_table_equal_sql(spark, sf_dir):
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    want = connection(sf_dir).execute(PERIODIC_RUNS_SQL).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[1] for r in got) > 5


# -- suffix de-duplication -----------------------------------------------------------------------------------------------------


def brute_cover(docs, length):
    w = collections.Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        cover = [0] * len(d)
        for i in range(len(d) - length + 1):
            if w[d[i : i + length]] > 1:
                cover[i : i + length] = [1] * length
        out.append(cover)
    return out


def merged_cover(docs, length, k, n_runs):
    """The operator's own steps, without Spark."""
    last = np.cumsum([len(d) for d in docs])
    first = last - np.array([len(d) for d in docs])
    h, at, lo, hi = S.anchors(np.frombuffer(b"".join(docs), np.uint8), first, last, length, k)
    doc, cover, given = np.searchsorted(last, at, "right"), [[0] * len(d) for d in docs], [[] for _ in range(n_runs)]
    for x, a, b, c, d in zip(h.tolist(), at.tolist(), lo.tolist(), hi.tolist(), doc.tolist(), strict=True):
        a, b, c = (v - int(first[d]) for v in (a, b, c))
        given[d % n_runs].append(((x.to_bytes(8, signed=True) + docs[d][a : c + length], docs[d][b:a]), (d, a)))
    runs, places = [], []
    for own in given:
        order, distinct, entry = S.sorted_run([s for s, _ in own])
        coded = S.front_coded(distinct, np.bincount(entry, minlength=len(distinct)))
        runs.append(S.Run(types.SimpleNamespace(**dict(zip(["prefix", "size", "bytes", "left_size", "left_bytes", "times"], coded, strict=True)))))
        places.append([(e, own[o][1]) for o, e in zip(order.tolist(), entry.tolist(), strict=True)])
    rows = list(S.merged(runs))
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    assert all(b[2] == S.common_prefix(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))
    found, group = {}, []
    for r in [*rows, (b"", b"", 0, 0, 0, 0)]:
        if r[2] < 8 + k:
            found |= {(run, e): (a, b) for run, e, a, b in S.verdicts(group, length, 8)}
            group = []
        group.append(r)
    for n, own in enumerate(places):
        for e, (d, a) in own:
            if (n, e) in found:
                low, high = found[n, e]
                cover[d][a - high : a - low + length] = [1] * (high - low + length)
    return cover


@pytest.mark.parametrize("way", ["_by_pairs", "_by_order"])
def test_merge_equals_brute_force(monkeypatch, way):
    monkeypatch.setattr(S, "_by_pairs", getattr(S, way))
    rng = random.Random(5)
    for _ in range(500):
        length, letters = rng.choice([3, 5, 8, 12]), rng.choice([b"a", b"ab", b"abc", b"abcdefgh"])
        base = bytes(rng.choice(letters) for _ in range(60))
        docs = []
        for _ in range(rng.randint(1, 14)):
            parts = [base[(a := rng.randrange(50)) : a + rng.randint(1, 30)] if rng.random() < 0.6 else bytes(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 3))]
            docs.append(b"".join(parts))
        assert merged_cover(docs, length, min(rng.choice([1, 2, 3]), length), rng.randint(1, 5)) == brute_cover(docs, length)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_repeats_of_a_table(spark, sf_dir, hot):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    rows += [(9001, None), (9002, ""), (9003, "é" * 400), (9003, "é" * 400), (9004, "a" * 5000), (None, "short"), (9005, rows[0][1] + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("_row", F.lit(1))
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), x, cover in zip(rows, raw, brute_cover(raw, 200), strict=True):
        want.append((i, len(x), sum(cover), sum(c and not (q and cover[q - 1]) for q, c in enumerate(cover)), bytes(b for b, c in zip(x, cover, strict=True) if not c)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs, hot_group=hot).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 5000
    if hot > 3:
        assert S.remove_repeats(docs.limit(0)).count() == 0


# -- token alignment -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return T.Aligner(T.Pair.load(*FILES))


@pytest.fixture(scope="module")
def brute(aligner):
    a_tokens, b_tokens = aligner.a.tokens, aligner.b.tokens
    encode_a = tokenizers.Tokenizer.from_file(FILES[0])
    encode_a.encode_special_tokens = True
    encode_b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])

    def groups(text):
        """Groups of a whole text, encoded at once."""
        if not text:
            return []
        a, b, raw = encode_a.encode(" " + text, add_special_tokens=False).ids, encode_b.encode(text), (" " + text).encode()
        if b"".join(a_tokens[i] for i in a) != raw or b"".join(b_tokens[i] for i in b) != raw:
            return []
        ends_a, ends_b = (np.cumsum([len(v[i]) for i in x]).tolist() for v, x in ((a_tokens, a), (b_tokens, b)))
        out, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out

    return groups


def written(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def test_words_give_what_whole_texts_give(aligner, brute, spark, sf_dir):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", " \n", "\t", "▁", "é", "—", "»", "'s", "1", "日本", "\x00", "​", "\xa0", ".", "ing", "the", "<|endoftext|>", "<s>", "🎉", "\x1c", "'", "  \n ", "ﬁ", "A", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    ids, doc, code, links = aligner.block(texts)
    got = collections.defaultdict(dict)
    for d, c, n in zip(doc.tolist(), code.tolist(), links.tolist(), strict=True):
        got[d][c >> 32, c & 0xFFFFFFFF] = n
    for k, t in enumerate(texts):
        groups = brute(t)
        assert ";".join(aligner.groups[i] for i in ids[k]) == written(groups), t
        assert got[k] == dict(collections.Counter((i, j) for x, y in groups for i in x for j in y))


def test_forgetting_words_changes_nothing(brute, monkeypatch, spark, sf_dir):
    monkeypatch.setattr(T, "KNOWN", 300)
    aligner = T.Aligner(T.Pair.load(*FILES))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect():
        [ids], *_ = aligner.block([r.text])
        assert ";".join(aligner.groups[i] for i in ids) == written(brute(r.text))


@pytest.mark.parametrize("hot", [1 << 18, 50, 0])
def test_counts_and_best_links(spark, sf_dir, brute, hot):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows += [(9001, None), (9002, ""), (9003, "a ▁b"), (9004, " "), (9005, "x "), (9005, "x "), (None, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit(1)).withColumn("codes", F.lit(1))
    listed = [(i, brute(t)) for i, t in rows]
    count = collections.Counter(p for _, g in listed for p in {(a, b) for x, y in g for a in x for b in y})
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for i, g in listed:
        links = [(a, b) for x, y in g for a in x for b in y]
        digest = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        want.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    files = T.Pair.load(*FILES)
    assert sorted(map(tuple, T.score(docs, files, hot_pairs=hot).collect()), key=repr) == sorted(want, key=repr)
    if not hot:
        assert {(r.a, r.b): r.n_docs for r in T.pair_counts(docs, files).collect()} == dict(count)
        assert [r.groups for r in T.align(docs, files).collect()] == [written(g) for _, g in listed]
        assert T.score(docs.limit(0), files).count() == 0
