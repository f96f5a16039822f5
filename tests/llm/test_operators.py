"""The training-data operators against brute force on small fixtures, with the odd cases of each docstring."""

import collections
import hashlib
import html
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, decontaminate as D, language, licenses, line_dedup, main_text, mixing, near_duplicates as N, quality_classifier, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None, "en", "s", 0), (901, "", None, None, 0), (902, " \t\n", "en", "s", 3), (903, "x", "en", None, 1), (904, "word " * 30_000, "en", "s", 150_000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny and long texts, a repeated row, and extra columns with names that operators use inside."""
    rows = [*ODD, ODD[3]]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "score", "words", "_id", "_text", "digest", "id", "n", "bits", "target")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return df.toPandas()


# -- decontamination ---------------------------------------------------------------------------------------------------------


def brute_contamination(docs, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [2_000_000, 300])
def test_contamination_equals_brute_force(spark, docs, sf_dir, bound):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(1000, "The of and"), (1001, None), (1002, ""), (1003, "Zebra")], "item_id long, text string"))
    more = docs.unionByName(spark.createDataFrame([(5000, "a ZEBRA-the OF and", "en", "s", 1)], SCHEMA))
    got = {r[0]: tuple(r[1:]) for r in D.decontaminate(more, bench, max_words=bound).collect()}
    assert got == brute_contamination([tuple(r) for r in more.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    kept = D.decontaminate(more, bench, max_words=bound, keep_columns=True)
    assert kept.columns == more.columns and kept.count() == sum(not v[4] for v in got.values())


def test_contamination_odd_cases(spark, odd, empty):
    bench = spark.createDataFrame([(None, "word word"), (2, "x")], "item_id long, text string")
    got = collected(D.decontaminate(odd, bench)).set_index("doc_id")
    assert got.loc[900].n_words == 0 and got.loc[902].n_hit == 0 and got.loc[904].n_hit == 30_000
    assert D.decontaminate(empty, bench).count() == 0
    assert collected(D.decontaminate(odd, bench.limit(0))).n_hit.sum() == 0


@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_repeated_rows_are_judged_row_by_row(spark, bound):
    text = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(1, text), (1, text), (1, "clean"), (None, text), (None, text), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (8, "other words of an item")], "item_id long, text string")
    got = sorted((repr(r.doc_id), r.n_words, r.contaminated) for r in D.decontaminate(rows, bench, max_words=bound).collect())
    assert got == [("1", 1, False), ("1", 20, True), ("1", 20, True), ("2", 0, False), ("None", 20, True), ("None", 20, True)]
    assert D.decontaminate(rows, bench, max_words=bound, keep_columns=True).count() == 2


def test_longest_matches(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["pre", *words[:30], "mid", *words[5:20], "end"])), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in D.longest_matches(docs, bench).collect()] == [(1, "7", 1, 0, 30)]


# -- near duplicates ---------------------------------------------------------------------------------------------------------


def multiset(text, size=5):
    w = WORD.findall(text or "")
    k = min(size, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def weighted_jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    sets = {d: multiset(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and weighted_jaccard(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_duplicates_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_near_duplicate_groups_of_variants(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"r{i}-{k}" for k in range(80))) for i in range(5)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
    h = N.registers([(e[a > 0], a[a > 0]), (e[b > 0], b[b > 0])], 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((h[0] == h[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)


def test_near_duplicates_odd_cases(spark, odd, empty):
    got = N.near_duplicates(odd).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i) for i in (900, 901, 902, 903, 904)]
    more = odd.unionByName(odd.where("doc_id = 903").withColumn("doc_id", F.lit(None).cast("long")))
    kept = N.keep_one(more)
    assert kept.columns == odd.columns and kept.where("doc_id = 903").count() == 1 and kept.where("doc_id IS NULL").count() == 1
    assert N.near_duplicates(empty).count() == 0


def test_equal_ids_with_other_texts_are_told_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = spark.createDataFrame([(1, a), (1, b), (0, b + " more"), (1, a), (None, a), (None, a), (5, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_rows, r.class_id, r.class_digest == r.digest) for r in N.near_duplicates(rows).collect()}
    assert got == {(1, 2, 1, True), (1, 1, 0, False), (0, 1, 0, True), (None, 2, None, True), (5, 1, 5, True)}
    kept = sorted(((r.doc_id, r.text) for r in N.keep_one(rows).collect()), key=repr)
    assert kept == sorted([(1, a), (0, b + " more"), (None, a), (5, "")], key=repr)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in common.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# -- lines -------------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    first, lines = {}, []
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for i, x in enumerate(t.split("\n")):
            if s := frozenset(WORD.findall(x)):
                first.setdefault(s, (d, i))
                lines.append((d, i, s))
    by_word = collections.defaultdict(list)
    for s in first:
        for w in s:
            by_word[w].append(s)
    later = set()
    for s in first:
        near = {x for w in s for x in by_word[w]} if len(s) > 3 else set()
        if any(first[x] < first[s] and len(x & s) >= 0.8 * len(x | s) - 1e-9 for x in near):
            later.add(s)
    kept = collections.defaultdict(set)
    for d, i, s in lines:
        if first[s] == (d, i) and s not in later:
            kept[d].add(i)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not WORD.search(x) or i in kept[d]) for d, t in rows}


def test_lines_equal_brute_force(spark, docs):
    base = [f"t{i}" for i in range(20)]
    made = [(2000 + i, "\n".join([" ".join(base[: 20 - i % 7] + [f"z{i}"] * (i % 3 > 0)), "", "one two three", " ".join(f"q{i}{k}" for k in range(6))]), "en", "s", 1) for i in range(30)]
    all_ = docs.unionByName(spark.createDataFrame(made, SCHEMA))
    rows = [tuple(r) for r in all_.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(all_, rarity_bits=12).collect()}
    assert got == brute_lines(rows)


def test_lines_odd_cases(spark, odd, empty):
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(odd, rarity_bits=8).collect()}
    assert got[900] == (None, 0, 0) and got[901] == ("", 0, 0) and got[902] == (" \t\n", 0, 0) and got[903] == ("x", 1, 1)
    twice = odd.unionByName(odd.where("doc_id = 903").withColumn("doc_id", F.lit(950).cast("long")))
    kept = line_dedup.dedup_lines(twice, rarity_bits=8, keep_columns=True)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.distinct().collect()) == [900, 901, 902, 903, 904]
    assert line_dedup.dedup_lines(empty, rarity_bits=8).count() == 0


def test_lines_of_equal_ids_with_other_texts(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e f"), (1, "d e f\ng h i\na b c"), (2, "g h i"), (None, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted((repr(r.doc_id), repr(r.text), r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(rows, rarity_bits=8).collect())
    assert len(got) == 5 and sum(r[3] for r in got) == 4 and ("'2'", "''", 1, 0) not in got
    assert ("None", "'a b c'", 1, 1) in got and ("2", "None", 0, 0) in got and ("2", "''", 1, 0) in got


def test_groups_of_variants_of_a_line(spark):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(30)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.choice(30, rng.integers(0, 4), replace=False):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, rarity_bits=8).collect()} == brute_lines(rows)


def test_postings_meet_all_partners_and_few_others(spark):
    sizes, t = range(4, 90), 0.8
    prefix = {n: n - math.ceil(n * t - 1e-9) + 1 for n in sizes}
    rows = [(n, n, 0, 0, 0, 0, True, [7] * prefix[n]) for n in sizes]
    marked = spark.createDataFrame(rows, "set long, n int, bits long, bits_1 long, bits_2 long, bits_3 long, open boolean, prefix array<int>")
    x, y = (line_dedup._postings(marked, t, k) for k in "xy")
    met = {(r.set_x, (r.place_x & 0xFFFFFFFF) >> 1, r.set_y, (r.place_y & 0xFFFFFFFF) >> 1) for r in x.join(y, "key").collect()}
    fit = {
        (a, p, b, q)
        for a in sizes for b in sizes if t * b - 1e-9 <= a <= b
        for p in range(prefix[a]) for q in range(prefix[b]) if min(a - p, b - q) >= math.ceil((a + b) * t / (1 + t) - 1e-9)
    }
    assert fit <= met
    assert not any(b >= 3 * a for a, _, b, _ in met) and len(met) < sum(prefix.values()) ** 2 / 3


def test_rarity_counts_every_word(spark):
    texts = spark.createDataFrame([("a b a\nc",), ("a  d " * 50,)], "text string")
    got = line_dedup._rarity(texts, 6).first()[0]
    words = [w for r in texts.collect() for w in r.text.replace("\n", " ").split(" ")]
    slots = collections.Counter(r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select((F.xxhash64("w").bitwiseAND(F.lit(63))).alias("s")).collect())
    # No word is in an empty slot, so what stands there is never read.
    assert {i: got[i] >> 55 for i in slots} == {i: min(127, math.floor(math.log2(n + 1.0) * 3)) for i, n in slots.items()}


def test_line_plan_is_native(docs):
    plan = line_dedup.dedup_lines(docs, rarity_bits=8)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# -- mixing ------------------------------------------------------------------------------------------------------------------


def test_sainte_lague_takes_highest_quotients():
    rng = np.random.default_rng(3)
    for _ in range(60):
        shares = [float(x) for x in rng.choice([0, 1, 2, 5, 10, 1000, 12345], rng.integers(1, 9))]
        seats = int(rng.integers(0, 60))
        want = [0] * len(shares)
        for _ in range(seats if sum(shares) else 0):
            i = max(range(len(shares)), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(shares, seats) == want


def test_water_fill():
    assert mixing.water_fill([5, 2, 1], [10, 100, 100], 80) == [10.0, pytest.approx(140 / 3), pytest.approx(70 / 3)]
    assert mixing.water_fill([1, 1], [3, 4], 100) == [3.0, 4.0]


def test_mix_comes_near_targets(spark, docs, odd, empty):
    got = collected(mixing.mix(docs, block=32, shard_words=3000))
    sums = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((sums.taken - sums.target).abs() <= 32 + 0.01 * sums.target).all()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == docs.count()
    assert abs(sums.target.sum() - 1.5 * got["size"].sum()) < 1e-6 * sums.target.sum()
    again = collected(mixing.mix(docs.repartition(7), block=32, shard_words=3000))
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    sizes = {"a": (10, 4), "b": (25, 2), "c": (100, 1), "d": (1, 9000), None: (7, 3)}
    small = spark.createDataFrame([(1000 * k + i, "w " * n, "en", s, 1) for k, (s, (m, n)) in enumerate(sizes.items()) for i in range(m)], SCHEMA)
    took = collected(mixing.mix(small))
    sums = took.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((sums.taken - sums.target).abs() <= 2 + 0.02 * sums.target).all() and (took.taken <= 2 * took["size"]).all()
    odd_ = collected(mixing.mix(odd)).sort_values("doc_id")
    assert len(odd_) == 6 and odd_[odd_.doc_id == 900].taken.tolist() == [0]
    assert mixing.mix(empty).count() == 0


# -- language ----------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(docs, odd, empty):
    model = language.fit(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    o = collected(language.identify(odd, model)).set_index("doc_id")
    assert o.loc[900].lang_pred == o.loc[901].lang_pred == o.loc[902].lang_pred == "und" and o.loc[904].lang_pred != "und"
    assert set(collected(language.identify(docs.limit(3), language.fit(empty))).lang_pred) == {"und"}
    assert language.identify(empty, model).count() == 0


def test_held_out_is_a_quarter_by_crc(spark):
    import zlib

    rows = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id"), language.held_out(F.col("id")).alias("h")).collect()}
    assert rows == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


# -- quality -----------------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


#: A quarter of the labels, kept from the fit.
HELD_OUT = "crc32(cast(doc_id AS string)) % 4 = 2"


def test_quality_rules(spark, docs, odd, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratio = quality_rules.fit(docs, labels.where(f"quality = 1 AND NOT {HELD_OUT}"))
    both = docs.unionByName(odd.select(docs.columns))
    got = collected(quality_rules.judge(both, ratio)).drop_duplicates().set_index("doc_id")
    for r in both.collect():
        g = got.loc[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute_base(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.base_failed and g.kept)
    y = labels.where(HELD_OUT).toPandas().set_index("doc_id").quality
    assert y.nunique() == 2
    good = got.loc[[i for i in y.index if y[i] == 1 and not got.loc[i].base_failed]]
    assert good.kept.mean() > 0.99 and not got.loc[[i for i in y.index if y[i] == 0]].kept.any()
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0


def test_quality_scores_equal_brute_force(spark):
    ratio = np.linspace(-1, 1, quality_rules.BUCKETS)
    texts = ["Ab  ab\ncd", None, "z"]
    bucket, doc = quality_rules.ngrams(texts)
    # Eight single characters and seven pairs; white space counts as one space and n-grams do not cross texts.
    assert np.bincount(doc).tolist() == [15, 0, 1]
    assert sorted(bucket[doc == 0]) == sorted(quality_rules.ngrams(["Ab ab cd"])[0])
    assert quality_rules.scores(texts, ratio).tolist() == pytest.approx([ratio[bucket[doc == 0]].mean(), 0.0, ratio[bucket[doc == 2]].mean()])


def test_quality_classifier(spark, docs, odd, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_classifier.classify(docs.unionByName(odd.select(docs.columns)), labels.where(f"NOT {HELD_OUT}"))
    j = got.join(labels.where(HELD_OUT), "doc_id").toPandas()
    assert j.quality.nunique() == 2 and (j.kept == (j.quality == 1)).mean() > 0.95
    assert got.count() == docs.count() + 6 and got.where("p_good IS NULL").count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
    half = quality_classifier.classify(docs, labels.limit(0)).agg(F.min("p_doc"), F.max("p_doc")).first()
    assert tuple(half) == (0.5, 0.5)


def test_sparse_sites_are_shrunk(spark):
    rows = [(i, "Good plain words here. " * 20, "en", "big", 1) for i in range(60)] + [(100 + i, "### $$$ !!! " * 20, "en", "bad", 1) for i in range(60)] + [(200, "### $$$ !!! " * 20, "en", "tiny", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = d.select("doc_id", (F.col("source") == "big").cast("int").alias("quality"))
    p = {r.source: r.p for r in quality_classifier.classify(d, labels).join(d, "doc_id").groupBy("source").agg(F.avg("host_posterior").alias("p")).collect()}
    assert p["bad"] < p["tiny"] < p["big"]


# -- urls, licenses, pages ---------------------------------------------------------------------------------------------------


def test_url_rules_and_model(spark):
    urls = [None, "no scheme", "http://A.Example.com/en/7x?q#f", "https://example.com/en/8", "ftp://x.net/de/", "http://example.net/de/8/9", "http://org/es/", "http://www.cheap-pills.example.com/buy", "http://x.test?y", "https://" + "a" * 5000 + ".test/" + "b" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.fit(url_filter.seed_table(spark))).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (0, 1, 2, 8)] == [("", "", None), ("", "", None), ("a.example.com", "/en/7x", "example.com/en/7"), ("x.test", "", None)]
    assert [(got[i].rule, got[i].verdict) for i in (2, 3, 4, 5, 6)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert got[7].verdict == "block" and got[0].verdict == "allow"
    seeds = url_filter.judge(url_filter.seed_table(spark).withColumn("page_id", F.col("bad").cast("long")), url_filter.fit(url_filter.seed_table(spark)), rules=(), threshold=0.5)
    assert seeds.where((F.col("page_id") == 1) != (F.col("verdict") == "block")).count() == 0


def test_url_threshold_of_seeds_left_out(spark):
    """The threshold's figures: each seed is judged by a model that has not seen it."""
    rows = url_filter.seed_table(spark).withColumn("g", url_filter.grams(url_filter.host(F.col("url")), url_filter.path(F.col("url")))).collect()
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, r in enumerate(rows):
        x[i, r.g] = 1 / math.sqrt(len(r.g))
    y, p = np.array([r.bad for r in rows], float), []
    for i in range(len(rows)):
        keep = np.arange(len(rows)) != i
        w, b = np.zeros(url_filter.BUCKETS), 0.0
        for _ in range(150):
            step = y[keep] - 1 / (1 + np.exp(-(x[keep] @ w + b)))
            w, b = w * 0.995 + 0.5 * x[keep].T @ step, b * 0.995 + 0.5 * step.sum()
        p.append(1 / (1 + np.exp(-(x[i] @ w + b))))
    blocked = np.array(p) >= url_filter.THRESHOLD
    assert blocked[y == 1].mean() > 0.75 and not blocked[y == 0].any()


def test_url_model_equals_plain_gradient_descent(spark):
    rows = url_filter.seed_table(spark).withColumn("g", url_filter.grams(url_filter.host(F.col("url")), url_filter.path(F.col("url")))).collect()
    w, b = np.zeros(url_filter.BUCKETS), 0.0
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, r in enumerate(rows):
        x[i, r.g] = 1 / math.sqrt(len(r.g))
    y = np.array([r.bad for r in rows], float)
    for _ in range(150):
        step = y - 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w * (1 - 0.5 * 0.01) + 0.5 * x.T @ step, b * (1 - 0.5 * 0.01) + 0.5 * step.sum()
    got = url_filter.fit(url_filter.seed_table(spark)).first()
    assert np.allclose(got.weights, w) and abs(got.bias - b) < 1e-6


def test_patience_and_licenses(spark, odd, empty):
    assert licenses.patience("a b c d e".split(), "x b c y e".split()) == [(1, 1), (2, 2), (4, 4)]
    assert licenses.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    rows = [(1, "lorem ipsum the\nLicensed under the Apache License, Version 2.0.\nthe end of the under"), (2, "This work is licensed under the GNU General Public Licence, version 3."), (3, "released the mit under license " * 3), (4, "plain text"), (5, "Released under\nthe MIT\nLicense. " + "x " * 20000)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in (1, 2, 4, 5)] == ["Apache-2.0", "GPL-3.0", None, "MIT"]
    assert (got[1].first_word, got[1].last_word, got[1].coverage) == (3, 9, 1.0) and got[2].coverage == pytest.approx(11 / 12)
    o = licenses.scan_licenses(odd)
    assert o.count() == 6 and o.where("license IS NOT NULL").count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_licenses_of_repeated_notices_equal_brute_force():
    templates = {k: licenses.words(v) for k, v in licenses.TEMPLATES.items()}
    mit = licenses.TEMPLATES["MIT"]
    assert licenses.scan(f"the {mit} {mit} the", templates) == ("MIT", 1.0, 5, 1, 5)
    assert licenses.scan(f"under {mit}\n{mit}\n{mit} by under the", templates)[0::3] == ("MIT", 1)
    long = licenses.TEMPLATES["MIT-long"]
    assert licenses.scan(f"the {long} of {long} the", templates)[:3] == ("MIT-long", 1.0, len(templates["MIT-long"]))
    rng = np.random.default_rng(3)
    template = templates["MIT"]
    for _ in range(300):
        text = [w for _ in range(4) for w in [*rng.choice([*template, "x"], rng.integers(0, 4)), *(template if rng.random() < 0.5 else rng.permutation(template))]]
        assert max(licenses.in_order(text, template)) == max(len([0 for _ in c]) for n in range(6) for c in itertools.combinations(template, n) if (it := iter(text)) and all(w in it for w in c))
        best = None
        for i in range(len(text)):
            for j in range(i, min(i + 10, len(text))):
                if len(p := licenses.patience(text[i : j + 1], template)) >= 4:
                    found = (-len(p), i + p[0][0])
                    best = min(best, found) if best else found
        got = licenses.scan(" ".join(text), {"MIT": template})
        assert (got[0], got[2], got[3]) == (("MIT", -best[0], best[1]) if best else (None, 0, None))


def test_licenses_are_named(spark):
    texts = {
        "Released under the BSD License.": None,
        "released under the new license": None,
        "This work is licensed under the GNU General Public License, version 1.": None,
        "Licensed under CC BY 3.0.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "the license says Released under the MIT License and again Released under the MIT License the": "MIT",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(df).collect()} == dict(enumerate(texts.values()))


def test_main_text_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_main_text_odd_cases(spark):
    page = main_text.main_text
    assert page(None) == "" and page("  a \n b &amp; c") == "a b & c"
    assert page('<body><nav>n</nav><div class="has-sidebar"><h2>T</h2><p>One <i>two</i>three<br>four<p>five</div><div class="sidebar">s</div><form>f</form><div id="comments"><p>c</div><footer>f') == "T One twothree four five"
    assert page("<article>a<aside>b</aside><p>c</article><p>after") == "a c"
    assert page('<p title="a>b">x</p><script>if (a < b) {}</script><!-- <p>no</p> -->y') == "x y"
    rows = [(i, "http://h.test/p", f"<body><div><p>Same line here</p><p>{'own text %d ' % i * 20}</p></div></body>") for i in range(5)] + [(9, None, None), (10, "http://h.test/q", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in main_text.extract(df).collect()}
    assert got[0] == " ".join(["own text 0"] * 20) and got[9] == got[10] == ""
    assert main_text.extract(df.limit(0)).count() == 0


def test_main_text_keeps_text_beside_the_longest_element():
    page, long = main_text.main_text, "long body " * 200
    assert page(f"<body><h1>Title</h1><div>{long}</div><p>end</body>") == f"Title {long.strip()} end"
    assert page(f"<body><p>lead</p><table><tr><td><p>{long}</p></td></tr></table><div class='menu'>m</div></body>") == f"lead {long.strip()}"


def test_template_slots_of_pages_with_and_without_marks(spark):
    def html_(i, tag):
        at = "<p>Now and then</p>"  # in the frame's last slot on page 0, in the slot before it on the others: no role holds half of six pages
        first, last = (at, "") if i % 3 == 0 else ("", at) if i % 3 == 1 else ("", "")
        return f"<body><{tag}><h1>Title {i}</h1>{first}<p>Read <b>more</b> of us</p>{last}<p>own {i} text</p><p>Share</p></{tag}></body>"

    rows = [(10 * k + i, f"http://{tag}.test/{i}", html_(i, tag)) for k, tag in enumerate(("article", "div")) for i in range(6)]
    # Repeated rows are one page: the text of an article copied five times is no template.
    rows += [(50 + i, "http://copy.test/", "<article><h1>Same</h1><p>Copied text</p></article>") for i in range(5)]
    # Two boxes in changing order break the frame; they are template text of their slots only where half of the pages agree.
    rows += [(60 + i, "http://order.test/", f"<body><p>{'A</p><p>B' if i else 'B</p><p>A'}</p><h2>{i}</h2></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for wide in (200_000, 0):
        got = {r.page_id: r.text for r in main_text.extract(df, max_broadcast=wide).collect()}
        for k in (0, 10):
            assert [got[k + i] for i in range(3)] == ["Title 0 Now and then own 0 text", "Title 1 Now and then own 1 text", "Title 2 own 2 text"]
        assert {got[50 + i] for i in range(5)} == {"Same Copied text"} and got[62] == "2" and got[60].endswith("0") and len(got) == len(rows)


def test_template_classes(spark):
    rows = [(i, "http://h.test/", f"<nav><a>Home</a><a>News</a></nav><p>{i}</p>") for i in range(4)]
    found = main_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    sizes = collections.Counter(r.class_size for r in found)
    assert all(r.host == "h.test" for r in found) and sizes[4] == 4 and sizes[1] == 1  # nav, p and two texts once a page; a twice
