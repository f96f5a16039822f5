"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Lines of equal sets are folded to their first place (document, line number). The sets are
joined with each other exactly: words in order of rarity, prefix filter, size and positional filters, a bit-parity filter, then
verification of the Jaccard similarity on whole sets. A line is removed if an earlier line has an equal set or one of at
least the threshold's similarity.

A word is its 64-bit hash; in the order 55 bits of it stand below 7 bits of rarity (a logarithm of how often its hash bucket
occurs in the whole table; the bucket table has a fixed size), so that words sort by rarity and shuffle as numbers. Any common order makes the
prefix filter exact; rarity makes it fast.

Thousands of variants of one line must not become all their pairs, and one earlier partner is enough. So the sets of a hot
prefix word, one with ``hot`` sets or more, first meet the earliest of them; those that this does not settle choose the next
hub, round by round, while a round settles some. Only sets that this leaves open are joined with all sets by their prefixes.

Defined results: one row per row; a document is an id with a text, so texts under one id are told apart, and rows equal in both
are one document whose lines are repeated within it (they keep equal texts); blank lines are never duplicates and always
stay; a null text stays null and has no lines; rows with a null id stay as they are and are compared with nothing; an empty
table gives an empty result; lines of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import WORD, any_of, release, staged

THRESHOLD = 0.8
RARITY_BITS, FILTER_BITS, HOT_BITS = 18, 24, 20
#: Sets of so many words or more have 256 parity bits, smaller ones 64.
WIDE = 112
PARITY = ("bits", "bits_1", "bits_2", "bits_3")
_HASH = (1 << 55) - 1


def _plain(text: Column) -> Column:
    """A text with ASCII white space other than line ends as spaces; most texts have none and stay as they are."""
    some = any_of(F.contains(text, F.lit(c)) for c in "\t\x0b\f\r")
    return F.when(some, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)


def _bit(number: Column) -> Column:
    """A long with the one bit that a number's low six bits name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def _table(counts: DataFrame, bits: int, value: Column, kind: str, label: str) -> DataFrame:
    """One row with an array of 2**bits values from a frame (slot, ...), null where a slot is missing."""
    low_bits = bits // 2
    slots = counts.sparkSession.range(1 << bits).withColumnRenamed("id", "slot").join(counts, "slot", "left").select("slot", value.cast(kind).alias("v"))
    parts = slots.groupBy(F.shiftright("slot", low_bits).alias("high")).agg(F.array_sort(F.collect_list(F.struct("slot", "v")))["v"].alias("part"))
    whole = parts.agg(F.flatten(F.array_sort(F.collect_list(F.struct("high", "part")))["part"]).alias("a"))
    return staged(whole, label)


def _rarity(texts: DataFrame, bits: int) -> DataFrame:
    words = texts.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    # Eight neighbouring slots are counted in one row, so that a task's table of counts stays small.
    slot = F.col("slot")
    counts = words.select(F.xxhash64("w").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).groupBy(F.shiftright(slot, 3).alias("high"))
    counts = counts.agg(F.array(*(F.count_if(slot.bitwiseAND(F.lit(7)) == i) for i in range(8))).alias("n"))
    counts = counts.select(F.shiftleft("high", 3).alias("high"), F.posexplode("n").alias("low", "n")).select((F.col("high") + F.col("low")).alias("slot"), "n")
    value = F.coalesce(F.least(F.lit(127), F.floor(F.log2(F.col("n") + 1.0) * 3)), F.lit(0)).cast("long")
    return _table(counts, bits, F.shiftleft(value, 55), "long", "line-rarity")


def _hashed(line: Column) -> Column:
    """The distinct words of a line as hashes."""
    return F.array_except(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _slot(number: Column, bits: int) -> Column:
    return F.shiftright(number, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))


def _bit_table(numbers: DataFrame, number: Column, bits: int, label: str) -> DataFrame:
    """One row with a bit table of fixed size that holds some numbers; others may seem to be in it, none is missed."""
    marks = numbers.groupBy(_slot(number, bits).alias("slot")).agg(F.bit_or(_bit(number)).alias("m"))
    return _table(marks, bits - 6, F.coalesce("m", F.lit(0)), "long", label)


def _in_table(table: DataFrame, number: Column, bits: int) -> Column:
    return F.get(table.scalar(), _slot(number, bits).cast("int")).bitwiseAND(_bit(number)) != 0


def _parity(words: Column, n: Column) -> list[Column]:
    """The parity of a set's words by six bits of their hashes; of a large set also those of three of four classes of its words."""

    def of(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(_bit(w)))

    def part(k: int) -> Column:
        return F.when(n >= WIDE, of(F.filter(words, lambda w: w.bitwiseAND(F.lit(192)) == 64 * k))).otherwise(F.lit(0).cast("long"))

    return [of(words).alias("bits"), *(part(k).alias(f"bits_{k}") for k in (1, 2, 3))]


def _may_differ_by(most: Column) -> Column:
    """Whether parities allow that at most so many words are in one of the sets x and y only."""
    all_, *parts = (F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y")) for c in PARITY)
    rest = all_
    for p in parts:
        rest = rest.bitwiseXOR(p)
    fine = F.bit_count(rest) + sum((F.bit_count(p) for p in parts), F.lit(0)) <= most
    return (F.bit_count(all_) <= most) & ((F.least("n_x", "n_y") < WIDE) | fine)


def _sets(texts: DataFrame, threshold: float, rarity_bits: int) -> DataFrame:
    """The distinct sets (set, n, PARITY, doc_id, digest, line_no = first place, prefix = rarest words that a similar set must share)."""
    rarity = _rarity(texts, rarity_bits)
    n = F.size("words")
    rank = lambda w: F.coalesce(F.get(F.col("_rarity"), w.bitwiseAND(F.lit((1 << rarity_bits) - 1)).cast("int")), F.lit(0).cast("long")).bitwiseOR(w.bitwiseAND(F.lit(_HASH)))
    # The test reads the line and not its words: Spark would push one of the words below their making and cut each line twice.
    rows = _lines(texts).where(F.col("line").rlike(WORD)).select(F.struct("doc_id", "digest", "line_no").alias("at"), _hashed(F.col("line")).alias("words"))
    # A subquery may not stand in a lambda, but a column may. Read once and beside plain columns only, the plan folds it into the
    # lambda, so that the table is one value and not copied with every line.
    rows = rows.select("at", "words", n.alias("n"), *_parity(F.col("words"), n), rarity.scalar().alias("_rarity"))
    rows = rows.select("at", "n", *PARITY, F.sort_array(F.transform("words", rank)).alias("_o"))
    # A smaller set has no different set within the threshold.
    able = F.col("n") >= threshold / (1 - threshold) - 1e-9
    part = F.transform(F.slice("_o", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1), lambda k: k.bitwiseXOR(F.shiftright(k, 31)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    prefix = F.when(able, part).otherwise(F.array().cast("array<int>"))
    rows = rows.select("at", "n", F.xxhash64("_o").alias("sig"), *PARITY, prefix.alias("prefix"))
    distinct = rows.groupBy("sig", "n", *PARITY).agg(F.min("at").alias("at"), F.first("prefix").alias("prefix"))
    out = staged(distinct.select(F.monotonically_increasing_id().alias("set"), "n", *PARITY, "at.doc_id", "at.digest", "at.line_no", "prefix"), "line-sets")
    release(rarity)
    return out


def _fits(threshold: float, position: bool) -> Column:
    """Size, position and parity filters of two sets x and y."""
    n = {k: F.col(f"n_{k}") for k in "xy"}
    total = n["x"] + n["y"]
    need = F.ceil(total * (threshold / (1 + threshold)) - 1e-9)
    fits = F.least(n["x"], n["y"]) >= threshold * F.greatest(n["x"], n["y"]) - 1e-9
    if position:
        fits &= F.least(n["x"] - F.col("p_x"), n["y"] - F.col("p_y")) >= need
    return fits & _may_differ_by(total - 2 * need)


def _hub_pairs(sets: DataFrame, threshold: float, hot: int, rounds: int) -> DataFrame:
    """(set_x, set_y): sets y with the earliest set x of a hot prefix word that they may be similar to, round by round."""
    filters = ("set", "n", *PARITY)
    words = staged(sets.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") >= hot).select("key"), "line-hot")
    mark = F.xxhash64("key")
    marks = _bit_table(words, mark, HOT_BITS, "line-hot-marks")
    rows = sets.select(F.explode("prefix").alias("key"), "doc_id", *filters).where(_in_table(marks, mark, HOT_BITS)).join(words, "key")
    rows, found, before = staged(rows, "line-buckets"), None, 1
    for _ in range(rounds):
        hubs = rows.groupBy("key").agg(F.min(F.struct("doc_id", *(F.col(c).alias(f"{c}_x") for c in filters))).alias("_hub"), F.count("*").alias("_n")).where("_n > 1")
        hubs = staged(hubs.select("key", "_hub.*").drop("doc_id"), "line-hubs")
        pairs = rows.select("key", *(F.col(c).alias(f"{c}_y") for c in filters)).join(hubs, "key")
        pairs = staged(pairs.where((F.col("set_x") != F.col("set_y")) & _fits(threshold, False)).select("key", "set_x", "set_y"), "line-hub-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        # The next round is of the words whose hubs settled some.
        done = pairs.select(F.col("set_y").alias("set")).unionByName(hubs.select(F.col("set_x").alias("set"))).distinct()
        last, rows = rows, staged(rows.join(pairs.select("key").distinct(), "key", "left_semi").join(done, "set", "left_anti"), "line-buckets")
        release(last, hubs)
        many = pairs.count()
        if not many or many < before / 100:
            break
        before = many
    release(rows, words, marks)
    return found.select("set_x", "set_y")


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")


def _postings(marked: DataFrame, threshold: float, side: str) -> DataFrame:
    """(key, set, PARITY, place) of the prefix words of sets (set, n, PARITY, open, prefix): x is the smaller set of a pair, y the larger.

    A key is a word and a class of sizes, the doubling that the smaller set is in. The smaller set needs a shorter prefix, as the
    larger one has at least as many words; the larger set is in all classes of partners that its word's position allows.
    """
    n, p, both = F.col("n"), F.col("p"), (1 + threshold) / threshold
    if side == "x":
        short = n - F.ceil(n * (2 / both) - 1e-9).cast("int") + 1
        post = marked.select("set", "n", *PARITY, "open", _size_class(n).alias("class"), F.posexplode(F.slice("prefix", 1, short)).alias("p", "word"))
    else:
        classes = F.sequence(_size_class(F.ceil(n * threshold - 1e-9)), _size_class(n))
        post = marked.select("set", "n", *PARITY, "open", "prefix", F.explode(classes).alias("class")).select("set", "n", *PARITY, "open", "class", F.posexplode("prefix").alias("p", "word"))
        post = post.where(F.floor((n - p) * both + 1e-9) - n >= F.pow(F.lit(2.0), F.col("class")))
    place = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(p, 1).cast("long")).bitwiseOR(F.col("open").cast("long"))
    return post.select(F.hash("word", "class").alias("key"), *(F.col(c).alias(f"{c}_{side}") for c in ("set", *PARITY)), place.alias(f"place_{side}"))


def _prefix_pairs(sets: DataFrame, settled: DataFrame, threshold: float) -> DataFrame:
    """(set_x, set_y) of sets that share a prefix word and pass the filters, x not larger than y; one or both are open."""
    marked = sets.join(settled.withColumn("_settled", F.lit(1)), "set", "left").withColumn("open", F.col("_settled").isNull())
    place = lambda k: F.col(f"place_{k}")
    parts = {f"{name}_{k}": value for k in "xy" for name, value in (("n", F.shiftright(place(k), 32)), ("p", F.shiftright(place(k).bitwiseAND(F.lit(0xFFFFFFFF)), 1)))}
    some_open = place("x").bitwiseOR(place("y")).bitwiseAND(F.lit(1)) == 1
    pairs = _postings(marked, threshold, "x").join(_postings(marked, threshold, "y"), "key").where(some_open).withColumns(parts)
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("set_x") < F.col("set_y")))
    return pairs.where(once).where(_fits(threshold, True)).select("set_x", "set_y")


def _later(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The sets that come later in a verified pair. Only lines of candidate sets are cut into words again."""
    pairs = staged(pairs.distinct(), "line-pairs")
    ids = pairs.select(F.explode(F.array("set_x", "set_y")).alias("set")).distinct()
    wanted = staged(sets.select("set", "doc_id", "digest", "line_no").join(ids, "set"), "line-wanted")
    document, place = F.xxhash64("doc_id", "digest"), F.xxhash64("doc_id", "digest", "line_no")
    marks = _bit_table(wanted.select(F.explode(F.array(document, place)).alias("m")), F.col("m"), FILTER_BITS, "line-marks")
    lines = _lines(texts.where(_in_table(marks, document, FILTER_BITS))).where(_in_table(marks, place, FILTER_BITS))
    lines = lines.select("doc_id", "digest", "line_no", _hashed(F.col("line")).alias("words"))
    whole = staged(lines.join(wanted, ["doc_id", "digest", "line_no"]).select("set", "words", F.struct("doc_id", "digest", "line_no").alias("at")), "line-whole")
    a, b = (whole.select(*(F.col(c).alias(f"{c}_{k}") for c in ("set", "at", "words"))) for k in "xy")
    both = pairs.join(b, "set_y").join(a, "set_x")
    common = F.size(F.array_intersect("words_x", "words_y"))
    both = both.withColumn("_c", common).where(F.col("_c") >= threshold * (F.size("words_x") + F.size("words_y") - F.col("_c")) - 1e-9)
    out = staged(both.select(F.when(F.col("at_x") < F.col("at_y"), F.col("set_y")).otherwise(F.col("set_x")).alias("set")).distinct(), "line-later")
    release(pairs, wanted, marks, whole)
    return out


def later_sets(texts: DataFrame, threshold: float = THRESHOLD, rarity_bits: int = RARITY_BITS, hot: int = 256, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """For a frame (doc_id, text): the distinct sets, and the sets that an earlier similar one precedes."""
    texts = texts.select("doc_id", F.xxhash64("text").alias("digest"), _plain(F.col("text")).alias("text"))
    sets = _sets(texts, threshold, rarity_bits)
    settled = _later(_hub_pairs(sets, threshold, hot, rounds), sets, texts, threshold)
    return sets, settled.unionByName(_later(_prefix_pairs(sets, settled, threshold), sets, texts, threshold)).distinct()


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, rarity_bits: int = RARITY_BITS, doc_id: str = "doc_id", text: str = "text", keep_columns: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_kept, n_first, n_near) of every row, or with ``keep_columns`` the rows with their new text.

    All counts are of lines with a word: n_first are the first of their set, of which n_near have a similar earlier set and go
    as well. With ``keep_columns`` documents that lose all their lines go.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    sets, later = later_sets(rows, threshold, rarity_bits)
    judged = sets.select("set", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "line_no").join(later.withColumn("_later", F.lit(True)), "set", "left")
    kept = judged.groupBy("_id", "_digest").agg(F.array_sort(F.collect_list(F.when(F.col("_later").isNull(), F.col("line_no")))).alias("_kept"), F.count("*").alias("_first"))
    columns, n_worded = docs.columns, "_worded"
    while n_worded in columns:
        n_worded += "_"
    # Lines with a word are counted once and before the join, as several results read the number.
    docs = docs.withColumn(n_worded, F.size(F.filter(F.split(docs[text], "\n"), lambda line: line.rlike(WORD))))
    both = docs.join(kept, (docs[doc_id] == kept["_id"]) & (F.xxhash64(docs[text]) == kept["_digest"]), "left")
    have = F.coalesce(kept["_kept"], F.array().cast("array<int>"))
    stay = F.filter(F.split(docs[text], "\n"), lambda line, i: ~line.rlike(WORD) | F.array_contains(have, i))
    new = F.when(docs[doc_id].isNull() | (docs[n_worded] == F.size(have)), docs[text]).otherwise(F.array_join(stay, "\n"))
    if keep_columns:
        alive = docs[doc_id].isNull() | docs[text].isNull() | (F.size(have) > 0) | ~docs[text].rlike(WORD)
        return both.where(alive).select(*(new.alias(c) if c == text else docs[c] for c in columns))
    n_lines = F.coalesce(docs[n_worded], F.lit(0)).cast("long")
    n_kept = F.when(docs[doc_id].isNull(), n_lines).otherwise(F.size(have).cast("long"))
    n_first = F.when(docs[doc_id].isNull(), n_lines).otherwise(F.coalesce(kept["_first"], F.lit(0)).cast("long"))
    return both.select(docs[doc_id].alias("doc_id"), new.alias("text"), n_lines.alias("n_lines"), n_kept.alias("n_kept"), n_first.alias("n_first"), (n_first - n_kept).alias("n_near"))
