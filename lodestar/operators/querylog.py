"""Understanding of a table of search queries: corrections, expansion, places, negations, labels, attributes.

Dictionaries and patterns are small tables that the caller gives; every function adds columns to queries (query_id, text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.common import blank, edges, edges_of, matches, true
from lodestar.functions.text import keywords, normalise_query, org_key, phonetic_code
from lodestar.operators.rules import match_rules


def tokens(queries: DataFrame, stop: list[str] = (), text: str = "text") -> DataFrame:
    """(query_id, pos, token) of the normalised text's words."""
    return queries.select("query_id", F.posexplode(F.filter(F.split(normalise_query(text), r"\s+"), lambda w: w != "")).alias("pos", "token"))


def correct_typos(tokens_: DataFrame, dictionary: DataFrame, vocabulary: DataFrame, stop: list[str] = ()) -> DataFrame:
    """Adds ``corrected``: from the dictionary (wrong, right), else the nearest vocabulary word (word) within two edits (one for
    words under six letters), else the token. Words under four letters, stop words and known words stay.

    Distinct tokens meet words in blocks of equal length give or take two and an equal deletion key, so no pair is missed that
    differs by at most two edits at small lengths; ties go to the first word by code point.
    """
    distinct = tokens_.select("token").distinct()
    known = distinct.join(F.broadcast(dictionary.select(F.col("wrong").alias("token"), "right")), "token", "left")
    open_ = known.where(F.col("right").isNull() & (F.length("token") >= 4) & ~F.col("token").isin(list(stop) or [""]))
    vocab = vocabulary.select("word").distinct()
    open_ = open_.join(vocab.select(F.col("word").alias("token")), "token", "left_anti").select("token")
    reach = F.when(F.length("token") < 6, 1).otherwise(2)
    # With at most two edits, one of three consecutive pieces of the word stands in the token, moved by at most two places.
    w = vocab.withColumn("_n", F.length("word")).where("_n >= 3").withColumn("_a", F.floor(F.col("_n") / 3).cast("int"))
    pieces = F.array(
        F.struct(F.lit(1).alias("at"), F.substring("word", 1, F.col("_a")).alias("p")),
        F.struct((F.col("_a") + 1).alias("at"), F.substring("word", F.col("_a") + 1, F.col("_a")).alias("p")),
        F.struct((2 * F.col("_a") + 1).alias("at"), F.substring("word", 2 * F.col("_a") + 1, F.col("_n")).alias("p")),
    )
    w = w.select("word", "_n", F.explode(pieces).alias("s")).select("word", "_n", F.col("s.at").alias("_at"), F.col("s.p").alias("_p"))
    sizes = F.sequence(F.lit(1), F.length("token"))
    grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("token"), i, n).alias("p")))))
    t = open_.select("token", F.explode(grams).alias("g")).select("token", F.col("g.i").alias("_i"), F.col("g.p").alias("_p"))
    pairs = t.join(w, "_p").where((F.abs(F.col("_i") - F.col("_at")) <= 2) & (F.abs(F.length("token") - F.col("_n")) <= reach)).select("token", "word").distinct()
    near = pairs.withColumn("_d", F.levenshtein("token", "word", 2)).where((F.col("_d") >= 0) & (F.col("_d") <= reach))
    best = near.groupBy("token").agg(F.min_by("word", F.struct("_d", "word")).alias("_best"))
    map_ = known.join(best, "token", "left").select("token", F.coalesce("right", "_best", "token").alias("corrected"))
    return tokens_.join(map_, "token")


def correct_phonetic(tokens_: DataFrame, dictionary: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds ``corrected``: from the dictionary, else the first vocabulary word with the same code, else the token."""
    map_ = dictionary.select(F.col("wrong").alias("token"), "right")
    by_code = vocabulary.select("word", phonetic_code("word").alias("_c")).groupBy("_c").agg(F.min("word").alias("_w"))
    distinct = tokens_.select("token").distinct().withColumn("_c", phonetic_code("token"))
    found = distinct.join(F.broadcast(map_), "token", "left").join(by_code, "_c", "left").select("token", F.coalesce("right", "_w", "token").alias("corrected"))
    return tokens_.join(found, "token")


def expand(tokens_: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, terms): the tokens with their synonyms, forward and backward. synonyms: (term, synonym)."""
    both = synonyms.select("term", "synonym").unionByName(synonyms.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"))).distinct()
    more = tokens_.join(F.broadcast(both), tokens_["token"] == both["term"]).select("query_id", F.col("synonym").alias("token"))
    return tokens_.select("query_id", "token").unionByName(more).groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("terms"))


def extract_location(queries: DataFrame, gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """Adds place and region_wide: the gazetteer's first alias (by ordinal) that stands in the text. gazetteer: (ordinal, alias, place, region_wide).

    Texts are cut into runs of one to three words, which meet aliases in an equi-join.
    """
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}' -]", " "), r"\s+")
    at = F.sequence(F.lit(1), F.size("_w"))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.array_join(F.slice(F.col("_w"), i, n), " "))))
    flat = queries.select("query_id", words.alias("_w")).select("query_id", F.explode(F.array_distinct(runs)).alias("_run"))
    g = gazetteer.select(F.lower("alias").alias("_run"), "ordinal", "place", "region_wide")
    found = flat.join(F.broadcast(g), "_run").groupBy("query_id").agg(F.min(F.struct("ordinal", "place", "region_wide")).alias("_g"))
    return queries.join(found, "query_id", "left").withColumn("place", F.coalesce("_g.place", F.lit(""))).withColumn("region_wide", F.coalesce("_g.region_wide", F.lit(False))).drop("_g")


def negative_terms(c: str, skip: list[str] = (), most: int = 10) -> Column:
    """Words after not, no, without or except, and words before -free or " free"; distinct, some skipped, at most ten."""
    text = F.lower(F.coalesce(F.col(c), F.lit("")))
    after = F.regexp_extract_all(text, F.lit(edges(r"\b(?:not|no|without|except|excluding)\s+(?:a\s+|any\s+|the\s+)?(\p{L}[\p{L}'-]+)")), F.lit(1))
    before = F.regexp_extract_all(text, F.lit(edges(r"\b(\p{L}{3,})[- ]free\b")), F.lit(1))
    found = F.array_distinct(F.concat(after, before))
    return F.slice(F.array_except(found, F.array(*map(F.lit, skip))) if skip else found, 1, most)


def flag_critical(queries: DataFrame, keyword: str, implicit: str, third_party: str, descriptor: str, first_person: str, text: str = "text") -> DataFrame:
    """Adds critical, third_party: by keyword or implicit pattern, unless a descriptor explains the word and nobody speaks of themselves."""
    hit = matches(text, keyword) | matches(text, implicit)
    return queries.withColumn("critical", hit & (~matches(text, descriptor) | matches(text, first_person))).withColumn("third_party", hit & matches(text, third_party))


def match_alias(queries: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """Adds alias_item: the item of the first keyword that is an alias, else of the whole phrase."""
    words = F.transform(keywords(text), lambda w: w)
    n = F.size(words)
    entries = queries.select("query_id", F.posexplode(F.concat(words, F.array(F.trim(F.lower(text))))).alias("_i", "_a"), n.alias("_n"))
    a = aliases.select(F.lower("alias").alias("_a"), "item_id")
    found = entries.join(F.broadcast(a), "_a").groupBy("query_id").agg(F.min(F.struct("_i", "item_id")).alias("_f"))
    return queries.join(found, "query_id", "left").withColumn("alias_item", F.col("_f.item_id")).drop("_f")


def score_labels(queries: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, label, score): points of all patterns that match; a pattern with ``requires`` counts only beside that label.

    patterns: (label, pattern, points, requires). Each distinct text meets the patterns whose literals it holds.
    """
    texts = queries.select(F.col(text).alias("_t")).where(~blank("_t", True)).distinct()
    numbered = patterns.withColumn("_rule", F.struct("label", "pattern", "points", "requires"))
    hits = match_rules(texts, "_t", {None: F.col("_t")}, numbered, "_rule").select("_t", "_rule.label", "_rule.points", "_rule.requires")
    have = F.collect_set("label").over(Window.partitionBy("_t"))
    kept = hits.withColumn("_h", have).where(F.col("requires").isNull() | F.array_contains("_h", F.col("requires")))
    scores = kept.groupBy("_t", "label").agg(F.sum("points").alias("score"))
    return queries.select("query_id", F.col(text).alias("_t")).join(scores, "_t").select("query_id", "label", F.round("score", 6).alias("score"))


def top_labels(queries: DataFrame, scores: DataFrame, default: str = "general", least: float = 0.2, share: float = 0.4) -> DataFrame:
    """Primary, secondary and tertiary label with confidence s / (s + 1.5); the lower ones need 0.2 and 40 % of the first."""
    c = scores.withColumn("confidence", F.round(F.col("score") / (F.col("score") + 1.5), 2))
    w = Window.partitionBy("query_id")
    rows = c.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "label"))).withColumn("_top", F.max("confidence").over(w)).where("_k <= 3")
    rows = rows.where((F.col("_k") == 1) | ((F.col("confidence") >= least) & (F.col("confidence") >= share * F.col("_top"))))
    names = ((1, "primary"), (2, "secondary"), (3, "tertiary"))
    wide = rows.groupBy("query_id").agg(*(F.max(F.when(F.col("_k") == k, F.col("label"))).alias(n) for k, n in names), *(F.max(F.when(F.col("_k") == k, F.col("confidence"))).alias(f"{n}_confidence") for k, n in names))
    return queries.select("query_id").join(wide, "query_id", "left").withColumn("primary", F.coalesce("primary", F.lit(default))).withColumn("primary_confidence", F.coalesce("primary_confidence", F.lit(0.0)))


def sub_labels(queries: DataFrame, labels: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, sub_labels): sub-labels under the query's labels whose pattern matches. patterns: (parent, sub_label, pattern)."""
    j = labels.select("query_id", F.col("label").alias("parent")).join(queries.select("query_id", F.col(text).alias("_t")), "query_id").join(F.broadcast(patterns), "parent")
    return j.where(true(F.regexp_like("_t", F.concat(F.lit("(?iu)"), edges_of("pattern"))))).groupBy("query_id").agg(F.array_sort(F.collect_set("sub_label")).alias("sub_labels"))


def first_label(text: str | Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern in order that matches, else null."""
    return reduce(lambda out, p: F.when(matches(text, p[1]), p[0]).otherwise(out), reversed(patterns), F.lit(None).cast("string"))


def attributes(text: str | Column, patterns: list[tuple[str, str]]) -> Column:
    """All labels whose pattern matches, in order."""
    return F.array_compact(F.array(*(F.when(matches(text, p), name) for name, p in patterns)))


#: Detectors of the person and the situation a query speaks of: column -> ordered patterns.
DETECTORS: dict[str, list[tuple[str, str]]] = {
    "gender": [("women", r"\b(wom[ae]n|girls?|mothers?|moms?|female|pregnan\w+)\b"), ("men", r"\b(men|man|boys?|fathers?|dads?|male)\b")],
    "age": [("child", r"\b(child(ren)?|kids?|toddlers?|bab(y|ies))\b"), ("youth", r"\b(youth|teen\w*|adolescents?)\b"), ("senior", r"\b(seniors?|elder\w*|older adults?)\b"), ("adult", r"\badults?\b")],
    "urgency": [("now", r"\b(now|tonight|today|immediately|emergency|urgent\w*|asap)\b"), ("soon", r"\b(this week|soon|tomorrow)\b")],
    "student": [("student", r"\b(student|college|university|campus)\b")],
    "family": [("relative", r"\b(my|our) (son|daughter|husband|wife|partner|mother|father|brother|sister|parent|child|kid|friend)\b")],
    "language": [("french", r"\b(french|français\w*)\b"), ("spanish", r"\b(spanish|español\w*)\b"), ("german", r"\b(german|deutsch)\b")],
    "exclusion": [("no faith", r"\b(non[- ]?religious|secular|not (religious|faith)[- ]?based)\b")],
}


def detect(queries: DataFrame, detectors: dict[str, list[tuple[str, str]]] | None = None, text: str = "text") -> DataFrame:
    """Adds one column per detector."""
    return queries.withColumns({name: first_label(text, p) for name, p in (detectors or DETECTORS).items()})


def query_context(queries: DataFrame, needs: dict[str, list[str]], text: str = "text", contexts: dict[str, str] | None = None) -> DataFrame:
    """Adds who searches, for whom, in which contexts, and the needs that labels imply. needs: label -> implied needs; contexts: name -> pattern."""
    relative = matches(text, r"\b(my|our) (son|daughter|husband|wife|partner|mother|father|brother|sister|parent|child|kid|friend)\b")
    helper = matches(text, r"\b(client|patient|resident|caseworker|social worker)s?\b")
    out = queries.withColumn("searcher", F.when(relative, "relative").when(helper, "professional").otherwise("self"))
    out = out.withColumn("target", F.when(relative | helper, F.regexp_extract(F.lower(text), edges(r"\b(son|daughter|husband|wife|partner|mother|father|brother|sister|parent|child|kid|friend|client|patient)\b"), 1)).otherwise("self"))
    implied = F.array(*(F.when(F.array_contains("labels", label), F.array(*map(F.lit, n))) for label, n in needs.items()))
    named = [F.when(matches(text, p), c) for c, p in (contexts or {}).items()]
    out = out.withColumn("contexts", F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))
    return out.withColumn("needs", F.array_distinct(F.flatten(F.array_compact(implied))))


def org_of(name: str | Column, patterns: list[tuple[str, str]] = ()) -> Column:
    """Organisation key: em-dash prefix, else the first pattern's name, else the first two longer words."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.contains(" — "), org_key(c)).otherwise(F.coalesce(first_label(c, list(patterns)), org_key(c)))


def topic_flags(queries: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    return queries.withColumns({name: matches(text, p) for name, p in patterns.items()})


def cache_key(table_hash: Column, mode: Column, text: Column, place: Column) -> Column:
    """hash:mode:query, and the place if there is one."""
    return F.concat_ws(":", table_hash, mode, normalise_query(text), F.when(~blank(place), F.lower(place)))


def merge_labels(pattern: DataFrame, external: DataFrame, valid: list[str], critical: str, margin: float = 0.1, bars: tuple[float, float] = (0.5, 0.6), least: float = 0.4) -> DataFrame:
    """Pattern labels improved by an external label table (query_id, label, confidence, sub_labels).

    Invalid labels go, confidences are clamped to 0..1. The best external label replaces the primary if it is surer by the
    margin; a critical primary stays unless the external label reaches the second bar, and becomes critical only from the first
    bar on and with first-person words. The next external label replaces a weaker secondary. Sub-labels are united.
    """
    e = external.where(F.col("label").isin(valid)).withColumn("_c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    e = e.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_c"), "label"))).where("_k <= 2")
    wide = e.groupBy("query_id").agg(*(F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"_{c.strip('_')}{k}") for k in (1, 2) for c in ("label", "_c")), F.array_distinct(F.flatten(F.collect_list("sub_labels"))).alias("_subs"))
    j = pattern.join(wide, "query_id", "left")
    surer = true(F.col("_c1") > F.col("primary_confidence") + margin)
    leave = (F.col("primary") != critical) | true(F.col("_c1") >= bars[1])
    enter = true(F.col("_label1") != critical) | (true(F.col("_c1") >= bars[0]) & true(F.col("first_person")))
    take = surer & leave & enter
    second = true(F.col("_c2") >= least) & (F.col("secondary_confidence").isNull() | true(F.col("_c2") > F.col("secondary_confidence")))
    return j.select(
        "query_id",
        F.when(take, F.col("_label1")).otherwise(F.col("primary")).alias("primary"),
        F.when(take, F.col("_c1")).otherwise(F.col("primary_confidence")).alias("primary_confidence"),
        F.when(second, F.col("_label2")).otherwise(F.col("secondary")).alias("secondary"),
        F.when(second, F.col("_c2")).otherwise(F.col("secondary_confidence")).alias("secondary_confidence"),
        F.array_union(F.coalesce("sub_labels", F.array().cast("array<string>")), F.coalesce("_subs", F.array().cast("array<string>"))).alias("sub_labels"),
    )
