"""Maintenance of item tables: entity resolution, merging, change requests, normalisation, flags, tags, confidence.

All functions take and give frames; tables are replaced by write-and-swap, never updated in place. ``now`` is an argument.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.common import any_of, blank, blank_array, contains, matches, top, true, upsert
from lodestar.functions.text import digits, first_filled, format_phone, slug

MERGED = ("description", "eligibility", "contact", "phone", "email", "address", "website_url", "hours_of_operation")
SKIP, CREATE, ENRICH = "skipped", "created", "enriched"


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over both lengths; bits of a number are the places of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = v = (1 << len(a)) - 1
    for c in b:
        m = places.get(c, 0)
        v = (v + (v & m) | v & ~m) & every
    return 2.0 * (len(a) - v.bit_count()) / (len(a) + len(b)) if a or b else 1.0


def most_edits(n: Column, m: Column, threshold: float) -> Column:
    """Most inserted and deleted characters between names of n and m characters whose ratio is above the threshold.

    The ratio is 1 - edits / (n + m); edits are odd or even as n + m is. Negative if no such names can pass.
    """
    k = F.ceil((1.0 - threshold) * (n + m) - 1e-9).cast("int") - 1
    return k - F.pmod(k - n - m, F.lit(2))


def _segment_size(m: Column, edits: Column) -> Column:
    """The longest of 3, 2 and 1 characters by which a name of m characters has more segments than edits can break."""
    return F.when(F.floor(m / 3) > edits, 3).when(F.floor(m / 2) > edits, 2).otherwise(1)


def name_candidates(wanted: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(_a, _b) of wanted (_a) and known names (_b) that can have a ratio above the threshold; none that has is left out.

    A known name is cut into segments. An edit breaks one at most, so of k + 1 segments one stands unchanged in a wanted name that is
    k edits away, shifted by no more than the edits that the lengths leave on either side. Names meet by the k + 1 rarest segments of the
    known name, in length classes. Pairs that share too few characters, each counted as often as it occurs in both, are dropped.
    """
    width = 8
    a = wanted.select("_a", F.length("_a").alias("_n"))
    b = names.select("_b", F.length("_b").alias("_m"))
    cut = b.withColumn("_g", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("_m") / F.col("_g")).cast("int") - 1, F.lit(0)))))
    # Only the segment sizes that a partner of some length can call for; so single characters serve short names only.
    share = threshold / (2.0 - threshold)
    most, fewest = (most_edits(n, F.col("_m"), threshold) for n in (F.floor(F.col("_m") / share + 1e-9), F.ceil(share * F.col("_m") - 1e-9)))
    needed = (F.col("_g") >= _segment_size(F.col("_m"), most + 1)) & (F.col("_g") <= _segment_size(F.col("_m"), fewest - 1))
    cut = cut.where(needed & ((F.col("_i") + 1) * F.col("_g") <= F.col("_m"))).withColumn("_at", F.col("_i") * F.col("_g")).withColumn("_s", F.substr("_b", F.col("_at") + 1, F.col("_g")))
    counts = cut.groupBy("_s").agg(F.count("*").alias("_df"))
    rarity = Window.partitionBy("_b", "_g").orderBy("_df", "_s", "_at")
    cut = cut.join(counts, "_s").withColumn("_k", F.row_number().over(rarity) - 1).withColumn("_class", F.floor(F.col("_m") / width))
    # A name that can pass has between ``share`` and 1 / ``share`` times as many characters.
    low, high = F.ceil(share * F.col("_n") - 1e-9), F.floor(F.col("_n") / share + 1e-9)
    runs = a.withColumn("_g", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("_n >= _g").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_g"))))
    runs = runs.withColumn("_s", F.substr("_a", F.col("_q") + 1, F.col("_g"))).withColumn("_class", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    n, m = F.col("x._n"), F.col("y._m")
    edits, shift = most_edits(n, m, threshold), F.col("x._q") - F.col("y._at")
    fits = (edits >= 0) & (F.col("y._k") <= edits) & (F.col("y._g") == _segment_size(m, edits)) & (F.abs(shift) + F.abs(n - m - shift) <= edits)
    x, y = runs.alias("x"), cut.alias("y")
    pairs = x.join(y, (F.col("x._s") == F.col("y._s")) & (F.col("x._class") == F.col("y._class")) & fits).select("_a", "_b").distinct()
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))
    own, other = chars("_a"), chars("_b")
    both = F.aggregate(F.array_distinct(own), F.lit(0), lambda t, c: t + F.least(F.size(F.filter(own, lambda z: z == c)), F.size(F.filter(other, lambda z: z == c))))
    n, m = F.length("_a"), F.length("_b")
    return pairs.where(n + m - 2 * both <= most_edits(n, m, threshold))


def match_entities(raw: DataFrame, items: DataFrame, threshold: float = 0.85, key: str = "id") -> DataFrame:
    """(raw_id, item_id, similarity): exact service id, else the active item with the most similar name above the threshold.

    The best match wins, then the least id. Equal names are joined; the others meet through the index of segments (name_candidates) and
    are verified by their longest common subsequence. No pair above the threshold is left out.
    """
    live = items.where(true(F.col("is_active")))
    exact = raw.where(~blank("service_id")).join(live.select("service_id", F.col(key).alias("item_id")), "service_id").groupBy("raw_id").agg(F.min("item_id").alias("item_id")).withColumn("similarity", F.lit(1.0))
    rest = raw.join(exact.select("raw_id"), "raw_id", "left_anti").select("raw_id", F.lower(F.trim("name")).alias("_n")).where(~blank("_n"))
    own = live.select(F.col(key).alias("item_id"), F.lower(F.trim("name")).alias("_m")).where(~blank("_m")).groupBy("_m").agg(F.min("item_id").alias("item_id"))
    same = rest.join(own.withColumnRenamed("_m", "_n"), "_n").select("raw_id", "item_id", F.lit(1.0).alias("similarity"))
    wanted = rest.select(F.col("_n").alias("_a")).distinct().join(own.select(F.col("_m").alias("_a")), "_a", "left_anti")
    pairs = name_candidates(wanted, own.select(F.col("_m").alias("_b")), threshold).select("_a", F.col("_b").alias("_m"))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    scored = pairs.withColumn("similarity", ratio("_a", "_m")).where(F.col("similarity") > threshold).join(own, "_m")
    best = scored.groupBy("_a").agg(F.max_by(F.struct("item_id", "similarity"), F.struct("similarity", -F.col("item_id"))).alias("_b"))
    best = rest.join(best, F.col("_n") == F.col("_a")).select("raw_id", "_b.*").unionByName(same)
    best = best.groupBy("raw_id").agg(F.max_by(F.struct("item_id", "similarity"), F.struct("similarity", -F.col("item_id"))).alias("_b")).select("raw_id", "_b.*")
    return exact.unionByName(best)


def fill_empty(items: DataFrame, new: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Blank fields take the new row's value; adds changed fields as a map of field -> new value."""
    n = new.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_n_{f}") for f in fields))
    j = items.join(n, F.col(key) == F.col("_k"), "left")
    take = {f: blank(f, True) & ~blank(f"_n_{f}", True) for f in fields}
    changed = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.when(take[f], F.col(f"_n_{f}")) for f in fields))), lambda _, v: v.isNotNull())
    return j.select(*(F.when(take[c], F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in items.columns), changed.alias("changed_fields"))


def content_hash(c: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 256)


def detect_changes(old: DataFrame, new: DataFrame, key: str = "url", text: str = "text") -> DataFrame:
    """(url, status): new, changed, unchanged or gone."""
    a = old.select(F.col(key).alias("_a"), content_hash(text).alias("_h"))
    b = new.select(F.col(key).alias("_b"), content_hash(text).alias("_g"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_h") == F.col("_g"), "unchanged").otherwise("changed")
    return j.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def merge_tags(old: str | Column, new: str | Column) -> Column:
    """Union of tags in sorted order; it never shrinks."""
    e = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(F.col(old) if isinstance(old, str) else old, e), F.coalesce(F.col(new) if isinstance(new, str) else new, e)))


def resolve_upsert(raw: DataFrame, items: DataFrame, review: bool, fields: list[str] = MERGED, default_confidence: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items after, change requests, outcome per raw row) of discovery records against items, by name.

    Blank names and unchanged pages are skipped; a match is enriched where it has blanks, else skipped; the rest is created.
    Raw rows of one name are folded first. In review mode items stay as they are and requests are pending, else approved.
    """
    named = raw.withColumn("_n", F.lower(F.trim("name")))
    first = named.where(~blank("_n")).withColumn("_k", F.row_number().over(Window.partitionBy("_n").orderBy("raw_id")))
    live = items.where(true(F.col("is_active"))).withColumn("_n", F.lower(F.trim("name")))
    live = top(live, ["_n"], [F.col("id")], 1).select("_n", F.col("id").alias("_id"), F.col("page_hash").alias("_old"), *(F.col(f).alias(f"_o_{f}") for f in fields))
    j = first.join(live, "_n", "left")
    gaps = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.when(blank(f"_o_{f}", True) & ~blank(f, True), F.col(f)) for f in fields))), lambda _, v: v.isNotNull())
    outcome = F.when(F.col("_k") > 1, SKIP).when(F.col("_id").isNull(), CREATE).when(F.col("page_hash").eqNullSafe(F.col("_old")) & F.col("page_hash").isNotNull(), SKIP).when(F.size(gaps) > 0, ENRICH).otherwise(SKIP)
    judged = j.withColumn("_gaps", gaps).withColumn("outcome", outcome)
    blanks = named.where(blank("_n")).select("raw_id", F.lit(None).cast("long").alias("item_id"), F.lit(SKIP).alias("outcome"))
    outcomes = judged.select("raw_id", F.col("_id").cast("long").alias("item_id"), "outcome").unionByName(blanks)
    proposed = F.when(F.col("outcome") == CREATE, F.to_json(F.struct("name", *fields))).otherwise(F.to_json("_gaps"))
    requests = judged.where(F.col("outcome") != SKIP).select("raw_id", F.col("_id").alias("item_id"), F.when(F.col("outcome") == CREATE, "create").otherwise("update").alias("change_type"), proposed.alias("proposed"), F.lit("pending" if review else "approved").alias("status"))
    if review:
        return items, requests, outcomes
    patch = judged.where(F.col("outcome") == ENRICH).select(F.col("_id").alias("id"), *(F.col("_gaps")[f].alias(f) for f in fields), "page_hash")
    after = upsert(items, patch, ["id"], {f: F.coalesce(F.col(f"d.{f}"), F.col(f"b.{f}")) for f in fields})
    created = judged.where(F.col("outcome") == CREATE).select("name", *fields, "page_hash", F.lit(default_confidence).alias("confidence_score"), F.lit(True).alias("is_active"))
    return after.unionByName(created, allowMissingColumns=True), requests, outcomes


def unique_slug(df: DataFrame, existing: DataFrame, name: str = "name", key: str = "id", size: int = 200) -> DataFrame:
    """Adds ``slug``; a name whose slug is taken gets -2, -3 and so on in order of id, past those that exist."""
    base = df.withColumn("_s", slug(name, size))
    taken = existing.select(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias("_s"), F.coalesce(F.nullif(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 2), F.lit("")).cast("int"), F.lit(1)).alias("_n"))
    most = taken.groupBy("_s").agg(F.max("_n").alias("_most"))
    nth = F.row_number().over(Window.partitionBy("_s").orderBy(key))
    rows = base.join(most, "_s", "left").withColumn("_i", nth + F.coalesce("_most", F.lit(0)))
    return rows.withColumn("slug", F.when(F.col("_i") == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", F.col("_i").cast("string")))).drop("_s", "_most", "_i")


def diff_rows(old: DataFrame, new: DataFrame, columns: list[str], key: str = "id", now: Column | None = None) -> DataFrame:
    """History rows (id, change_type, changed_fields field -> {from, to}) of created, updated, deactivated and restored rows."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    entries = F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("key"), F.struct(F.col(f"a.{c}").cast("string").alias("from"), F.col(f"b.{c}").cast("string").alias("to")).alias("value"))) for c in columns))
    changed = F.map_from_entries(F.array_compact(entries))
    was, is_ = (true(F.col(f"{t}.is_active")) if "is_active" in old.columns else F.lit(True) for t in "ab")
    kind = F.when(F.col(f"a.{key}").isNull(), "created").when(F.col(f"b.{key}").isNull(), "removed").when(was & ~is_, "deactivated").when(~was & is_, "restored").otherwise("updated")
    out = j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), kind.alias("change_type"), changed.alias("changed_fields")).where(F.size("changed_fields") > 0)
    return out.withColumn("changed_at", now) if now is not None else out


def apply_changes(items: DataFrame, changes: DataFrame, fields: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(items after, result per change) of bulk updates (id, fields map); '' sets null; unknown ids fail."""
    c = changes.select(F.col(key).alias("_k"), F.col("fields").alias("_f"))
    j = items.join(c, F.col(key) == F.col("_k"), "left")
    new = [F.when(true(F.map_contains_key("_f", f)), F.nullif(F.col("_f")[f], F.lit("")).cast(items.schema[f].dataType)).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in items.columns]
    done = c.join(items.select(F.col(key).alias("_k"), F.lit(True).alias("_there")), "_k", "left").select(F.col("_k").alias(key), F.col("_there").isNotNull().alias("ok"))
    return j.select(*new), done


def set_active(items: DataFrame, ids: DataFrame, active: bool, key: str = "id") -> DataFrame:
    """Deactivate or restore the rows of an id table."""
    j = items.join(ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return j.select(*(F.when(F.col("_k").isNotNull(), F.lit(active)).otherwise(F.col(c)).alias(c) if c == "is_active" else F.col(c) for c in items.columns))


def confidence_simple() -> Column:
    """Confidence at edit time: 50 and a bonus per filled field, 100 at most."""
    parts = [(~blank("phone"), 10), (~blank("email"), 5), (~blank("website_url"), 5), (F.length("description") > 50, 10), (~blank("eligibility"), 5), (~blank_array("process_steps"), 5), (~blank("hours_of_operation"), 5), (~blank("address"), 5)]
    return F.least(F.lit(100), F.lit(50) + reduce(lambda a, p: a + F.when(true(p[0]), p[1]).otherwise(0), parts, F.lit(0)))


def confidence_sourced(now: Column, bonus: dict[str, int], penalties: dict[str, tuple[Column, int]], base: int = 40, sources: str = "field_sources", stale_days: int = 180, checked: str = "last_checked") -> Column:
    """Confidence from provenance: base, a bonus per filled field that names its source, penalties, minus 10 when stale; 0 to 100."""
    total = F.lit(base)
    for f, points in bonus.items():
        total = total + F.when(~blank(F.col(f).cast("string"), True) & true(F.map_contains_key(sources, f)), points).otherwise(0)
    for condition, points in penalties.values():
        total = total - F.when(true(condition), points).otherwise(0)
    total = total - F.when(true(F.col(checked) < now - F.make_dt_interval(F.lit(stale_days))), 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def enhance_tags(text: Column, place: Column, old: Column, keywords: dict[str, list[str]], places: dict[str, list[str]]) -> Column:
    """Tags whose keyword stands as a word in the text or whose place is contained in the location, with the old ones, sorted."""
    found = [F.when(any_of(matches(text, rf"\b{k}\b") for k in words), tag) for tag, words in keywords.items()]
    found += [F.when(any_of(contains(place, k) for k in words), tag) for tag, words in places.items()]
    return F.filter(merge_tags(old, F.array_compact(F.array(*found))), lambda t: F.length(t) > 1)


def tags_changed(old: Column, new: Column) -> Column:
    e = F.array().cast("array<string>")
    return (F.size(F.array_except(F.coalesce(old, e), new)) > 0) | (F.size(F.array_except(new, F.coalesce(old, e))) > 0)


def tags_from_text(text: Column, old: Column, patterns: list[tuple[str, str]]) -> Column:
    """Old tags and then those whose pattern matches, without repeats that differ in case only."""
    e = F.coalesce(old, F.array().cast("array<string>"))
    low = F.transform(e, F.lower)
    new = F.filter(F.array_compact(F.array(*(F.when(matches(text, p), t) for t, p in patterns))), lambda t: ~F.array_contains(low, F.lower(t)))
    return F.concat(e, F.array_distinct(new))


def normalise_contacts(df: DataFrame, contact: str = "contact") -> DataFrame:
    """Fill phone, e-mail, address and site from a free contact text where they are blank; phones get one format."""
    c = F.col(contact)

    def part(pattern: str, group: int = 0) -> Column:
        return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))

    out = df.withColumn("phone", format_phone(first_filled("phone", part(r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"))))
    out = out.withColumn("email", first_filled("email", F.lower(part(r"[\w.+-]+@[\w-]+\.[\w.]+\w"))))
    out = out.withColumn("website_url", first_filled("website_url", part(r"https?://[^\s,;]+")))
    return out.withColumn("address", first_filled("address", part(r"(?i)address:\s*([^;\n]+)", 1)))


def phone_key(c: str) -> Column:
    return F.nullif(digits(c), F.lit(""))


def apply_flag_rules(column: Column, rules: list[tuple[Column, object]], last_wins: bool = True) -> Column:
    """A flag from ordered (condition, value) rules."""
    order = rules if last_wins else rules[::-1]
    return reduce(lambda out, r: F.when(true(r[0]), F.lit(r[1])).otherwise(out), order, column)


def append_tags(tags: Column, condition: Column, tag: str) -> Column:
    e = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(true(condition) & ~F.array_contains(e, tag), F.concat(e, F.array(F.lit(tag)))).otherwise(e)


#: Bands of ages: name, least, most.
AGE_BANDS = (("child", 0, 12), ("youth", 13, 17), ("young_adult", 18, 29), ("adult", 30, 59), ("senior", 60, 120))


def age_group(fields: list[tuple[str, Column]]) -> Column:
    """(group, source) of the first field that tells one: an age range, else words for young adults, youth, seniors, adults."""

    def of(c: Column) -> Column:
        low = F.nullif(F.regexp_extract(c, r"(?i)\b(?:ages?|aged)?\s*(\d{1,2})\s*(?:-|–|to)\s*(\d{1,3})\b", 1), F.lit("")).cast("int")
        high = F.nullif(F.regexp_extract(c, r"(?i)\b(?:ages?|aged)?\s*(\d{1,2})\s*(?:-|–|to)\s*(\d{1,3})\b", 2), F.lit("")).cast("int")
        over = F.nullif(F.regexp_extract(c, r"(?i)\b(\d{2})\s*(?:\+|and (?:over|older|up)|years? and (?:over|older))", 1), F.lit("")).cast("int")
        by_range = F.when(high <= 12, "child").when(high <= 18, "youth").when((low >= 12) & (high <= 30), "young_adult").when((low < 18) & (high > 18), "youth_and_adult").when(low >= 55, "senior").when(low >= 18, "adult")
        by_over = F.when(over >= 55, "senior").when(over >= 18, "adult")
        words = F.when(matches(c, r"\byoung adults?\b"), "young_adult").when(matches(c, r"\b(youth|teens?|adolescents?)\b"), "youth").when(matches(c, r"\b(seniors?|older adults?|elderly)\b"), "senior").when(matches(c, r"\badults?\b"), "adult")
        return F.coalesce(by_range, by_over, words)

    return F.coalesce(*(F.when(of(c).isNotNull(), F.struct(of(c).alias("group"), F.lit(name).alias("source"))) for name, c in fields))


def exclusion_flags(text: Column, faith: str, idiom: str, steps: str) -> list[Column]:
    """is_faith_based (an idiom that only sounds so does not count) and is_12_step."""
    clean = F.regexp_replace(text, f"(?iu){idiom}", " ")
    return [matches(clean, faith).alias("is_faith_based"), matches(text, steps).alias("is_12_step")]


def remap_categories(df: DataFrame, mapping: DataFrame, category: str = "category", place: str = "location") -> DataFrame:
    """New categories by an ordered mapping (ordinal, match_kind exact | pattern | suffix, match, new_category, new_location).

    The first row that fits counts; a suffix is cut off and becomes the place. Distinct categories meet the mapping once.
    """
    names = df.select(F.col(category).alias("_c")).distinct()
    low = F.lower(F.trim("_c"))
    m = F.col("match")
    fits = F.when(F.col("match_kind") == "exact", low == F.lower(m)).when(F.col("match_kind") == "pattern", F.regexp_like("_c", F.concat(F.lit("(?iu)"), m))).otherwise(F.endswith(low, F.lower(m)))
    hit = names.join(F.broadcast(mapping), true(fits)).groupBy("_c").agg(F.min(F.struct("ordinal", "match_kind", "match", "new_category", "new_location")).alias("_m"))
    cut = F.trim(F.substring("_c", 1, F.length("_c") - F.length("_m.match")))
    new = F.when(F.col("_m.match_kind") == "suffix", F.coalesce("_m.new_category", cut)).otherwise(F.col("_m.new_category"))
    map_ = hit.select("_c", new.alias("_new"), F.col("_m.new_location").alias("_place"))
    j = df.join(F.broadcast(map_), F.col(category) == F.col("_c"), "left")
    moved = {category: F.coalesce("_new", category), place: F.when(blank(place, True), F.col("_place")).otherwise(F.col(place))}
    return j.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in df.columns))


def category_issues(df: DataFrame, rules: list[tuple[str, Column, str, str]], key: str = "id") -> DataFrame:
    """(id, issue, suggestion, reason) of all rules (issue, condition, suggestion, reason) that hold."""
    entries = F.array_compact(F.array(*(F.when(true(c), F.struct(F.lit(i).alias("issue"), F.lit(s).alias("suggestion"), F.lit(r).alias("reason"))) for i, c, s, r in rules)))
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.*")


def normalise_locations(df: DataFrame, gazetteer: DataFrame, place: str = "location", address: str = "address") -> DataFrame:
    """Places become a gazetteer's city (ordinal, alias, place); the old text moves to a blank address; adds the outcome."""
    names = df.select(F.col(place).alias("_l")).where(~blank(place, True)).distinct()
    g = gazetteer.select("ordinal", F.lower("alias").alias("_a"), "place")
    words = names.withColumn("_w", F.explode(F.array_distinct(F.concat(F.split(F.lower("_l"), r"[^\p{L}]+"), F.array(F.lower(F.trim("_l")))))))
    hit = words.join(F.broadcast(g), F.col("_w") == F.col("_a")).groupBy("_l").agg(F.min(F.struct("ordinal", "place")).alias("_p")).select("_l", F.initcap("_p.place").alias("_city"))
    j = df.join(hit, F.col(place) == F.col("_l"), "left")
    outcome = F.when(blank(place, True), "empty").when(F.col("_city").isNull(), "unresolved").when(F.col("_city") == F.col(place), "kept").otherwise("changed")
    j = j.withColumn("outcome", outcome)
    moved = {place: F.coalesce("_city", place), address: F.when((F.col("outcome") == "changed") & blank(address, True), F.col(place)).otherwise(F.col(address))}
    return j.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in df.columns), "outcome")


def fill_default(c: str, value: str) -> Column:
    return F.when(blank(c, True), value).otherwise(F.col(c))


def dedupe_regional(df: DataFrame, base_name: Column, region_wide: Column, key: str = "id") -> DataFrame:
    """Ids to deactivate: one region-wide row of each group of equal base names that also has a local row."""
    rows = df.where(true(F.col("is_active"))).select(F.col(key).alias("_id"), F.lower(F.trim(base_name)).alias("_b"), true(region_wide).alias("_w")).where(~blank("_b"))
    groups = rows.groupBy("_b").agg(F.min(F.when(F.col("_w"), F.col("_id"))).alias("id"), F.count_if(~F.col("_w")).alias("_local")).where("id IS NOT NULL AND _local > 0")
    return groups.select("id", F.col("_b").alias("base_name"))


def dedupe_exact(df: DataFrame, group: Column, score: Column, updated: str = "last_updated", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, log): the best row of each group by score, newest update, least id; the log names what each removed row gave way to."""
    order = Window.partitionBy("_g").orderBy(F.desc("_s"), F.col(updated).desc_nulls_last(), key)
    rows = df.withColumn("_g", group).withColumn("_s", score)
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_best", F.first(key).over(order))
    log = rows.where("_k > 1").select(F.col("_best").alias("kept_id"), F.col(key).alias("removed_id"), F.col("_g").alias("match_value"))
    return rows.where("_k = 1").drop("_g", "_s", "_k", "_best"), log


def merge_group(items: DataFrame, groups: DataFrame, key: str = "id", longest: tuple[str, ...] = ("description", "location"), first: tuple[str, ...] = ("phone", "email", "website_url", "address")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(canonical patches, ids to deactivate, log) of groups (canonical, member): longest texts, first contact values by id."""
    all_ = groups.select("canonical", F.col("member").alias("_m")).unionByName(groups.select("canonical", F.col("canonical").alias("_m"))).distinct()
    j = all_.join(items, F.col("_m") == F.col(key))
    own = F.struct((F.col("_m") != F.col("canonical")).alias("other"), F.col("_m"))
    patch = j.groupBy("canonical").agg(
        *(F.max_by(F.col(c), F.struct(F.length(F.coalesce(F.col(c), F.lit(""))), -F.col("_m"))).alias(c) for c in longest),
        *(F.min_by(F.when(~blank(c, True), F.col(c)), F.when(~blank(c, True), own)).alias(c) for c in first),
    ).withColumnRenamed("canonical", key)
    gone = all_.where("_m <> canonical")
    return patch, gone.select(F.col("_m").alias(key)), gone.select(F.col("canonical").alias("kept_id"), F.col("_m").alias("removed_id"), F.lit("merge").alias("duplicate_type"))


def deactivate_into(items: DataFrame, pairs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Deactivate ``id`` and let its ``keeper`` take the values of fields that it lacks."""
    gone = pairs.select(F.col("id").alias("_gone"), F.col("keeper").alias("_keeper"))
    lost = items.select(F.col(key).alias("_id"), *fields).join(gone, F.col("_id") == F.col("_gone"))
    values = lost.groupBy("_keeper").agg(*(F.min_by(F.when(~blank(f, True), F.col(f)), F.when(~blank(f, True), F.col("_id"))).alias(f) for f in fields)).withColumnRenamed("_keeper", key)
    return set_active(fill_empty(items, values, fields, key).drop("changed_fields"), pairs.select(F.col("id").alias(key)), False, key)


def apply_requests(items: DataFrame, requests: DataFrame, allowed: list[str], now: Column, nullable: tuple[str, ...] = (), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(items after, requests after): approve pending requests (request_id, item_id, change_type, proposed map, status).

    Only allowed fields change; '' becomes null for nullable ones; of several updates of an item the latest wins per item.
    Requests that are not pending are rejected as they stand.
    """
    pending = requests.where("status = 'pending'")
    kept = F.map_filter("proposed", lambda k, _: k.isin(allowed))
    latest = top(pending.where("change_type IN ('update', 'deactivate')"), ["item_id"], [F.desc("request_id")], 1)
    patch = latest.select(F.col("item_id").alias("_k"), kept.alias("_f"), "change_type")
    j = items.join(patch, F.col(key) == F.col("_k"), "left")

    def value(f: str) -> Column:
        v = F.col("_f")[f]
        v = F.nullif(v, F.lit("")) if f in nullable else v
        return F.when((F.col("change_type") == "update") & true(F.map_contains_key("_f", f)), v.cast(items.schema[f].dataType)).otherwise(F.col(f))

    off = F.when(F.col("change_type") == "deactivate", False).otherwise(F.col("is_active"))
    after = j.select(*(value(c).alias(c) if c in allowed else off.alias(c) if c == "is_active" else F.when(F.col("_k").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "last_updated" else F.col(c) for c in items.columns))
    new = pending.where("change_type = 'create'").select(*(F.col("proposed")[f].cast(items.schema[f].dataType).alias(f) for f in allowed), F.lit(True).alias("is_active"))
    done = requests.withColumn("reviewed_at", F.when(F.col("status") == "pending", now)).withColumn("status", F.when(F.col("status") == "pending", "approved").otherwise(F.col("status")))
    return after.unionByName(new, allowMissingColumns=True), done


def reject_requests(requests: DataFrame, ids: DataFrame, note: str, now: Column) -> DataFrame:
    j = requests.join(ids.select(F.col("request_id").alias("_k")).distinct(), F.col("request_id") == F.col("_k"), "left")
    hit = F.col("_k").isNotNull() & (F.col("status") == "pending")
    return j.withColumn("review_notes", F.when(hit, note)).withColumn("reviewed_at", F.when(hit, now)).withColumn("status", F.when(hit, "rejected").otherwise(F.col("status"))).drop("_k")


def apply_enrichment(items: DataFrame, results: DataFrame, widths: dict[str, int], rich: int = 2, key: str = "id") -> DataFrame:
    """Enrichment results (id, fields map, steps array, inferred): inferred steps never replace given ones and cap confidence at 49;
    texts are cut to their columns; an inactive row with enough fields comes back."""
    r = results.select(F.col(key).alias("_k"), F.col("fields").alias("_f"), F.col("steps").alias("_steps"), true(F.col("inferred")).alias("_inf"))
    j = items.join(r, F.col(key) == F.col("_k"), "left")
    there = F.col("_k").isNotNull()
    steps = there & ~blank_array("_steps") & (~F.col("_inf") | blank_array("process_steps"))
    got = F.size(F.map_filter("_f", lambda _, v: ~blank(v, True)))
    new: dict[str, Column] = {f: F.when(there & ~blank(F.col("_f")[f], True), F.substring(F.trim(F.col("_f")[f]), 1, n)).otherwise(F.col(f)) for f, n in widths.items()}
    new["process_steps"] = F.when(steps, F.col("_steps")).otherwise(F.col("process_steps"))
    new["process_steps_inferred"] = F.when(steps, F.col("_inf")).otherwise(F.col("process_steps_inferred"))
    new["confidence_score"] = F.when(steps & F.col("_inf"), F.least("confidence_score", F.lit(49))).otherwise(F.col("confidence_score"))
    new["is_active"] = F.when(there & true(got >= rich), True).otherwise(F.col("is_active"))
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in items.columns))


def record_provenance(sources: Column, urls: Column, found: Column, url: Column) -> list[Column]:
    """Field sources with the new ones on top, and the url list with the new url."""
    kept = F.map_filter(sources, lambda k, _: ~F.array_contains(F.map_keys(found), k))
    return [F.coalesce(F.map_concat(kept, found), found, sources).alias("field_sources"), F.array_distinct(F.array_compact(F.concat(F.coalesce(urls, F.array().cast("array<string>")), F.array(url)))).alias("source_urls")]


GENERIC_STEP = r"^\s*(contact|call|visit|e-?mail|check|see)\b.{0,40}\b(website|office|organi[sz]ation|provider|them|for (more )?(details|information))\b"


def has_generic_steps(steps: str | Column, pattern: str = GENERIC_STEP) -> Column:
    return F.exists(F.coalesce(F.col(steps) if isinstance(steps, str) else steps, F.array().cast("array<string>")), lambda s: matches(s, pattern))


def step_count(steps: str) -> Column:
    return F.coalesce(F.size(steps), F.lit(0))


def archive_features(items: DataFrame, archive: DataFrame, features: list[str], now: Column, key: str = "id") -> DataFrame:
    """Archive after copying the features of active rows that have any."""
    rows = items.where(true(F.col("is_active")) & any_of(F.col(f).isNotNull() for f in features)).select(key, *features, now.alias("archived_at"))
    return upsert(archive, rows, [key])


def audit_flags(short: int = 50) -> Column:
    """Names of what a record lacks."""
    rules = [("no_phone", blank("phone", True)), ("no_contact", blank("phone", True) & blank("email", True)), ("no_location", blank("location", True)), ("no_site", blank("website_url", True)), ("short_description", F.length(F.coalesce("description", F.lit(""))) < short), ("truncated_description", true(F.col("description").rlike(r"(…|\.\.\.)\s*$")))]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))


def charity_records(charities: DataFrame, categories: list[tuple[str, list[str]]], tags: dict[str, list[str]], text: Column) -> DataFrame:
    """Records with the first category whose keyword occurs and all tags whose keyword occurs."""
    low = F.lower(text)

    def hit(words: list[str]) -> Column:
        return any_of(F.contains(low, F.lit(w)) for w in words)

    category = reduce(lambda out, c: F.when(hit(c[1]), c[0]).otherwise(out), reversed(categories), F.lit("other"))
    found = F.array_compact(F.array(*(F.when(hit(w), t) for t, w in tags.items())))
    return charities.select("bn", F.initcap("name").alias("name"), category.alias("category"), found.alias("tags"), F.initcap("city").alias("location"), F.coalesce("programs", F.lit("")).alias("description"), F.col("url").alias("website_url"))


def stale_translations(items: DataFrame, translations: DataFrame, language: str, fields: list[str], key: str = "id") -> DataFrame:
    """(id, state) of items whose translation is missing or was made from other texts."""
    now = items.select(F.col(key).alias("_k"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256).alias("_h"))
    t = translations.where(F.col("language") == language).select(F.col("item_id").alias("_i"), "source_hash")
    j = now.join(t, F.col("_k") == F.col("_i"), "left")
    return j.where(F.col("_i").isNull() | ~F.col("source_hash").eqNullSafe(F.col("_h"))).select(F.col("_k").alias(key), F.when(F.col("_i").isNull(), "missing").otherwise("stale").alias("state"))


#: Which fields a derived artefact depends on.
ARTEFACTS = {"vector": ("name", "description", "category", "eligibility", "location"), "translation": ("name", "description", "eligibility", "process_steps"), "cache": ("name", "category", "location", "is_active"), "ai_fields": ("description", "eligibility")}


def stale_artifacts(changed: Column, artefacts: dict[str, tuple[str, ...]] = ARTEFACTS) -> Column:
    """Artefacts that an edit of some fields makes stale."""
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(changed, F.array(*map(F.lit, f))), a) for a, f in artefacts.items())))


def enrichment_batch(items: DataFrame, batch: DataFrame, fields: list[str], now: Column, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items after, history, audit requests) of a curated batch (id, fields map): values that are given overwrite."""
    clean = batch.withColumn("fields", F.map_filter("fields", lambda k, v: k.isin(fields) & v.isNotNull()))
    after, done = apply_changes(items, clean, fields, key)
    ok = clean.join(done.where("ok"), key, "left_semi")
    history = ok.select(key, F.lit("enrichment").alias("change_type"), F.array_sort(F.map_keys("fields")).alias("keys"), now.alias("changed_at"))
    requests = clean.join(done, key).select(F.col(key).alias("item_id"), F.to_json("fields").alias("proposed"), F.when(F.col("ok"), "approved").otherwise("rejected").alias("status"))
    return after, history, requests


