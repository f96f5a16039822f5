"""Predicates and filters over item tables. Column names are parameters; word lists and patterns come from the caller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.common import all_of, any_of, blank, blank_array, col, contains, matches, true

REGION_WIDE = ("province-wide", "provincewide", "country-wide", "nationwide", "all locations")
REMOTE = ("online", "phone", "virtual")


def active_items(df: DataFrame, flag: str = "is_active", checked: str = "last_checked", key: str = "id") -> DataFrame:
    """Active rows, newest check first; rows never checked come first."""
    return df.where(true(F.col(flag))).orderBy(F.col(checked).desc_nulls_first(), F.col(key))


def by_categories(df: DataFrame, categories: list[str], category: str = "category", name: str = "name", active: str | None = None) -> DataFrame:
    out = df.where(F.col(category).isin(categories))
    return (out.where(true(F.col(active))) if active else out).orderBy(F.col(name).asc_nulls_last())


def text_contains(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term in any of the columns, ignoring case."""
    return df.where(any_of(contains(c, term) for c in columns))


@dataclass
class Listing:
    """What a listing shows: conditions, order and page. Empty fields add nothing."""

    equal: dict[str, object] = field(default_factory=dict)
    like: dict[str, str] = field(default_factory=dict)
    text: str = ""
    text_columns: tuple[str, ...] = ()
    filled: dict[str, bool] = field(default_factory=dict)
    sort: str = "id"
    descending: bool = False
    key: str = "id"
    page: int = 1
    size: int = 25


def list_items(df: DataFrame, spec: Listing, semi: DataFrame | None = None, on: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total): conjunctive filters, one sort column (descending puts nulls first), offset paging, and the number of rows."""
    conditions = [F.col(c).eqNullSafe(F.lit(v)) for c, v in spec.equal.items()]
    conditions += [contains(c, v) for c, v in spec.like.items()]
    conditions += [F.col(c).isNotNull() if there else F.col(c).isNull() for c, there in spec.filled.items()]
    if spec.text:
        conditions.append(any_of(contains(c, spec.text) for c in spec.text_columns))
    rows = df.where(all_of(conditions)) if conditions else df
    if semi is not None:
        rows = rows.join(semi.select(on), on, "left_semi")
    order = F.col(spec.sort).desc_nulls_first() if spec.descending else F.col(spec.sort).asc_nulls_last()
    page = rows.orderBy(order, F.col(spec.key)).offset((spec.page - 1) * spec.size).limit(spec.size)
    return page, rows.agg(F.count("*").alias("total"))


def list_change_requests(requests: DataFrame, page: int = 1, size: int = 25, **equal: object) -> tuple[DataFrame, DataFrame]:
    """(page, total) of change requests, newest first; ``equal`` holds what status, source, change_type or batch must be."""
    return list_items(requests, Listing(equal=equal, sort="created_at", descending=True, page=page, size=size))


def list_feedback(feedback: DataFrame, page: int = 1, size: int = 25, **equal: object) -> tuple[DataFrame, DataFrame]:
    """(page, counts) of feedback, newest first; counts holds ``total`` of the listed rows and ``new`` of all rows."""
    rows, total = list_items(feedback, Listing(equal=equal, sort="created_at", descending=True, page=page, size=size))
    return rows, total.join(feedback.agg(F.count_if(F.col("status") == "new").alias("new")))


def location_match(location: str | Column, wanted: list[str] | str, region_wide: tuple[str, ...] = REGION_WIDE) -> Column:
    """Blank location, one that contains a wanted place (a list or comma-separated), or a region-wide one."""
    places = [p.strip() for p in (wanted.split(",") if isinstance(wanted, str) else wanted) if p.strip()]
    return blank(location) | any_of(contains(location, p) for p in (*places, *region_wide))


def filter_by_location(df: DataFrame, wanted: str, skip_all: bool = False, bypass: Column | None = None, location: str = "location", fmt: str = "service_format", region_wide: tuple[str, ...] = REGION_WIDE) -> DataFrame:
    """Hard location filter on results. Rows for which ``bypass`` holds always stay."""
    if skip_all or not wanted:
        return df
    keep = location_match(location, [wanted], region_wide) | contains(location, "multiple locations") | any_of(contains(fmt, w) for w in REMOTE)
    return df.where(keep | true(bypass)) if bypass is not None else df.where(keep)


def same_gender(c: str | Column) -> Column:
    """"women_only" and "women" are one value."""
    return F.regexp_replace(F.lower(col(c)), "_only$", "")


def apply_hard_filters(df: DataFrame, categories: list[str] = (), gender: str | None = None, age: str | None = None, fmt: str | None = None, languages: list[str] = ()) -> DataFrame:
    """Filters that a user set. A row without the tag passes every filter on it."""
    keep = []
    if categories:
        keep.append(F.col("category").isin(list(categories)))
    if gender:
        own = same_gender("gender_restriction")
        keep.append(blank(own) | true(own.isin("all", "any")) | true(own == gender.lower().removesuffix("_only")))
    if age:
        both = ["youth_and_adult"] if age in ("youth", "adult") else []
        keep.append(blank("age_group") | true(F.lower("age_group").isin(["all", "all_ages", age.lower(), *both])))
    if fmt:
        own = F.regexp_replace(F.lower("service_format"), r"[\s-]+", "_")
        keep.append(blank(own) | true(own.isin("both", "hybrid", fmt.lower().replace("-", "_").replace(" ", "_"))))
    if languages:
        keep.append(blank_array("languages_supported") | true(F.arrays_overlap(F.transform("languages_supported", F.lower), F.array(*(F.lit(x.lower()) for x in languages)))))
    return df.where(all_of(keep)) if keep else df


def derive_filters(queries: DataFrame, attribute: str = "demographic", gender: str = "gender", age: str = "age") -> DataFrame:
    """Filters that follow from a demographic attribute, where the query sets none itself."""
    a = F.lower(F.col(attribute))
    g = F.when(a.rlike(r"\b(women|woman|female|mother)"), "women").when(a.rlike(r"\b(men|man|male|father)\b"), "men")
    y = F.when(a.rlike(r"\b(youth|teen|child)"), "youth").when(a.rlike(r"\b(senior|elder)"), "senior")
    return queries.withColumn(gender, F.coalesce(F.col(gender), g)).withColumn(age, F.coalesce(F.col(age), y))


def apply_exclusions(df: DataFrame, exclusions: dict[str, tuple[str, str]], text: Column) -> DataFrame:
    """Drop rows by flag; where the flag is null, by pattern over the text. exclusions: name -> (flag column, pattern)."""
    for flag, pattern in exclusions.values():
        df = df.where(~F.coalesce(F.col(flag), matches(text, pattern)))
    return df


def exclude_by_pattern_when(df: DataFrame, condition: Column, text: Column, pattern: str) -> DataFrame:
    return df.where(~(true(condition) & matches(text, pattern)))


def intent_is(name: str, primary: str = "primary", secondary: str = "secondary", confidence: str = "secondary_confidence", least: float = 0.5) -> Column:
    return true(F.col(primary) == name) | (true(F.col(secondary) == name) & true(F.col(confidence) >= least))


def apply_age_filter(df: DataFrame, age: str = "query_age", confidence: str = "age_confidence", own: str = "age_group", least: float = 0.8) -> DataFrame:
    """Other age groups go only if the query's age is sure enough."""
    sure = true(F.col(confidence) >= least) & F.col(age).isNotNull()
    fits = blank(own) | true(F.col(own).isin("all", "all_ages")) | true(F.col(own) == F.col(age)) | (true(F.col(own) == "youth_and_adult") & true(F.col(age).isin("youth", "adult")))
    return df.where(~sure | fits)


def within_km(df: DataFrame, km: float, distance: str = "distance_km") -> DataFrame:
    return df.where(F.col(distance).isNull() | (F.col(distance) <= km))


def landing_page(df: DataFrame, categories: list[str], city: str, region_wide: tuple[str, ...] = REGION_WIDE) -> DataFrame:
    """Rows of some categories for a city, its region, or online; most trusted first."""
    place = contains("location", city) | any_of(contains("location", r) for r in region_wide) | contains("service_format", "online")
    return df.where(F.col("category").isin(categories) & place).orderBy(F.col("confidence_score").desc_nulls_first(), F.col("name"))


def due_for_refresh(df: DataFrame, max_age_days: int, limit: int, now: Column, checked: str = "last_checked", confidence: str = "confidence_score", key: str = "id") -> DataFrame:
    """Never checked first, then low confidence, then oldest. The limit comes before the age test, as a worker takes its batch first."""
    urgency = F.when(F.col(checked).isNull(), 0).when(F.col(confidence) < 60, 1).otherwise(2)
    batch = df.orderBy(urgency, F.col(checked).asc_nulls_first(), F.col(key)).limit(limit)
    return batch.where(F.col(checked).isNull() | (F.col(checked) < now - F.make_dt_interval(F.lit(max_age_days))))


def enrichment_candidates(df: DataFrame, limit: int, groups: list[Column], key: str = "id", last: str = "enrichment_date") -> DataFrame:
    """Rows of ordered priority groups (conditions; the first that holds counts), longest unenriched first."""
    priority = reduce(lambda out, c: F.when(true(c[1]), c[0] + 1).otherwise(out), reversed(list(enumerate(groups))), F.lit(None).cast("int"))
    return df.withColumn("priority", priority).where("priority IS NOT NULL").orderBy("priority", F.col(last).asc_nulls_first(), key).limit(limit)


def needs_enrichment(now: Column, steps: str = "process_steps", last: str = "enrichment_date", days: int = 90) -> Column:
    return F.col(last).isNull() | blank_array(steps) | (F.col(last) < now - F.make_dt_interval(F.lit(days)))


def geocode_candidates(df: DataFrame, region: str, virtual: tuple[str, ...] = REMOTE) -> DataFrame:
    """Rows without coordinates that have a place to look up, with the text to look up."""
    place = F.when(~blank("address", True), F.concat_ws(", ", F.trim("address"), F.lit(region))).when(~blank("location", True), F.concat_ws(", ", F.trim("location"), F.lit(region)))
    away = any_of(contains("location", v) | contains("service_format", v) for v in virtual)
    return df.where(F.col("latitude").isNull() & ~away).withColumn("geocode_text", place).where("geocode_text IS NOT NULL")


def is_data_rich(columns: list[str], least: int = 2) -> Column:
    return sum((F.when(~blank(F.col(c).cast("string"), True), 1).otherwise(0) for c in columns), F.lit(0)) >= least


def is_relevant(text: Column, category: Column, strong: list[str], weak: list[str], categories: list[str], veto: str, override: str) -> Column:
    """Keyword relevance: one strong word, or one weak word in a fitting category, or two weak words; a veto pattern needs an override."""
    low = F.lower(text)

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))) if words else F.lit(0)

    fit = true(category.isin(categories))
    chosen = (hits(strong) >= 1) | (hits(weak) >= 2) | (fit & (hits(weak) >= 1))
    return chosen & (~matches(text, veto) | matches(text, override))


def retain(df: DataFrame, ts: str, days: int, now: Column, least_days: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows younger than ``days`` (at least ``least_days``), and how many stay and go."""
    if days < least_days:
        raise ValueError(f"retention must be at least {least_days} days")
    old = true(F.col(ts) < now - F.make_dt_interval(F.lit(days)))
    return df.where(~old), df.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("purged"))


def fresh(df: DataFrame, ts: str, hours: int, now: Column) -> DataFrame:
    return df.where(F.col(ts) > now - F.make_dt_interval(hours=F.lit(hours)))


def always_open_candidates(df: DataFrame, text: Column, flag: str = "is_24_7", patterns: tuple[str, ...] = ("24/7", "24 hours", "24-hour", "24 hour", "around the clock", "always open")) -> DataFrame:
    return df.where(~true(F.col(flag)) & any_of(contains(text, p) for p in patterns))


def low_quality_records(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows that break a rule, with the name of the first they break."""
    issue = reduce(lambda out, r: F.when(true(r[1]), r[0]).otherwise(out), reversed(rules), F.lit(None).cast("string"))
    return df.withColumn("issue", issue).where("issue IS NOT NULL")


def coverage(df: DataFrame, themes: dict[str, str], text: Column) -> DataFrame:
    """(theme, n): rows whose text matches each theme's pattern; themes without rows count 0."""
    counts = df.agg(*(F.count_if(matches(text, p)).alias(t) for t, p in themes.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("theme"), F.col(t).alias("n")) for t in themes))).alias("r")).select("r.*")


def org_prefix(df: DataFrame, org: str, name: str = "name", limit: int = 10, key: str = "id") -> DataFrame:
    return df.where(true(F.lower(F.col(name)).startswith(f"{org.lower()} — "))).orderBy(key).limit(limit)


def embedding_worklist(df: DataFrame, mode: str = "missing", ids: list[int] = (), key: str = "id", vector: str = "embedding", flag: str = "is_active") -> DataFrame:
    """Rows that need a vector: those without (missing), all, or given ids; in order of id."""
    chosen = {"missing": F.col(vector).isNull(), "all": F.lit(True), "ids": F.col(key).isin(list(ids))}[mode]
    return df.where(true(F.col(flag)) & chosen).orderBy(key)


def backfill_sources(items: DataFrame, reachability: DataFrame, key: str = "id", url: str = "website_url", sources: str = "source_urls") -> DataFrame:
    """(id, outcome, source_urls) of rows without sources: set, dead or no-source. reachability: (url, reachable)."""
    rows = items.where(blank_array(sources))
    seen = reachability.select(F.col("url").alias("_url"), "reachable")
    joined = rows.join(seen, F.col(url) == F.col("_url"), "left")
    outcome = F.when(blank(url, True), "no-source").when(true(F.col("reachable")), "set").otherwise("dead")
    return joined.select(key, outcome.alias("outcome"), F.when(outcome == "set", F.array(url)).alias("source_urls"), "confidence_score").orderBy(F.col("confidence_score").asc_nulls_first(), key).drop("confidence_score")


#: Field predicates of the item table: name -> condition builder.
ISSUES: dict[str, Callable[[], Column]] = {
    **{name: (lambda c=c: blank(c)) for name, c in (("phone", "phone"), ("email", "email"), ("websiteUrl", "website_url"), ("name", "name"), ("description", "description"), ("eligibility", "eligibility"), ("address", "address"), ("hoursOfOperation", "hours_of_operation"), ("waitTimes", "wait_times"), ("serviceFormat", "service_format"))},
    **{name: (lambda c=c: blank_array(c)) for name, c in (("processSteps", "process_steps"), ("requiredDocs", "required_docs"), ("languagesSupported", "languages_supported"), ("tags", "tags"))},
    "noContact": lambda: blank("phone") & blank("email"),
    "lowConfidence": lambda: true(F.col("confidence_score") < 30),
    "latitude": lambda: F.col("latitude").isNull(),
    "embedding": lambda: F.col("embedding").isNull(),
    "staleEmbedding": lambda: F.col("embedding").isNotNull() & true(F.col("last_updated") > F.col("embedding_updated_at")),
    "staleGeocoding": lambda: F.col("latitude").isNotNull() & true(F.col("last_updated") > F.col("geocoded_at")),
    "freshEmbedding": lambda: F.col("embedding").isNull() | true(F.col("last_updated") > F.col("embedding_updated_at")),
    "freshGeocoding": lambda: F.col("latitude").isNull() | true(F.col("last_updated") > F.col("geocoded_at")),
}
CORE = ("name", "description", "eligibility", "processSteps", "hoursOfOperation", "serviceFormat", "tags", "languagesSupported", "websiteUrl", "freshEmbedding", "freshGeocoding", "noContact")


def severity() -> Column:
    return F.when(ISSUES["noContact"](), "critical").when(ISSUES["description"](), "high").otherwise("medium")


def missing_fields(names: list[str] | None = None) -> Column:
    """Names of the predicates that hold, in order."""
    return F.array_compact(F.array(*(F.when(ISSUES[n](), n) for n in names or list(ISSUES))))


def quality_issues(df: DataFrame, field: str | None = None, level: str | None = None, key: str = "id", flag: str = "is_active") -> DataFrame:
    """Active rows with a core issue, by severity and then confidence (unknown last), with the fields that are missing."""
    rows = df.where(true(F.col(flag)) & any_of(ISSUES[n]() for n in CORE))
    rows = rows.withColumn("severity", severity()).withColumn("missing_fields", missing_fields())
    if field in ISSUES:
        rows = rows.where(ISSUES[field]())
    if level:
        rows = rows.where(F.col("severity") == level)
    order = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).otherwise(3)
    return rows.orderBy(order, F.coalesce("confidence_score", F.lit(999)), key)
