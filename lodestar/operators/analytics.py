"""Search and click analytics over an event log, and counts over item tables.

The log has the columns query, item (clicked item or null), position, session, user_agent, result_count, ts (UTC). ``now`` is
always an argument, so that reports can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.common import blank, contains, top, true

TZ = "America/Edmonton"


def since(log: DataFrame, days: int, now: Column, ts: str = "ts") -> DataFrame:
    """Rows of the last 1 to 365 days."""
    return log.where(F.col(ts) >= now - F.make_dt_interval(F.lit(max(1, min(365, days)))))


def popular_searches(log: DataFrame, n: int = 10, days: int | None = None, now: Column | None = None) -> DataFrame:
    rows = since(log, days, now) if days else log
    return rows.groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "query").limit(n)


def query_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("searches"), F.count("item").alias("clicks"), F.max("ts").alias("last_seen"))


def item_click_stats(log: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """Clicks per item with its name and category; items that are gone keep their row."""
    clicks = log.where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_click"))
    return clicks.join(items.select(F.col(key).alias("item"), "name", "category"), "item", "left")


def category_clicks(log: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    clicks = log.where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("n"))
    return clicks.join(items.select(F.col(key).alias("item"), "category"), "item").groupBy("category").agg(F.sum("n").alias("clicks"))


def visitor(tz: str = TZ) -> Column:
    """A visitor is a local day and the first hundred characters of the browser's name."""
    return F.concat_ws("|", F.to_date(F.from_utc_timestamp("ts", tz)).cast("string"), F.substring(F.coalesce("user_agent", F.lit("")), 1, 100))


def overview(log: DataFrame, tz: str = TZ) -> DataFrame:
    return log.agg(
        F.count("*").alias("searches"),
        F.count_if(F.col("item").isNotNull()).alias("clicks"),
        F.count_distinct("query").alias("unique_queries"),
        F.count_distinct("session").alias("sessions"),
        F.count_distinct(visitor(tz)).alias("visitors"),
        F.round(F.avg(F.when(F.col("result_count") > 0, F.col("result_count"))), 1).alias("avg_results"),
    )


def daily_trends(log: DataFrame, tz: str = TZ) -> DataFrame:
    rows = log.withColumn("day", F.to_date(F.from_utc_timestamp("ts", tz)))
    return rows.groupBy("day").agg(F.count("*").alias("searches"), F.count("item").alias("clicks"), F.count_distinct("query").alias("unique_queries"), F.count_distinct(visitor(tz)).alias("visitors"))


def hourly(log: DataFrame, tz: str = TZ) -> DataFrame:
    return log.groupBy(F.hour(F.from_utc_timestamp("ts", tz)).cast("long").alias("hour")).agg(F.count("*").alias("searches"))


def device(agent: str = "user_agent") -> Column:
    """Device class of a browser's name; tablets that call themselves mobile count as mobile."""
    return F.when(blank(agent), "unknown").when(contains(agent, "mobile") | contains(agent, "iphone"), "mobile").when(contains(agent, "ipad") | contains(agent, "tablet"), "tablet").otherwise("desktop")


def devices(log: DataFrame) -> DataFrame:
    return log.groupBy(device().alias("device")).agg(F.count("*").alias("searches"))


def no_click_queries(log: DataFrame, n: int = 20) -> DataFrame:
    rows = log.where("item IS NULL AND result_count > 0")
    return rows.groupBy("query").agg(F.count("*").alias("searches"), F.max("result_count").alias("most_results")).orderBy(F.desc("searches"), "query").limit(n)


def volume_no_clicks(log: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """The queries of the last seven days that were searched most without a click."""
    return no_click_queries(since(log, 7, now), n)


def session_depth(log: DataFrame, n: int = 10) -> DataFrame:
    depth = log.where("session IS NOT NULL").groupBy("session").agg(F.count("*").alias("depth"))
    return depth.groupBy("depth").agg(F.count("*").alias("sessions")).orderBy("depth").limit(n)


def click_positions(log: DataFrame) -> DataFrame:
    return log.where("item IS NOT NULL AND position IS NOT NULL").groupBy("position").agg(F.count("*").alias("clicks"))


def coverage_summary(df: DataFrame, spec: dict[str, Column], fresh: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """(field, percent): share of rows for which each condition holds, one decimal, halves up; null for an empty table.

    ``fresh`` adds ratios of one condition within another.
    """
    counts = [(100.0 * F.count_if(true(c)) / F.nullif(F.count("*"), F.lit(0))).alias(k) for k, c in spec.items()]
    counts += [(100.0 * F.count_if(true(a) & true(b)) / F.nullif(F.count_if(true(b)), F.lit(0))).alias(k) for k, (a, b) in (fresh or {}).items()]
    names = [*spec, *(fresh or {})]
    wide = df.agg(*counts)
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.floor(F.col(k) * 10 + 0.5).cast("double").alias("t")) for k in names))).alias("r"))
    return long.select("r.field", (F.col("r.t") / 10).alias("percent"))


def coverage_rollup(summary: DataFrame, least: float = 90.0) -> DataFrame:
    return summary.agg(F.round(F.avg("percent"), 2).alias("mean_percent"), F.array_sort(F.collect_list(F.when(F.col("percent") < least, F.col("field")))).alias("below"))


def dashboard(items: DataFrame, requests: DataFrame, log: DataFrame, fields: list[str], now: Column, tz: str = TZ) -> DataFrame:
    """One row: active items, pending requests, today's searches (local day), mean completeness of the fields."""
    full = sum((F.when(~blank(F.col(c).cast("string")), 1.0).otherwise(0.0) for c in fields), F.lit(0.0)) / len(fields)
    a = items.where(true(F.col("is_active"))).agg(F.count("*").alias("active"), F.round(F.avg(full) * 100, 1).alias("completeness"))
    today = F.to_date(F.from_utc_timestamp(now, tz))
    b = requests.agg(F.count_if(F.col("status") == "pending").alias("pending"))
    c = log.agg(F.count_if(F.to_date(F.from_utc_timestamp("ts", tz)) == today).alias("searches_today"))
    return a.select("active", "completeness", b.scalar().alias("pending"), c.scalar().alias("searches_today"))


def search_quality(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("searches"),
        F.round(F.avg("first_click_position"), 4).alias("avg_first_click"),
        F.round(F.avg(F.when(true(F.col("reformulated")), 1.0).otherwise(0.0)), 4).alias("reformulation_rate"),
        F.round(F.avg(F.when(true(F.col("result_count") == 0), 1.0).otherwise(0.0)), 4).alias("zero_result_rate"),
    )


def vote_summary(votes: DataFrame, items: DataFrame, n: int = 100, key: str = "id") -> DataFrame:
    counts = votes.groupBy("item").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"), F.count("*").alias("total"))
    return counts.join(items.select(F.col(key).alias("item"), "name"), "item").orderBy(F.desc("total"), "item").limit(n)


def best_and_worst(summary: DataFrame, n: int = 3) -> DataFrame:
    """The items with the best and worst balance of votes."""
    rows = summary.withColumn("net", F.col("up") - F.col("down"))
    best = rows.orderBy(F.desc("net"), "item").limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(rows.orderBy("net", "item").limit(n).withColumn("side", F.lit("worst")))


def popularity(items: DataFrame, log: DataFrame, key: str = "id", confidence: Column | None = None, url: Column | None = None, contact: Column | None = None) -> DataFrame:
    """Ten points a click, the confidence, 20 for an address and 15 for a contact; items without clicks have no row."""
    clicks = log.where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("clicks"))
    zero = F.lit(0)
    score = 10 * F.col("clicks") + F.coalesce(confidence if confidence is not None else zero, F.lit(100)) + F.when(true(url if url is not None else F.lit(False)), 20).otherwise(0) + F.when(true(contact if contact is not None else F.lit(False)), 15).otherwise(0)
    return items.join(clicks, F.col(key) == F.col("item")).select(key, "clicks", score.alias("popularity"))


def affinity(clicks: DataFrame, impressions: DataFrame, now: Column, least: int = 5, half: float = 30.0) -> DataFrame:
    """Click rate per (query, item) that fades with the days since the last click; only with more than ``least`` impressions."""
    c = clicks.groupBy("query", "item").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_click"))
    i = impressions.groupBy("query", "item").agg(F.count("*").alias("impressions"))
    both = c.join(i, ["query", "item"], "full_outer").select("query", "item", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), "last_click")
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_click").cast("timestamp"))) / 86400.0
    score = F.when(F.col("impressions") > least, F.col("clicks") / F.col("impressions") * F.coalesce(F.exp(-age / half), F.lit(0.0)))
    return both.withColumn("affinity", F.round(F.coalesce(score, F.lit(0.0)), 6))


def top_affinities(affinities: DataFrame, n: int = 50) -> DataFrame:
    return top(affinities, ["query"], [F.desc("affinity"), F.col("item")], n)


def failed_queries(log: DataFrame) -> DataFrame:
    rows = log.where("result_count = 0").withColumn("location", F.coalesce("location", F.lit("")))
    return rows.groupBy("query", "location").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def top_failed_queries(failed: DataFrame, n: int = 20) -> DataFrame:
    return failed.orderBy(F.desc("n"), F.desc("last_seen"), "query", "location").limit(n)


def duplicate_groups(df: DataFrame, key_expr: Column, kind: str, key: str = "id") -> DataFrame:
    """(duplicate_type, match_value, n, ids): rows that share a key that is not blank."""
    rows = df.select(F.col(key).alias("_id"), key_expr.cast("string").alias("match_value")).where(~blank("match_value"))
    often = rows.groupBy("match_value").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_id")).alias("ids")).where("n > 1")
    return often.select(F.lit(kind).alias("duplicate_type"), "match_value", "n", "ids")


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))


def audit_counts(df: DataFrame, issues: Column, fillable: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(issue, n, fillable): rows per issue, and how many of them a side table (id, issue) could fill."""
    rows = df.select(F.col(key).alias("_id"), F.explode(issues).alias("issue"))
    if fillable is None:
        return rows.groupBy("issue").agg(F.count("*").alias("n"))
    side = fillable.select(F.col(key).alias("_id"), "issue", F.lit(True).alias("_f")).distinct()
    return rows.join(side, ["_id", "issue"], "left").groupBy("issue").agg(F.count("*").alias("n"), F.count("_f").alias("fillable"))


def system_counts(df: DataFrame) -> DataFrame:
    on = true(F.col("is_active"))
    return df.agg(F.count("*").alias("total"), F.count_if(on).alias("active"), F.count_if(~on).alias("inactive"), F.count_if(on & F.col("embedding").isNotNull()).alias("with_vector"), F.count_if(on & F.col("latitude").isNotNull()).alias("with_coordinates"))


def volume_report(log: DataFrame, now: Column) -> DataFrame:
    day = since(log, 1, now)
    return day.agg(F.count("*").alias("searches"), F.count("item").alias("clicks"), F.count_distinct("query").alias("unique_queries"))


def translation_stats(translations: DataFrame) -> DataFrame:
    return translations.groupBy("language").agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame, updated: str = "last_updated") -> DataFrame:
    """Eight characters that change when rows come, go or are updated."""
    return df.agg(F.substring(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.max(updated).cast("string"), F.lit("")))), 1, 8).alias("fingerprint"))


def dedupe_report(log: DataFrame) -> DataFrame:
    return log.groupBy("duplicate_type").agg(F.count("*").alias("removed"), F.count_distinct("kept_id").alias("kept"))


def flag_coverage(df: DataFrame, flags: list[str], enum: str) -> tuple[DataFrame, DataFrame]:
    """(counts, distribution): per flag how many rows are classified and how many true; rows per value of a nullable enum."""
    counts = df.agg(*(F.count(f).alias(f"{f}_known") for f in flags), *(F.count_if(true(F.col(f))).alias(f"{f}_true") for f in flags))
    return counts, df.groupBy(F.col(enum).alias("value")).agg(F.count("*").alias("n"))


def hit_rate(log: DataFrame, hit: str = "cache_hit") -> DataFrame:
    return log.agg(F.count("*").alias("lookups"), F.round(F.avg(F.when(true(F.col(hit)), 1.0).otherwise(0.0)), 4).alias("hit_rate"))


def reformulations(log: DataFrame, seconds: int = 30, key: str = "id") -> DataFrame:
    """Each search with whether its session searched again within some seconds."""
    nxt = F.lead("ts").over(Window.partitionBy("session").orderBy("ts", key))
    gap = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return log.withColumn("reformulated", true(gap <= seconds * 1_000_000) & F.col("session").isNotNull())


def attribute_clicks(metrics: DataFrame, clicks: DataFrame, key: str = "id") -> DataFrame:
    """Each click goes to its session's latest search at or before it; metrics gain first click position and click count.

    Searches and clicks of a session are laid out in one order by time, so the as-of match is a window and not a range join.
    """
    s = metrics.select("session", "ts", F.col(key).alias("_search"), F.lit(None).cast("int").alias("_position"), F.lit(0).alias("_kind"))
    c = clicks.select("session", "ts", F.lit(None).cast(metrics.schema[key].dataType).alias("_search"), F.col("position").cast("int").alias("_position"), F.lit(1).alias("_kind"))
    order = Window.partitionBy("session").orderBy("ts", "_kind", "_search").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = s.unionByName(c).where("session IS NOT NULL").withColumn("_of", F.last("_search", True).over(order))
    found = laid.where("_kind = 1 AND _of IS NOT NULL").groupBy("_of").agg(F.count("*").alias("click_count"), F.min_by("_position", F.struct("ts", "_position")).alias("first_click_position"))
    out = metrics.drop("click_count", "first_click_position").join(found, F.col(key) == F.col("_of"), "left").drop("_of")
    return out.withColumn("click_count", F.coalesce("click_count", F.lit(0)))

