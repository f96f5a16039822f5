"""Queries over item tables: filters, quality, duplicates, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.common import blank, contains
from lodestar.functions.geo import format_distance
from lodestar.functions.text import format_phone, org_key, truncate_text
from lodestar.operators import analytics as A, curate as E, duplicates as U, filters as FL, joins as J, projections as P
from lodestar.plans.tables import ITEMS, LOG, items, log, now, query, table, with_
from lodestar.sources import writers as S

NULL_FIRST = "NULLS FIRST"


def blank_sql(c: str) -> str:
    return f"coalesce({c}, '') = ''"


@query(with_(ITEMS) + "SELECT id, name, last_checked FROM items WHERE is_active")
def active_items(spark, sf_dir):
    return FL.active_items(items(spark, sf_dir)).select("id", "name", "last_checked")


@query(with_(ITEMS) + "SELECT id, category, name FROM items WHERE category IN ('Brand#11', 'Brand#23') AND is_active")
def by_categories(spark, sf_dir):
    return FL.by_categories(items(spark, sf_dir), ["Brand#11", "Brand#23"], active="is_active").select("id", "category", "name")


@query(with_(ITEMS) + "SELECT id, name FROM items WHERE name ILIKE '%re%' OR description ILIKE '%re%' OR location ILIKE '%re%'")
def text_contains(spark, sf_dir):
    return FL.text_contains(items(spark, sf_dir), "re", ["name", "description", "location"]).select("id", "name")


_SPEC = FL.Listing(equal={"is_active": True}, like={"location": "calgary"}, text="size 1", text_columns=("name", "description"), filled={"latitude": True}, sort="last_checked", descending=True, page=2, size=10)
_LISTED = "is_active AND location ILIKE '%calgary%' AND (name ILIKE '%size 1%' OR description ILIKE '%size 1%') AND latitude IS NOT NULL"


@query(with_(ITEMS) + f"SELECT id, last_checked FROM items WHERE {_LISTED} ORDER BY last_checked DESC NULLS FIRST, id LIMIT 10 OFFSET 10")
def listed_items(spark, sf_dir):
    return FL.list_items(items(spark, sf_dir), _SPEC)[0].select("id", "last_checked")


@query(with_(ITEMS) + f"SELECT count(*) AS total FROM items WHERE {_LISTED}")
def listed_total(spark, sf_dir):
    return FL.list_items(items(spark, sf_dir), _SPEC)[1]


@query(with_(ITEMS) + "SELECT id, location FROM items WHERE coalesce(location, '') = '' OR location ILIKE '%calgary%' OR location ILIKE '%province-wide%'")
def location_candidates(spark, sf_dir):
    return items(spark, sf_dir).where(FL.location_match("location", "Calgary")).select("id", "location")


@query(with_(ITEMS) + "SELECT id FROM items WHERE coalesce(location, '') = '' OR location ILIKE '%edmonton%' OR location ILIKE '%province-wide%' OR coalesce(service_format ILIKE '%online%', false) OR id < 20")
def location_filter(spark, sf_dir):
    return FL.filter_by_location(items(spark, sf_dir), "Edmonton", bypass=F.col("id") < 20).select("id")


@query(with_(ITEMS) + """SELECT id FROM items WHERE category IN ('Brand#11', 'Brand#12', 'Brand#13') AND (gender_restriction IS NULL OR gender_restriction IN ('all', 'women'))
  AND (age_group IS NULL OR age_group IN ('youth', 'youth_and_adult')) AND (service_format IS NULL OR lower(service_format) = 'online')""")
def hard_filters(spark, sf_dir):
    return FL.apply_hard_filters(items(spark, sf_dir), ["Brand#11", "Brand#12", "Brand#13"], gender="women_only", age="youth", fmt="Online").select("id")


@query(with_(ITEMS) + "SELECT id, name, confidence_score FROM items WHERE category = 'Brand#11' AND (location ILIKE '%calgary%' OR location ILIKE '%province-wide%' OR service_format ILIKE '%online%')")
def landing_page(spark, sf_dir):
    return FL.landing_page(items(spark, sf_dir), ["Brand#11"], "Calgary").select("id", "name", "confidence_score")


@query(with_(ITEMS) + """SELECT id, last_checked FROM (SELECT *, CASE WHEN last_checked IS NULL THEN 0 WHEN confidence_score < 60 THEN 1 ELSE 2 END AS u FROM items ORDER BY u, last_checked NULLS FIRST, id LIMIT 400)
  WHERE last_checked IS NULL OR last_checked < TIMESTAMP '2024-01-31' - INTERVAL 120 DAYS""")
def due_for_refresh(spark, sf_dir):
    return FL.due_for_refresh(items(spark, sf_dir), 120, 400, now()).select("id", "last_checked")


@query(with_(ITEMS) + """SELECT id, geocode_text FROM (SELECT id, CASE WHEN trim(coalesce(address, '')) <> '' THEN trim(address) || ', Alberta' WHEN trim(coalesce(location, '')) <> '' THEN trim(location) || ', Alberta' END AS geocode_text
  FROM items WHERE latitude IS NULL AND NOT coalesce(service_format ILIKE '%online%', false)) WHERE geocode_text IS NOT NULL""")
def geocode_candidates(spark, sf_dir):
    return FL.geocode_candidates(items(spark, sf_dir), "Alberta").select("id", "geocode_text")


@query(with_(ITEMS) + f"SELECT id FROM items WHERE {' + '.join(f'CASE WHEN {blank_sql(c)} THEN 0 ELSE 1 END' for c in ('phone', 'email', 'address', 'website_url'))} >= 3")
def data_rich(spark, sf_dir):
    return items(spark, sf_dir).where(FL.is_data_rich(["phone", "email", "address", "website_url"], 3)).select("id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAYS, false)")
def retained_orders(spark, sf_dir):
    return FL.retain(table(spark, sf_dir, "orders"), "o_orderdate", 365, F.expr("timestamp_ntz '2000-01-01 00:00:00'"))[0].select("o_orderkey", "o_orderdate")


@query("SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAYS) AS kept, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAYS) AS purged FROM orders")
def retention_counts(spark, sf_dir):
    return FL.retain(table(spark, sf_dir, "orders"), "o_orderdate", 365, F.expr("timestamp_ntz '2000-01-01 00:00:00'"))[1]


@query(with_(LOG) + "SELECT id, ts FROM log WHERE ts > TIMESTAMP '2024-01-30'")
def fresh_events(spark, sf_dir):
    return FL.fresh(log(spark, sf_dir), "ts", 24, now()).select("id", "ts")


@query(with_(ITEMS) + "SELECT 'brass' AS theme, count(*) FILTER (regexp_matches(description, 'brass', 'i')) AS n FROM items UNION ALL SELECT 'size 1x', count(*) FILTER (regexp_matches(description, 'size 1\\d\\b', 'i')) FROM items")
def theme_coverage(spark, sf_dir):
    return FL.coverage(items(spark, sf_dir), {"brass": "brass", "size 1x": r"size 1\d\b"}, F.col("description"))


@query(with_(ITEMS) + f"SELECT id, CASE WHEN {blank_sql('phone')} THEN 'no phone' WHEN {blank_sql('website_url')} THEN 'no site' ELSE 'low confidence' END AS issue FROM items WHERE {blank_sql('phone')} OR {blank_sql('website_url')} OR confidence_score < 20")
def low_quality(spark, sf_dir):
    rules = [("no phone", blank("phone")), ("no site", blank("website_url")), ("low confidence", F.col("confidence_score") < 20)]
    return FL.low_quality_records(items(spark, sf_dir), rules).select("id", "issue")


@query(with_(ITEMS) + """SELECT id, distance_km FROM (SELECT id, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS distance_km FROM (SELECT id,
  power(sin(radians(latitude - 51.05) / 2), 2) + cos(radians(51.05)) * cos(radians(latitude)) * power(sin(radians(longitude + 114.07) / 2), 2) AS h FROM items)) WHERE distance_km IS NULL OR distance_km <= 300""")
def within_distance(spark, sf_dir):
    from lodestar.functions.geo import haversine

    rows = items(spark, sf_dir).withColumn("distance_km", F.round(haversine(F.lit(51.05), F.lit(-114.07), "latitude", "longitude"), 6))
    return FL.within_km(rows, 300).select("id", "distance_km")


@query(with_(ITEMS) + """SELECT id, CASE WHEN d < 1 THEN CAST(CAST(floor(d * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' m' WHEN d < 10 THEN printf('%.1f', d) || ' km' WHEN d IS NOT NULL THEN CAST(CAST(floor(d + 0.5) AS BIGINT) AS VARCHAR) || ' km' END AS distance_text FROM (SELECT id, price / 97 AS d FROM items)""")
def distance_text(spark, sf_dir):
    return items(spark, sf_dir).select("id", format_distance(F.col("price") / 97).alias("distance_text"))


_FIELDS = {"phone": "phone", "email": "email", "website": "website_url", "address": "address", "location": "location"}


@query(with_(ITEMS) + " UNION ALL ".join(f"SELECT '{k}' AS field, floor(100.0 * count(*) FILTER (NOT ({blank_sql(c)})) / count(*) * 10 + 0.5) / 10 AS percent FROM items" for k, c in _FIELDS.items()))
def coverage_summary(spark, sf_dir):
    return A.coverage_summary(items(spark, sf_dir), {k: ~blank(c) for k, c in _FIELDS.items()})


@query(with_(ITEMS) + "SELECT round(avg(percent), 2) AS mean_percent, string_agg(field, ',' ORDER BY field) FILTER (percent < 70) AS below FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS field, floor(100.0 * count(*) FILTER (NOT ({blank_sql(c)})) / count(*) * 10 + 0.5) / 10 AS percent FROM items" for k, c in _FIELDS.items()) + ")")
def coverage_rollup(spark, sf_dir):
    s = A.coverage_summary(items(spark, sf_dir), {k: ~blank(c) for k, c in _FIELDS.items()})
    return A.coverage_rollup(s, 70).withColumn("below", F.array_join("below", ","))


def _quality(spark, sf_dir):
    rows = items(spark, sf_dir)
    lists = {c: F.when(F.col("id") % m != 0, F.array(F.lit("x"))) for c, m in (("process_steps", 5), ("required_docs", 7), ("languages_supported", 6), ("tags", 13))}
    texts = {c: F.when(F.col("id") % m != 0, "x") for c, m in (("eligibility", 9), ("hours_of_operation", 8), ("wait_times", 10))}
    stamps = {"embedding": F.when(F.col("id") % 17 != 0, F.array(F.lit(1.0))), "embedding_updated_at": F.when(F.col("id") % 4 == 0, F.expr("timestamp_ntz '2023-12-01 00:00:00'")), "geocoded_at": F.when(F.col("id") % 3 == 0, F.expr("timestamp_ntz '2023-11-01 00:00:00'"))}
    return rows.withColumns(lists | texts | stamps)


_QUALITY = ITEMS + """, q AS (SELECT *, id % 5 <> 0 AS steps, id % 7 <> 0 AS docs, id % 6 <> 0 AS langs, id % 13 <> 0 AS tagged, id % 9 <> 0 AS elig, id % 8 <> 0 AS hours, id % 10 <> 0 AS waits,
  id % 17 <> 0 AS vec, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2023-12-01' END AS vec_at, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2023-11-01' END AS geo_at,
  coalesce(phone, '') = '' AND coalesce(email, '') = '' AS no_contact FROM items),
s AS (SELECT *, NOT vec OR coalesce(last_updated > vec_at, false) AS old_vec, latitude IS NULL OR coalesce(last_updated > geo_at, false) AS old_geo FROM q WHERE is_active),
i AS (SELECT *, CASE WHEN no_contact THEN 'critical' ELSE 'medium' END AS severity FROM s WHERE NOT elig OR NOT steps OR NOT hours OR service_format IS NULL OR NOT tagged OR NOT langs OR website_url IS NULL OR old_vec OR old_geo OR no_contact)"""


@query(with_(_QUALITY) + """SELECT id, severity, list_aggregate(list_filter([CASE WHEN coalesce(phone, '') = '' THEN 'phone' END, CASE WHEN coalesce(email, '') = '' THEN 'email' END, CASE WHEN website_url IS NULL THEN 'websiteUrl' END,
  CASE WHEN NOT elig THEN 'eligibility' END, CASE WHEN address IS NULL THEN 'address' END, CASE WHEN NOT hours THEN 'hoursOfOperation' END, CASE WHEN NOT waits THEN 'waitTimes' END, CASE WHEN service_format IS NULL THEN 'serviceFormat' END,
  CASE WHEN NOT steps THEN 'processSteps' END, CASE WHEN NOT docs THEN 'requiredDocs' END, CASE WHEN NOT langs THEN 'languagesSupported' END, CASE WHEN NOT tagged THEN 'tags' END, CASE WHEN no_contact THEN 'noContact' END,
  CASE WHEN confidence_score < 30 THEN 'lowConfidence' END, CASE WHEN latitude IS NULL THEN 'latitude' END, CASE WHEN NOT vec THEN 'embedding' END, CASE WHEN vec AND coalesce(last_updated > vec_at, false) THEN 'staleEmbedding' END,
  CASE WHEN latitude IS NOT NULL AND coalesce(last_updated > geo_at, false) THEN 'staleGeocoding' END, CASE WHEN old_vec THEN 'freshEmbedding' END, CASE WHEN old_geo THEN 'freshGeocoding' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS missing_fields FROM i""")
def quality_issues(spark, sf_dir):
    return FL.quality_issues(_quality(spark, sf_dir)).select("id", "severity", F.array_join("missing_fields", ",").alias("missing_fields"))


@query(with_(_QUALITY) + "SELECT id, confidence_score FROM i WHERE severity = 'critical' AND confidence_score < 30")
def quality_filtered(spark, sf_dir):
    return FL.quality_issues(_quality(spark, sf_dir), "lowConfidence", "critical").select("id", "confidence_score")


@query(with_(ITEMS) + "SELECT category, count(*) AS n FROM items GROUP BY 1")
def category_counts(spark, sf_dir):
    return A.category_counts(items(spark, sf_dir))


@query(with_(ITEMS) + "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive, count(*) FILTER (is_active AND id % 17 <> 0) AS with_vector, count(*) FILTER (is_active AND latitude IS NOT NULL) AS with_coordinates FROM items")
def system_counts(spark, sf_dir):
    return A.system_counts(_quality(spark, sf_dir))


@query(with_(ITEMS) + "SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN phone IS NULL THEN 'no_phone' END, CASE WHEN phone IS NULL AND coalesce(email, '') = '' THEN 'no_contact' END, CASE WHEN location IS NULL THEN 'no_location' END, CASE WHEN website_url IS NULL THEN 'no_site' END, CASE WHEN length(description) < 50 THEN 'short_description' END, CASE WHEN regexp_matches(description, '(…|\\.\\.\\.)\\s*$') THEN 'truncated_description' END], lambda x: x IS NOT NULL)) AS issue FROM items) GROUP BY 1")
def audit_counts(spark, sf_dir):
    return A.audit_counts(items(spark, sf_dir), E.audit_flags())


@query(with_(ITEMS) + "SELECT substr(md5(CAST(count(*) AS VARCHAR) || '|' || strftime(max(last_updated), '%Y-%m-%d %H:%M:%S')), 1, 8) AS fingerprint FROM items")
def table_fingerprint(spark, sf_dir):
    return A.fingerprint(items(spark, sf_dir))


@query(with_(ITEMS) + "SELECT count(gender_restriction) AS gender_restriction_known, count(is_active) AS is_active_known, 0::BIGINT AS gender_restriction_true, count(*) FILTER (is_active) AS is_active_true FROM items")
def flag_coverage(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("gender_restriction", F.when(F.col("gender_restriction").isNotNull(), False))
    return A.flag_coverage(rows, ["gender_restriction", "is_active"], "age_group")[0]


@query(with_(ITEMS) + "SELECT age_group AS value, count(*) AS n FROM items GROUP BY 1")
def enum_distribution(spark, sf_dir):
    return A.flag_coverage(items(spark, sf_dir), ["is_active"], "age_group")[1]


@query("""SELECT duplicate_type, match_value, n, ids FROM (
  SELECT 'text' AS duplicate_type, md5(trim(lower(text))) AS match_value, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'opening', regexp_replace(lower(left(text, 20)), '[^a-z0-9]', '', 'g'), count(*), string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM documents WHERE text IS NOT NULL GROUP BY 2)
  WHERE n > 1 AND match_value <> ''""")
def duplicate_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = A.duplicate_groups(docs, F.md5(F.trim(F.lower("text"))), "text", "doc_id")
    b = A.duplicate_groups(docs, F.regexp_replace(F.lower(F.substring("text", 1, 20)), "[^a-z0-9]", ""), "opening", "doc_id")
    return a.unionByName(b).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


#: Keys of documents: the whole text without case, its letters and digits, the set of its words, and its first eight words.
def _doc_rules():
    words = F.split(F.lower(F.trim("text")), r"\s+")
    return [
        ("text", F.lower(F.trim("text"))),
        ("letters", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")),
        ("words", F.array_join(F.array_sort(F.array_distinct(words)), " ")),
        ("opening", J.name_head("text", 8)),
    ]


_CLASSES = r"""w AS (SELECT doc_id AS id, lower(trim(text, ' ')) AS t, regexp_split_to_array(lower(trim(text, ' ')), '[ \t\n\x0B\f\r]+') AS ws FROM documents),
k AS (SELECT id, rule, md5(v) AS k FROM (
  SELECT id, 'text' AS rule, t AS v FROM w UNION ALL SELECT id, 'letters', regexp_replace(t, '[^a-z0-9]', '', 'g') FROM w
  UNION ALL SELECT id, 'words', array_to_string(list_sort(list_distinct(ws)), ' ') FROM w UNION ALL SELECT id, 'opening', array_to_string(ws[1:8], ' ') FROM w) WHERE trim(v, ' ') <> ''),
c AS (SELECT rule, k, count(*) AS n, min(id) AS rep FROM k GROUP BY 1, 2 HAVING count(*) > 1),
m AS (SELECT id, rule, rep FROM k JOIN c USING (rule, k)), e AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM m x JOIN m y USING (id)),
g AS (SELECT rep, min(b) AS class_id FROM (WITH RECURSIVE r AS (SELECT DISTINCT a AS rep, a AS b FROM e UNION SELECT r.rep, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r) GROUP BY 1),
members AS (SELECT id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, min(class_id) AS class_id FROM m JOIN g USING (rep) GROUP BY 1)"""


def _members(spark, sf_dir):
    keys = U.duplicate_keys(table(spark, sf_dir, "documents"), _doc_rules(), "doc_id")
    return U.duplicate_members(keys, U.duplicate_classes(keys))


@query(with_(_CLASSES) + "SELECT * FROM members")
def duplicate_members(spark, sf_dir):
    return _members(spark, sf_dir).withColumn("rules", F.array_join("rules", ","))


@query(with_(_CLASSES) + """SELECT class_id, count(*) AS n, first(id ORDER BY n_chars DESC NULLS LAST, id) AS representative, count(*) FILTER (contains(rules, 'text')) AS n_text, count(*) FILTER (contains(rules, 'letters')) AS n_letters,
  count(*) FILTER (contains(rules, 'words')) AS n_words, count(*) FILTER (contains(rules, 'opening')) AS n_opening FROM members JOIN documents ON doc_id = id GROUP BY 1""")
def duplicate_class_summary(spark, sf_dir):
    return U.duplicate_summary(_members(spark, sf_dir), table(spark, sf_dir, "documents"), F.col("n_chars"), [r for r, _ in _doc_rules()], "doc_id")


_DEDUPE = """r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY score DESC, last_updated DESC NULLS LAST, id) AS k, first_value(id) OVER (PARTITION BY lower(trim(name)) ORDER BY score DESC, last_updated DESC NULLS LAST, id) AS best
  FROM (SELECT *, (CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END) + click_count AS score FROM items))"""


def _deduped(spark, sf_dir):
    score = F.when(F.col("phone").isNotNull(), 5).otherwise(0) + F.col("click_count")
    return E.dedupe_exact(items(spark, sf_dir), F.lower(F.trim("name")), score)


@query(with_(ITEMS, _DEDUPE) + "SELECT id, name FROM r WHERE k = 1")
def dedupe_kept(spark, sf_dir):
    return _deduped(spark, sf_dir)[0].select("id", "name")


@query(with_(ITEMS, _DEDUPE) + "SELECT best AS kept_id, id AS removed_id, lower(trim(name)) AS match_value FROM r WHERE k > 1")
def dedupe_log(spark, sf_dir):
    return _deduped(spark, sf_dir)[1]


@query(with_(ITEMS, _DEDUPE) + "SELECT 'name' AS duplicate_type, count(*) AS removed, count(DISTINCT best) AS kept FROM r WHERE k > 1")
def dedupe_report(spark, sf_dir):
    return A.dedupe_report(_deduped(spark, sf_dir)[1].withColumn("duplicate_type", F.lit("name")))


@query(with_(ITEMS) + "SELECT id, name FROM items i WHERE NOT is_active AND EXISTS (SELECT 1 FROM items a WHERE a.is_active AND lower(trim(a.name)) = lower(trim(i.name)))")
def inactive_twins(spark, sf_dir):
    return J.inactive_twins(items(spark, sf_dir)).select("id", "name")


_GRAMS = """g AS (SELECT v, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(v, '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t
  FROM (SELECT DISTINCT lower(trim(name)) AS v FROM items))"""


@query(with_(ITEMS, _GRAMS) + """, p AS (SELECT x.v AS vx, y.v AS vy, len(list_intersect(x.t, y.t)) * 1.0 / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS s FROM g x JOIN g y ON x.v <= y.v)
SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, round(s, 6) AS similarity FROM p JOIN items a ON lower(trim(a.name)) = vx JOIN items b ON lower(trim(b.name)) = vy WHERE s > 0.6 AND a.id < 400 AND b.id < 400 AND (vx <> vy OR a.id < b.id)""".replace("\n, p", ", p", 1).replace(" AND a.id < 400 AND b.id < 400", ""))
def similar_pairs(spark, sf_dir):
    return J.similar_pairs(items(spark, sf_dir), "name", 0.6)


@query("""WITH c AS (SELECT c_custkey AS id, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS v1, c_mktsegment || CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) AS v2 FROM customer)
SELECT a, b, rule FROM (SELECT a, b, arg_min(rule, i) AS rule FROM (
  SELECT x.id AS a, y.id AS b, 0 AS i, 'balance' AS rule FROM c x JOIN c y ON x.v1 = y.v1 AND x.id < y.id
  UNION ALL SELECT x.id, y.id, 1, 'segment' FROM c x JOIN c y ON x.v2 = y.v2 AND x.id < y.id) GROUP BY 1, 2)""")
def duplicate_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    b1 = F.floor("c_acctbal").cast("string")
    b2 = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.col("c_acctbal") / 100).cast("string"))
    return J.duplicate_candidates(c, [("balance", b1), ("segment", b2)])


@query("""SELECT o_orderkey, coalesce(d.p, b.o_totalprice) AS o_totalprice, coalesce(d.s, b.o_orderstatus) AS o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) b
  FULL JOIN (SELECT o_orderkey AS k, o_totalprice + 1 AS p, 'N' AS s FROM orders WHERE o_orderkey % 2 = 0) d ON o_orderkey = k WHERE o_orderkey IS NOT NULL
  UNION ALL SELECT o_orderkey, o_totalprice + 1, 'N' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""")
def upsert_orders(spark, sf_dir):
    from lodestar.common import upsert

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    delta = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return upsert(o.where("o_orderkey % 3 <> 0"), delta, ["o_orderkey"])


@query(with_(ITEMS) + """SELECT id, CASE WHEN is_active AND id % 5 = 0 THEN 'deactivated' WHEN NOT is_active AND id % 5 <> 0 THEN 'restored' ELSE 'updated' END AS change_type,
  concat_ws(',', CASE WHEN id % 4 = 0 THEN 'name' END, CASE WHEN is_active <> (id % 5 <> 0) THEN 'is_active' END) AS fields FROM items WHERE id % 4 = 0 OR is_active <> (id % 5 <> 0)""")
def diff_rows(spark, sf_dir):
    a = items(spark, sf_dir).select("id", "name", "is_active")
    b = a.select("id", F.when(F.col("id") % 4 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), (F.col("id") % 5 != 0).alias("is_active"))
    return E.diff_rows(a, b, ["name", "is_active"]).select("id", "change_type", F.array_join(F.map_keys("changed_fields"), ",").alias("fields"))


@query(with_(ITEMS) + "SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE phone END AS phone, CASE WHEN id % 6 = 0 THEN NULL ELSE email END AS email FROM items")
def apply_changes(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "phone", "email")
    changes = rows.where("id % 6 = 0").select("id", F.create_map(F.lit("phone"), F.lit("new"), F.lit("email"), F.lit("")).alias("fields"))
    return E.apply_changes(rows, changes, ["phone", "email"])[0]


_SIDE = "side AS (SELECT id, 'call ' || CAST(id AS VARCHAR) AS phone2, 'note' AS email2 FROM items WHERE id % 2 = 0)"


@query(with_(ITEMS, _SIDE) + "SELECT items.id, CASE WHEN trim(coalesce(phone, '')) <> '' THEN phone ELSE phone2 END AS phone, CASE WHEN trim(coalesce(email, '')) <> '' THEN email ELSE email2 END AS email FROM items LEFT JOIN side ON items.id = side.id")
def fill_gaps(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "phone", "email")
    side = rows.where("id % 2 = 0").select("id", F.concat(F.lit("call "), F.col("id").cast("string")).alias("phone2"), F.lit("note").alias("email2"))
    return P.fill_gaps(rows, side, {"phone": "phone2", "email": "email2"})


@query(with_(ITEMS) + "SELECT id, n_filled = 3 AS is_complete, CAST(n_filled AS INT) AS n_filled FROM (SELECT id, (CASE WHEN trim(coalesce(phone, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(email, '')) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(coalesce(location, '')) <> '' THEN 1 ELSE 0 END) AS n_filled FROM items)")
def completeness(spark, sf_dir):
    return P.completeness(items(spark, sf_dir), ["phone", "email", "location"]).select("id", "is_complete", F.col("n_filled").cast("int").alias("n_filled"))


@query(with_(ITEMS) + "SELECT id, substr(concat_ws(chr(10), trim(name), 'Category: ' || trim(category), 'Type: ' || trim(category), CASE WHEN location IS NOT NULL THEN 'Location: ' || location END, description), 1, 60) AS text FROM items")
def embedding_text(spark, sf_dir):
    parts = (("", "name"), ("Category: ", "category"), ("Type: ", "category"), ("Location: ", "location"), ("", "description"))
    return items(spark, sf_dir).select("id", P.embedding_text(parts, 60).alias("text"))


@query(with_(ITEMS) + """SELECT id, CASE WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE phone END AS keep, CASE WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] END AS strict
  FROM (SELECT id, phone, regexp_replace(phone, '\\D', '', 'g') AS d FROM items)""")
def phone_formats(spark, sf_dir):
    return items(spark, sf_dir).select("id", format_phone("phone").alias("keep"), format_phone("phone", "strict").alias("strict"))


@query("""WITH s AS (SELECT s_suppkey AS id, left(regexp_replace(regexp_replace(lower(s_name || ' ' || CAST(s_nationkey AS VARCHAR)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 12) AS b FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) AS i FROM s)
SELECT id, CASE WHEN i = 1 THEN b ELSE b || '-' || CAST(i AS VARCHAR) END AS slug FROM r""")
def unique_slugs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string")).alias("name"))
    none = spark.createDataFrame([], "slug string")
    return E.unique_slug(s, none, size=12).select("id", "slug")


@query(with_(ITEMS) + "SELECT min(id) FILTER (location = 'Province-wide') AS id, lower(trim(name)) AS base_name FROM items WHERE is_active GROUP BY 2 HAVING count(*) FILTER (location = 'Province-wide') > 0 AND count(*) FILTER (location IS NULL OR location <> 'Province-wide') > 0")
def dedupe_regional(spark, sf_dir):
    return E.dedupe_regional(items(spark, sf_dir), F.col("name"), F.col("location") == "Province-wide")


@query(with_(ITEMS) + """SELECT id, description, phone FROM (SELECT g AS id, arg_max(description, (length(description), -id)) AS description, arg_min(phone, (id <> g, id)) FILTER (phone IS NOT NULL) AS phone
  FROM (SELECT *, id - id % 3 AS g FROM items) WHERE id - id % 3 IN (SELECT id FROM items) GROUP BY 1)""")
def merge_group(spark, sf_dir):
    rows = items(spark, sf_dir)
    groups = rows.where("id % 3 <> 0").select((F.col("id") - F.col("id") % 3).alias("canonical"), F.col("id").alias("member"))
    alone = rows.where("id % 3 = 0").select(F.col("id").alias("canonical"), F.col("id").alias("member"))
    return E.merge_group(rows, groups.unionByName(alone))[0].select("id", "description", "phone")


@query(with_(ITEMS) + """SELECT a.id AS a, CASE WHEN b.id IS NULL THEN 'gone' WHEN b.t = a.t THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT id, name AS t FROM items) a LEFT JOIN (SELECT id, CASE WHEN id % 7 = 0 THEN name || '.' ELSE name END AS t FROM items WHERE id % 5 <> 0) b ON a.id = b.id""")
def detect_changes(spark, sf_dir):
    old = items(spark, sf_dir).select("id", F.col("name").alias("text"))
    new = old.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return E.detect_changes(old, new, "id").select(F.col("id").alias("a"), "status")


def _resolved(spark, sf_dir, review):
    rows = items(spark, sf_dir).where("is_active").select("id", "name", "phone", "email", "is_active", F.lit(None).cast("string").alias("page_hash"), "confidence_score")
    raw = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("raw_id"), F.when(F.col("s_suppkey") % 9 != 0, F.concat(F.lit("New "), (F.col("s_suppkey") % 30).cast("string"))).alias("name"), F.lit("111").alias("phone"), F.lit("a@b.c").alias("email"), F.lit(None).cast("string").alias("page_hash"))
    known = items(spark, sf_dir).groupBy("name").agg(F.min("id").alias("k")).select((F.col("k") + 100_000).alias("raw_id"), "name", F.lit("111").alias("phone"), F.lit("a@b.c").alias("email"), F.lit(None).cast("string").alias("page_hash"))
    return E.resolve_upsert(raw.unionByName(known), rows, review, ["phone", "email"])


@query(with_(ITEMS) + """, raw AS (SELECT s_suppkey AS raw_id, CASE WHEN s_suppkey % 9 <> 0 THEN 'New ' || CAST(s_suppkey % 30 AS VARCHAR) END AS name FROM supplier UNION ALL SELECT min(id) + 100000, name FROM items GROUP BY name),
live AS (SELECT lower(trim(name)) AS n, arg_min(phone, id) AS phone, min(id) AS id FROM (SELECT id, name, coalesce(phone, '') AS phone FROM items WHERE is_active) GROUP BY 1),
live2 AS (SELECT l.n, l.id, i.phone, i.email FROM live l JOIN items i ON i.id = l.id),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY raw_id) AS k FROM raw)
SELECT raw_id, CASE WHEN name IS NULL THEN 'skipped' WHEN k > 1 THEN 'skipped' WHEN live2.id IS NULL THEN 'created' WHEN coalesce(phone, '') = '' OR coalesce(email, '') = '' THEN 'enriched' ELSE 'skipped' END AS outcome FROM f LEFT JOIN live2 ON lower(trim(name)) = n""".replace("\n, raw", ", raw", 1))
def resolve_upsert(spark, sf_dir):
    return _resolved(spark, sf_dir, True)[2].select("raw_id", "outcome")


@query("SELECT 'run-1' AS run_id, count(*) FILTER (o_orderstatus = 'O') AS created, count(*) FILTER (o_orderstatus = 'F') AS enriched, count(*) FILTER (o_orderstatus = 'P') AS skipped, 0::BIGINT AS failed, 'a,b' AS phases, '{}' AS config FROM orders")
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "enriched").otherwise("skipped").alias("outcome"))
    return S.run_summary(o, "run-1", ["a", "b"], "{}").withColumn("phases", F.array_join("phases", ","))


@query(with_(ITEMS) + "SELECT id, name, lower(coalesce(location, '')) AS location_lower, lower(name || ' ' || category || ' ' || description) AS search_text FROM items WHERE is_active")
def search_view(spark, sf_dir):
    return S.build_search_view(items(spark, sf_dir), ["id", "name"])


@query(with_(ITEMS) + """SELECT loc, lastmod, changefreq, priority FROM (SELECT 'https://x.test/' AS loc, '2024-01-31' AS lastmod, 'daily' AS changefreq, '1.0' AS priority
  UNION ALL SELECT 'https://x.test/services/' || s, '2024-01-31', 'weekly', '0.8' FROM (SELECT DISTINCT lower(replace(category, '#', '-')) AS s FROM items)
  UNION ALL SELECT 'https://x.test/services/' || s || '/' || lower(r_name), '2024-01-31', 'weekly', '0.7' FROM (SELECT DISTINCT lower(replace(category, '#', '-')) AS s FROM items), region
  UNION ALL SELECT 'https://x.test/service/' || CAST(id AS VARCHAR), strftime(last_updated, '%Y-%m-%d'), 'monthly', '0.6' FROM items)""")
def sitemap(spark, sf_dir):
    rows = items(spark, sf_dir)
    cats = rows.select(F.lower(F.replace("category", F.lit("#"), F.lit("-"))).alias("category_slug")).distinct()
    cities = table(spark, sf_dir, "region").select(F.lower("r_name").alias("city_slug"))
    return S.sitemap_urls(rows, cats, cities, "https://x.test", now())


@query(with_(ITEMS) + "SELECT id, coalesce(lower(trim(split_part(name, ' — ', 1))), '') AS org FROM (SELECT id, name || ' — ' || category AS name FROM items)")
def organisation_keys(spark, sf_dir):
    return items(spark, sf_dir).select("id", org_key(F.concat("name", F.lit(" — "), "category")).alias("org"))


@query(with_(ITEMS) + """SELECT id, least(100, 50 + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN coalesce(email, '') <> '' THEN 5 ELSE 0 END + CASE WHEN website_url IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN length(description) > 50 THEN 10 ELSE 0 END
  + CASE WHEN id % 9 <> 0 THEN 5 ELSE 0 END + CASE WHEN id % 5 <> 0 THEN 5 ELSE 0 END + CASE WHEN id % 8 <> 0 THEN 5 ELSE 0 END + CASE WHEN address IS NOT NULL THEN 5 ELSE 0 END) AS confidence FROM items""")
def confidence_simple(spark, sf_dir):
    return _quality(spark, sf_dir).select("id", E.confidence_simple().alias("confidence"))


@query(with_(ITEMS) + "SELECT id, state FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'missing' WHEN id % 6 = 0 THEN 'stale' END AS state FROM items) WHERE state IS NOT NULL")
def stale_translations(spark, sf_dir):
    rows = items(spark, sf_dir)
    tr = rows.where("id % 4 <> 0").select(F.col("id").alias("item_id"), F.lit("fr").alias("language"), F.sha2(F.concat_ws("\x1f", F.when(F.col("id") % 6 == 0, F.lit("old")).otherwise(F.col("name")), F.coalesce("description", F.lit(""))), 256).alias("source_hash"))
    return E.stale_translations(rows, tr, "fr", ["name", "description"])


@query(None)
def truncated_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate_text("text").alias("short"))


@query("""SELECT o_orderkey AS request_id, o_custkey AS item_id, coalesce(c_name, 'new ' || CAST(o_orderkey AS VARCHAR)) AS name, o_orderstatus AS status FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey""")
def review_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderstatus").alias("status"), F.to_json(F.struct(F.concat(F.lit("new "), F.col("o_orderkey").cast("string")).alias("name"))).alias("proposed"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return J.review_listing(o, c).select("request_id", "item_id", "name", "status")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE -1 END AS o_custkey FROM orders")
def clean_orphans(spark, sf_dir):
    parent = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return J.clean_orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey", "c_custkey").withColumn("o_custkey", F.coalesce("o_custkey", F.lit(-1)))


@query("SELECT min(n_nationkey) AS id, n_regionkey AS item_id, lower(left(n_name, 8)) AS alias FROM nation GROUP BY 2, 3")
def dedupe_aliases(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("item_id"), F.substring("n_name", 1, 8).alias("alias"))
    return J.dedupe_aliases(n).withColumn("alias", F.lower("alias"))


@query(with_(ITEMS) + """, c(city, lat, lng) AS (VALUES ('Calgary', 51.05, -114.07), ('Edmonton', 53.55, -113.49), ('Red Deer', 52.27, -113.81)),
d AS (SELECT id, city, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (SELECT id, city, power(sin(radians(lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * power(sin(radians(lng - longitude) / 2), 2) AS h FROM items, c WHERE latitude IS NOT NULL))
SELECT items.id, coalesce(b.city, '') AS city FROM items LEFT JOIN (SELECT id, arg_min(city, km) AS city FROM d WHERE km < 50 GROUP BY 1) b ON items.id = b.id""".replace("\n, c", ", c", 1))
def nearest_city(spark, sf_dir):
    cities = spark.createDataFrame([("Calgary", 51.05, -114.07), ("Edmonton", 53.55, -113.49), ("Red Deer", 52.27, -113.81)], "city string, lat double, lng double")
    return J.nearest_city(items(spark, sf_dir).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng")), cities)


@query(with_(ITEMS) + "SELECT id, name FROM items WHERE id % 2 = 0 AND id % 7 <> 0 AND is_active")
def not_queued(spark, sf_dir):
    rows = items(spark, sf_dir)
    requests = rows.where("id % 7 = 0").select(F.col("id").alias("item_id"), F.lit("pending").alias("status"))
    return J.not_queued(J.keep_active(rows.where("id % 2 = 0"), rows.where("is_active"), "id"), requests).select("id", "name")


@query(with_(ITEMS) + "SELECT id, name FROM items WHERE NOT coalesce(gender_restriction = 'men', false) AND coalesce(description NOT ILIKE '%brass%', true)")
def exclusions(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("only_men", F.col("gender_restriction") == "men").withColumn("metal", F.lit(None).cast("boolean"))
    return FL.apply_exclusions(rows, {"men": ("only_men", "^$"), "metal": ("metal", "brass")}, F.col("description")).select("id", "name").where(~contains("name", "\x00"))
