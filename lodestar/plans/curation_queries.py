"""Queries for the remaining filters, joins, boosts, detectors and curation steps, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.common import edges, top
from lodestar.functions.text import slug
from lodestar.operators import analytics as A, curate as E, evaluate as V, filters as FL, joins as J, pages as PG, projections as P, querylog as Q, ranking as R
from lodestar.plans.tables import ITEMS, LOG, TERMS, TURNS, items, log, now, queries_table, query, table, term_queries, with_

# -- filters ---------------------------------------------------------------------------------------------------------------

_DEMO = "CASE n_nationkey % 4 WHEN 0 THEN 'single mother' WHEN 1 THEN 'senior man' WHEN 2 THEN 'teen' END"


@query(f"""SELECT n_nationkey AS query_id, coalesce(CASE WHEN n_nationkey % 6 = 0 THEN 'any' END, CASE WHEN d = 'single mother' THEN 'women' WHEN d = 'senior man' THEN 'men' END, '-') AS gender,
  coalesce(CASE WHEN d = 'teen' THEN 'youth' WHEN d = 'senior man' THEN 'senior' END, '-') AS age FROM (SELECT *, {_DEMO} AS d FROM nation)""")
def derived_filters(spark, sf_dir):
    q = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS query_id", f"{_DEMO} AS demographic", "CASE WHEN n_nationkey % 6 = 0 THEN 'any' END AS gender", "cast(NULL AS string) AS age")
    return FL.derive_filters(q).select("query_id", F.coalesce("gender", F.lit("-")).alias("gender"), F.coalesce("age", F.lit("-")).alias("age"))


@query(with_(ITEMS) + "SELECT id FROM items WHERE NOT (id % 3 = 0 AND regexp_matches(description, 'brass', 'i'))")
def intent_exclusion(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"primary": F.when(F.col("id") % 3 == 0, "metal").otherwise("x"), "secondary": F.lit("metal"), "secondary_confidence": F.lit(0.4)})
    return FL.exclude_by_pattern_when(rows, FL.intent_is("metal"), F.col("description"), "brass").select("id")


@query(with_(ITEMS) + "SELECT id FROM items WHERE id % 2 = 1 OR age_group IS NULL OR age_group IN ('youth', 'youth_and_adult')")
def age_filter(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"query_age": F.lit("youth"), "age_confidence": F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.5)})
    return FL.apply_age_filter(rows).select("id")


@query(with_(ITEMS) + "SELECT id, CAST(priority AS INT) AS priority FROM (SELECT *, CASE WHEN phone IS NULL THEN 1 WHEN website_url IS NULL THEN 2 WHEN confidence_score < 40 THEN 3 END AS priority FROM items) WHERE priority IS NOT NULL ORDER BY priority, last_checked NULLS FIRST, id LIMIT 500")
def enrichment_candidates(spark, sf_dir):
    rows = items(spark, sf_dir)
    return FL.enrichment_candidates(rows, 500, [F.col("phone").isNull(), F.col("website_url").isNull(), F.col("confidence_score") < 40], last="last_checked").select("id", F.col("priority").cast("int").alias("priority"))


@query(with_(ITEMS) + "SELECT id FROM items WHERE last_checked IS NULL OR id % 5 = 0 OR last_checked < TIMESTAMP '2024-01-31' - INTERVAL 90 DAYS")
def needs_enrichment(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("steps", F.when(F.col("id") % 5 != 0, F.array(F.lit("a"))))
    return rows.where(FL.needs_enrichment(now(), "steps", "last_checked")).select("id")


@query(with_(ITEMS) + """SELECT id FROM (SELECT *, CASE WHEN contains(d, 'brass') THEN 1 ELSE 0 END AS strong, CASE WHEN contains(d, 'tin') THEN 1 ELSE 0 END + CASE WHEN contains(d, 'size 1') THEN 1 ELSE 0 END AS weak FROM (SELECT *, lower(description) AS d FROM items))
  WHERE (strong >= 1 OR weak >= 2 OR (category = 'Brand#11' AND weak >= 1)) AND (NOT contains(d, 'size 4') OR contains(d, 'copper'))""")
def relevant_records(spark, sf_dir):
    return items(spark, sf_dir).where(FL.is_relevant(F.col("description"), F.col("category"), ["brass"], ["tin", "size 1"], ["Brand#11"], "size 4", "copper")).select("id")


@query(with_(ITEMS) + "SELECT id FROM items WHERE id % 7 <> 0 AND (description ILIKE '%size 24%' OR description ILIKE '%size 7 %')")
def always_open_candidates(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("is_24_7", F.when(F.col("id") % 7 == 0, True))
    return FL.always_open_candidates(rows, F.col("description"), patterns=("size 24", "size 7 ")).select("id")


@query(with_(ITEMS) + "SELECT id FROM items WHERE lower(category || ' — ' || name) LIKE 'brand#12 — %' ORDER BY id LIMIT 10")
def org_prefix(spark, sf_dir):
    return FL.org_prefix(items(spark, sf_dir).select("id", F.concat_ws(" — ", "category", "name").alias("name")), "Brand#12").select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0 AND vec_id % 3 = 0")
def embedding_worklist(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), (F.col("vec_id") % 4 != 0).alias("is_active"))
    return FL.embedding_worklist(e).select("id")


@query(with_(ITEMS) + "SELECT id, CASE WHEN website_url IS NULL THEN 'no-source' WHEN (id % 40) % 3 = 0 THEN 'set' ELSE 'dead' END AS outcome FROM items WHERE id % 2 = 0")
def backfill_sources(spark, sf_dir):
    rows = items(spark, sf_dir).where("id % 2 = 0").withColumn("source_urls", F.array().cast("array<string>"))
    reach = spark.range(40).select(F.concat(F.lit("https://site"), F.col("id").cast("string"), F.lit(".test/a")).alias("url"), (F.col("id") % 3 == 0).alias("reachable"))
    return FL.backfill_sources(rows, reach).select("id", "outcome")


# -- projections -----------------------------------------------------------------------------------------------------------

@query(with_(ITEMS) + "SELECT id, concat_ws(',', CASE WHEN coalesce(email, '') = '' THEN 'email=new' END, CASE WHEN coalesce(phone, '') = '' THEN 'phone=111' END) AS updates FROM items WHERE coalesce(phone, '') = '' OR coalesce(email, '') = ''")
def enrichment_updates(spark, sf_dir):
    u = P.enrichment_updates({"email": F.col("email"), "phone": F.col("phone")}, {"email": F.lit("new"), "phone": F.lit("111")})
    pairs = F.transform(F.map_entries("u"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return items(spark, sf_dir).select("id", u.alias("u")).where("u IS NOT NULL").select("id", F.array_join(pairs, ",").alias("updates"))


@query(with_(ITEMS) + "SELECT id, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, CAST(CAST(floor(price / 10 + 0.5) AS BIGINT) AS VARCHAR) || ' km' AS distance_text FROM items WHERE price >= 100 AND latitude IS NOT NULL")
def cards(spark, sf_dir):
    rows = items(spark, sf_dir).where("price >= 100 AND latitude IS NOT NULL").withColumn("distance_km", F.col("price") / 10)
    return P.card(rows, ["id"])


@query(with_(TERMS) + "SELECT query_id, CASE WHEN query_id % 3 = 1 THEN '1 result' ELSE CAST(query_id % 3 AS VARCHAR) || ' results' END || ' for \"' || text || '\"' || coalesce(' in ' || location, '') AS summary FROM terms")
def summaries(spark, sf_dir):
    return term_queries(spark, sf_dir).select("query_id", P.summary_text(F.col("query_id") % 3, F.col("text"), F.col("location")).alias("summary"))


# -- joins -----------------------------------------------------------------------------------------------------------------

@query("SELECT o_orderkey AS history_id, o_custkey AS item_id, coalesce(c_name, '-') AS name FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def recent_activity(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("history_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderdate").alias("changed_at"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return J.recent_activity(h, c, 25).select("history_id", "item_id", F.coalesce("name", F.lit("-")).alias("name"))


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def attached_nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.attach(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", ["n_name"])


_BASE = "b AS (SELECT c_nationkey AS query_id, c_custkey AS item_id FROM customer WHERE c_custkey % 3 = 0), e AS (SELECT c_nationkey AS query_id, c_custkey AS item_id FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_BASE} SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = e.query_id AND b.item_id = e.item_id) AND query_id NOT IN (SELECT query_id FROM b GROUP BY 1 HAVING count(*) >= 20)")
def supplemented(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item_id"))
    return J.supplement(c.where("item_id % 3 = 0"), c.where("item_id % 2 = 0"), ["query_id", "item_id"], 20)


@query(with_(ITEMS) + """SELECT id FROM items w WHERE NOT (coalesce(location, '') = 'Province-wide' AND EXISTS (SELECT 1 FROM items l WHERE coalesce(l.location, '') <> 'Province-wide' AND l.category = w.category AND starts_with(lower(l.name), lower(w.name))))""")
def region_wide_suppressed(spark, sf_dir):
    return J.suppress_region_wide(items(spark, sf_dir), F.col("location") == "Province-wide", F.col("name"), "category").select("id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS bn, coalesce(p, '-') AS programs, coalesce(u, '-') AS url FROM customer LEFT JOIN (SELECT o_custkey AS k, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS p FROM orders GROUP BY 1) ON c_custkey = k
  LEFT JOIN (SELECT o_custkey AS k2, arg_max('https://' || o_orderstatus || '.org', o_orderkey) AS u FROM orders GROUP BY 1) ON c_custkey = k2""")
def charities(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ident = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bn"))
    programs = o.select(F.col("o_custkey").cast("string").alias("bn"), F.col("o_orderpriority").alias("description"), F.col("o_orderkey").alias("line"))
    urls = o.select(F.col("o_custkey").cast("string").alias("bn"), F.concat("o_orderstatus", F.lit(".org")).alias("url"), F.col("o_orderkey").alias("line"))
    return J.build_charities(ident, programs, urls).select("bn", F.coalesce("programs", F.lit("-")).alias("programs"), F.coalesce("url", F.lit("-")).alias("url"))


@query("""WITH r AS (SELECT query_id, item_id, name, score, similarity, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS s2 FROM (
  SELECT c_nationkey AS query_id, c_custkey AS item_id, c_mktsegment || ' — ' || c_name AS name, c_acctbal AS score, 0.9 AS similarity FROM customer WHERE c_custkey % 5 = 0))
SELECT DISTINCT query_id, CAST(c_custkey AS BIGINT) AS item_id FROM r JOIN customer ON split_part(r.name, ' — ', 1) = c_mktsegment WHERE k = 1 AND score >= 1.05 * coalesce(s2, 0) AND NOT EXISTS (SELECT 1 FROM r x WHERE x.query_id = r.query_id AND x.item_id = c_custkey)""")
def org_siblings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("name", F.concat_ws(" — ", "c_mktsegment", "c_name"))
    ranked = c.where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item_id"), "name", F.col("c_acctbal").alias("score"), F.lit(0.9).alias("similarity"))
    return J.insert_org_siblings(ranked, c.select(F.col("c_custkey").alias("id"), "name"), lead=1.05).select("query_id", "item_id")


@query("WITH " + ITEMS + """, r AS (SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN p_name || ' north' ELSE substr(p_name, 2, 6) END AS name, '403-555-' || lpad(CAST(p_partkey % 700 AS VARCHAR), 4, '0') AS phone FROM part WHERE p_partkey % 20 = 0)
SELECT request_id, id AS item_id, CASE WHEN items.phone = r.phone THEN 'phone' ELSE 'name' END AS reason FROM r JOIN items ON items.phone = r.phone
  OR (least(length(trim(r.name)), length(items.name)) >= 3 AND (contains(lower(items.name), lower(trim(r.name))) OR contains(lower(trim(r.name)), lower(items.name))))""")
def create_warnings(spark, sf_dir):
    name = "CASE p_partkey % 3 WHEN 0 THEN concat(' ', upper(p_name)) WHEN 1 THEN concat(p_name, ' north') ELSE substr(p_name, 2, 6) END AS name"
    r = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").selectExpr("p_partkey AS request_id", name, "concat('(403) 555 ', lpad(cast(p_partkey % 700 AS string), 4, '0')) AS phone")
    return J.create_warnings(r, items(spark, sf_dir))


@query(with_(ITEMS) + "SELECT a.id - 1 AS kept, a.id AS removed FROM items a JOIN items b ON b.id = a.id - 1 WHERE a.id % 2 = 1 AND a.is_active AND b.is_active")
def known_duplicates(spark, sf_dir):
    rows = items(spark, sf_dir)
    return J.apply_known_duplicates(rows, rows.where("id % 2 = 1").select((F.col("id") - 1).alias("kept"), F.col("id").alias("removed")))


@query(with_(ITEMS) + "SELECT id, CASE WHEN id % 3 = 0 THEN 'fr ' || name ELSE name END AS name, id % 3 = 0 AS translated FROM items")
def localised(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "name")
    tr = rows.where("id % 3 = 0").select(F.col("id").alias("item_id"), F.lit("fr").alias("language"), F.concat(F.lit("fr "), "name").alias("name"))
    return J.localise(rows, tr, "fr", ["name"])[0]


@query(with_(ITEMS) + "SELECT 'fr' AS language, count(*) FILTER (id % 3 = 0) AS n FROM items UNION ALL SELECT 'es', count(*) FILTER (id % 3 = 1) FROM items")
def translation_stats(spark, sf_dir):
    tr = items(spark, sf_dir).where("id % 3 < 2").select(F.when(F.col("id") % 3 == 0, "fr").otherwise("es").alias("language"))
    return A.translation_stats(tr)


_NEW = "n AS (SELECT s_suppkey AS id, 'Customer#' || lpad(CAST(s_suppkey * 40 AS VARCHAR), 9, '0') AS name FROM supplier)"


@query(f"WITH {_NEW} SELECT id, name FROM n WHERE name NOT IN (SELECT c_name FROM customer)")
def inserted_absent(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('Customer#', lpad(cast(s_suppkey * 40 AS string), 9, '0')) AS name")
    return J.insert_absent(new, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), slug("name"))[0]


# -- ranking ---------------------------------------------------------------------------------------------------------------

def _pairs(spark, sf_dir):
    """A ranked list: each item under the query of its number modulo 50, scored by price."""
    rows = items(spark, sf_dir).withColumnRenamed("id", "item_id")
    return rows.withColumn("query_id", F.col("item_id") % 50).withColumn("score", F.col("price"))


_P = ITEMS + ", p AS (SELECT id % 50 AS query_id, id AS item_id, price AS score, items.* FROM items)"


@query(with_(_P) + """SELECT query_id, item_id, round(score + CASE WHEN t = lower(name) THEN 500 WHEN t = lower(category) THEN 500 ELSE 0 END, 6) AS score FROM (SELECT *, CASE WHEN item_id % 3 = 0 THEN lower(name) WHEN item_id % 3 = 1 THEN lower(category) ELSE 'zz' END AS t FROM p)""")
def name_boost(spark, sf_dir):
    t = F.when(F.col("item_id") % 3 == 0, F.upper("name")).when(F.col("item_id") % 3 == 1, F.col("category")).otherwise("zz")
    rows = _pairs(spark, sf_dir).withColumn("text", t).withColumn("aliases", F.array("category"))
    return R.boost_name_match(rows, []).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query(with_(_P) + """SELECT query_id, item_id, round(score * (1 + CASE WHEN confidence_score >= 80 THEN 0.10 WHEN confidence_score >= 60 THEN 0.05 WHEN confidence_score < 40 AND confidence_score <> 0 THEN -0.03 ELSE 0 END
  + CASE WHEN length(description) >= 200 THEN 0.10 WHEN length(description) >= 100 THEN 0.05 WHEN length(description) < 50 THEN -0.03 ELSE 0 END), 6) AS score FROM p""")
def quality_boost(spark, sf_dir):
    return R.boost_quality(_pairs(spark, sf_dir)).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query(with_(_P) + "SELECT query_id, item_id, round(score * CASE WHEN service_format = 'Online' THEN 1.8 WHEN contains(lower(description), 'brass') THEN 1.4 ELSE 1 END, 6) AS score FROM p")
def preference_boost(spark, sf_dir):
    rows = R.boost_preferences(_pairs(spark, sf_dir), [(F.lit(True), F.col("service_format") == "Online", F.contains(F.lower("description"), F.lit("brass")))])
    return rows.select("query_id", "item_id", F.round("score", 6).alias("score"))


@query(with_(_P) + "SELECT query_id, item_id, round(score * CASE WHEN contains(lower(description), 'brass') THEN 1.15 ELSE 1 END * CASE WHEN category = 'Brand#11' THEN 1.15 ELSE 1 END, 6) AS score FROM p")
def sub_intent_boost(spark, sf_dir):
    rows = R.boost_sub_intent(_pairs(spark, sf_dir), F.contains(F.lower("description"), F.lit("brass")), F.col("category") == "Brand#11")
    return rows.select("query_id", "item_id", F.round("score", 6).alias("score"))


@query(with_(_P) + "SELECT query_id, item_id, CASE WHEN query_id % 3 = 0 AND category NOT IN ('Brand#11', 'Brand#12') THEN 0.3 ELSE 1 END AS factor FROM p")
def off_category_penalty(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("primary", F.element_at(F.array(F.lit("a"), F.lit("wide"), F.lit("none")), (F.col("query_id") % 3 + 1).cast("int"))).withColumn("score", F.lit(1.0))
    owned = spark.createDataFrame([("a", "Brand#11"), ("a", "Brand#12"), ("wide", "Brand#11")], "label string, category string")
    return R.penalise_off_category(rows, owned, ["wide"]).select("query_id", "item_id", F.col("score").alias("factor"))


@query(with_(_P) + "SELECT query_id, item_id, round(score * CASE WHEN query_id % 2 = 0 AND category = 'Brand#11' THEN 1 + 1.5 * 0.6 WHEN query_id % 2 = 0 AND contains(lower(description), 'brass') THEN 1 + 0.3 * 0.6 ELSE 1 END, 6) AS score FROM p")
def dual_intent_boost(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("secondary_confidence", F.when(F.col("query_id") % 2 == 0, 0.6).otherwise(0.3))
    rows = R.boost_dual_intent(rows, F.col("category") == "Brand#11", F.contains(F.lower("description"), F.lit("brass")))
    return rows.select("query_id", "item_id", F.round("score", 6).alias("score"))


@query(with_(_P) + "SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN location ILIKE '%calgary%' THEN 3 WHEN location ILIKE '%province%' OR location IS NULL THEN 2 ELSE 1 END DESC, score DESC, item_id) AS INT) AS rank FROM p")
def location_order(spark, sf_dir):
    return R.sort_by_location(_pairs(spark, sf_dir).withColumn("query_location", F.lit("Calgary"))).select("query_id", "item_id", "rank")


@query(with_(_P) + "SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY latitude NULLS LAST, item_id) AS INT) AS rank FROM p")
def distance_order(spark, sf_dir):
    return R.sort_by_distance(_pairs(spark, sf_dir).withColumn("distance_km", F.col("latitude"))).select("query_id", "item_id", "rank")


@query(with_(_P) + "SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN item_id < 50 THEN 0 ELSE 1 END, score DESC, item_id) AS INT) AS rank FROM p")
def pinned(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("query_id", "item_id", "score")
    return R.pin(rows, rows.where("item_id < 50").select("query_id", "item_id", F.lit(1).alias("pinned_rank"))).select("query_id", "item_id", "rank")


@query(with_(_P) + """, g AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r, count(*) OVER (PARTITION BY query_id) AS n, CASE WHEN category IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'low' ELSE category END AS g FROM p)
SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY low, r) AS INT) AS rank FROM (SELECT *, n > 15 AND r <= 15 AND row_number() OVER (PARTITION BY query_id, g ORDER BY r) > 1 AS low FROM g)""".replace("\n, g", ", g", 1))
def category_diversity(spark, sf_dir):
    groups = spark.createDataFrame([(f"Brand#1{k}", "low") for k in (1, 2, 3)], "category string, group string")
    return R.diversify_categories(_pairs(spark, sf_dir), groups, most=1).select("query_id", "item_id", "rank")


@query(with_(TERMS, ITEMS) + "SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'alias' WHEN n >= 10 AND m > 80 AND query_id % 2 = 1 THEN 'lexical' ELSE 'full' END AS tier FROM (SELECT terms.query_id, count(items.id) AS n, avg(price) AS m FROM terms LEFT JOIN items ON items.name = terms.text GROUP BY 1)")
def routed_tiers(spark, sf_dir):
    q = term_queries(spark, sf_dir)
    lexical = q.join(items(spark, sf_dir).select(F.col("name").alias("text"), F.col("id").alias("item_id"), F.col("price").alias("score")), "text")
    return R.route_tier(q, q.where("query_id % 4 = 0"), lexical, F.col("query_id") % 2 == 1)


@query(with_(TERMS) + "SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'wide a' ELSE 'wide b' END AS text FROM terms WHERE query_id % 3 <> 0")
def fallback_queries(spark, sf_dir):
    q = term_queries(spark, sf_dir).withColumn("primary", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b"))
    broad = spark.createDataFrame([("a", "wide a"), ("b", "wide b")], "label string, terms string")
    return R.fallback_terms(q, q.where("query_id % 3 = 0"), broad).select("query_id", "text")


@query(with_(ITEMS) + "SELECT id, category, CAST(floor((row_number() OVER (PARTITION BY category ORDER BY id) - 1) / 3) AS BIGINT) AS batch FROM items")
def batches(spark, sf_dir):
    return R.batch_by(items(spark, sf_dir), "category", 3).select("id", "category", "batch")


@query(None)
def sampled_peers(spark, sf_dir):
    return R.sample_peers(items(spark, sf_dir), "category", 5, good=F.col("phone").isNotNull()).select("id", "category")


@query("""WITH i AS (SELECT c_custkey AS item_id, c_name AS name, CASE c_nationkey % 5 WHEN 0 THEN 'Calgary' WHEN 1 THEN 'Province-wide' ELSE 'Edmonton' END AS location FROM customer WHERE c_custkey < 60), q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 2 WHEN 0 THEN 'calgary' ELSE 'nowhere' END AS place FROM nation)
SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY t, name, item_id) AS INT) AS rank FROM (SELECT query_id, item_id, name, min(CASE WHEN item_id = 7 THEN 0 WHEN lower(location) = place THEN 1 ELSE 2 END) AS t FROM q, i WHERE item_id = 7 OR lower(location) = place OR location = 'Province-wide' GROUP BY 1, 2, 3)""")
def hotlines(spark, sf_dir):
    i = table(spark, sf_dir, "customer").where("c_custkey < 60").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("CASE c_nationkey % 5 WHEN 0 THEN 'Calgary' WHEN 1 THEN 'Province-wide' ELSE 'Edmonton' END").alias("location"))
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.expr("CASE n_nationkey % 2 WHEN 0 THEN 'Calgary' ELSE 'Nowhere' END").alias("location"))
    return R.hotline_list(i, q, 7, []).select("query_id", "item_id", "rank")


# -- query texts -----------------------------------------------------------------------------------------------------------

@query(with_(TURNS) + "SELECT query_id, CASE WHEN regexp_matches(whole, '\\b(the|of)\\b', 'i') THEN 'english' WHEN regexp_matches(whole, '\\b(der|die)\\b', 'i') THEN 'german' ELSE '-' END AS label FROM turns")
def first_labels(spark, sf_dir):
    return queries_table(spark, sf_dir).select("query_id", F.coalesce(Q.first_label(F.col("whole"), [("english", r"\b(the|of)\b"), ("german", r"\b(der|die)\b")]), F.lit("-")).alias("label"))


@query(with_(TURNS) + "SELECT query_id, regexp_matches(whole, '\\bthe\\b', 'i') AND (NOT regexp_matches(whole, '\\bof\\b', 'i') OR regexp_matches(whole, '\\bin\\b', 'i')) AS critical, regexp_matches(whole, '\\bthe\\b', 'i') AND regexp_matches(whole, '\\band\\b', 'i') AS third_party FROM turns")
def critical_flags(spark, sf_dir):
    return Q.flag_critical(queries_table(spark, sf_dir), r"\bthe\b", "$^", r"\band\b", r"\bof\b", r"\bin\b", "whole").select("query_id", "critical", "third_party")


@query(with_(TURNS) + "SELECT query_id, array_to_string(list_distinct(regexp_extract_all(lower('x not ' || whole), '\\bnot\\s+(?:a\\s+|any\\s+|the\\s+)?([\\p{L}][\\p{L}''-]+)', 1))[1:10], ',') AS negatives FROM turns WHERE NOT regexp_matches(whole, '\\b(no|without|except|excluding)\\b|[- ]free\\b', 'i')")
def negatives(spark, sf_dir):
    q = queries_table(spark, sf_dir).where(~F.col("whole").rlike("(?iu)" + edges(r"\b(no|without|except|excluding)\b|[- ]free\b"))).withColumn("t", F.concat(F.lit("x not "), "whole"))
    return q.select("query_id", F.array_join(Q.negative_terms("t"), ",").alias("negatives"))


@query(with_(TURNS) + "SELECT query_id, regexp_matches(whole, 'th', 'i') AS th, regexp_matches(whole, '^[a-z]', 'i') AS ascii FROM turns")
def topic_flags(spark, sf_dir):
    return Q.topic_flags(queries_table(spark, sf_dir), {"th": "th", "ascii": "^[a-z]"}, "whole").select("query_id", "th", "ascii")


@query(with_(TERMS) + "SELECT query_id, 'h:full:' || lower(text) || coalesce(':' || lower(location), '') AS key FROM terms WHERE NOT regexp_matches(text, '[^a-z ]')")
def cache_keys(spark, sf_dir):
    q = term_queries(spark, sf_dir).where(~F.col("text").rlike("[^a-z ]"))
    return q.select("query_id", Q.cache_key(F.lit("h"), F.lit("full"), F.col("text"), F.col("location")).alias("key"))


@query("SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE -1 END AS alias_item FROM supplier")
def matched_aliases(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS query_id", "concat('find ', CASE WHEN s_suppkey % 3 = 0 THEN concat('nation_', cast(s_nationkey AS string)) ELSE 'zz' END, ' now') AS text")
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("item_id"))
    return Q.match_alias(q, a).select("query_id", F.coalesce("alias_item", F.lit(-1)).alias("alias_item"))


@query(with_(TURNS) + "SELECT query_id, string_agg(s, ',' ORDER BY s) AS sub_labels FROM (SELECT query_id, 'the' AS s FROM turns WHERE regexp_matches(whole, '\\bthe\\b', 'i') UNION ALL SELECT query_id, 'of' FROM turns WHERE regexp_matches(whole, '\\bof\\b', 'i')) GROUP BY 1")
def sub_labels(spark, sf_dir):
    q = queries_table(spark, sf_dir)
    patterns = spark.createDataFrame([("a", "the", r"\bthe\b"), ("a", "of", r"\bof\b"), ("b", "never", ".")], "parent string, sub_label string, pattern string")
    return Q.sub_labels(q, q.select("query_id", F.lit("a").alias("label")), patterns, "whole").withColumn("sub_labels", F.array_join("sub_labels", ","))


@query("""SELECT c_custkey AS query_id, CASE WHEN t THEN 'home' ELSE 'food' END AS primary, CASE WHEN t THEN c ELSE 0.4 END AS primary_confidence FROM (SELECT *, c > 0.5 + 1e-9 AS t FROM (SELECT c_custkey, (c_custkey % 10) / 10.0 AS c FROM customer))""".replace("CASE WHEN t THEN c ELSE 0.4 END", "CAST(CASE WHEN t THEN c ELSE 0.4 END AS DOUBLE)"))
def merged_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    p = c.select("query_id", F.lit("food").alias("primary"), F.lit(0.4).alias("primary_confidence"), F.lit(None).cast("string").alias("secondary"), F.lit(None).cast("double").alias("secondary_confidence"), F.array().cast("array<string>").alias("sub_labels"), F.lit(False).alias("first_person"))
    e = c.select("query_id", F.lit("home").alias("label"), ((F.col("query_id") % 10) / 10.0).alias("confidence"), F.array().cast("array<string>").alias("sub_labels"))
    return Q.merge_labels(p, e, ["food", "home"], "crisis").select("query_id", "primary", "primary_confidence")


# -- curation --------------------------------------------------------------------------------------------------------------

@query(with_(ITEMS) + "SELECT id, CASE WHEN coalesce(phone, '') = '' AND id % 2 = 0 THEN 'n' ELSE phone END AS phone, coalesce(CASE WHEN coalesce(email, '') = '' AND id % 2 = 0 THEN 'e' END, email) AS email FROM items")
def filled_empty(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "phone", "email")
    new = rows.where("id % 2 = 0").select("id", F.lit("n").alias("phone"), F.lit("e").alias("email"))
    return E.fill_empty(rows, new, ["phone", "email"]).drop("changed_fields")


@query(with_(ITEMS) + "SELECT id, CASE WHEN id % 6 = 0 THEN false ELSE is_active END AS is_active FROM items")
def deactivated(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "is_active")
    return E.set_active(rows, rows.where("id % 6 = 0"), False)


@query(with_(ITEMS) + """SELECT id, CAST(s AS INT) AS score, CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS level FROM (SELECT id, greatest(0, least(100, 40 + CASE WHEN phone IS NOT NULL AND id % 2 = 0 THEN 30 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 20 ELSE 0 END
  - CASE WHEN website_url IS NULL THEN 15 ELSE 0 END - CASE WHEN last_checked < TIMESTAMP '2024-01-31' - INTERVAL 180 DAYS THEN 10 ELSE 0 END)) AS s FROM items)""")
def sourced_confidence(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("field_sources", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("phone"), F.lit("u"), F.lit("name"), F.lit("u"))))
    score = E.confidence_sourced(now(), {"phone": 30, "name": 20}, {"site": (F.col("website_url").isNull(), 15)})
    return rows.select("id", score.cast("int").alias("score"), E.confidence_level(score).alias("level"))


@query(with_(ITEMS) + "SELECT id, concat_ws(',', 'old', CASE WHEN contains(lower(description), 'brass') THEN 'brass' END, CASE WHEN contains(lower(description), 'tin') THEN 'tin' END) AS tags FROM items")
def description_tags(spark, sf_dir):
    tags = E.tags_from_text(F.col("description"), F.array(F.lit("old")), [("brass", "brass"), ("tin", "tin"), ("OLD", ".")])
    return items(spark, sf_dir).select("id", F.array_join(tags, ",").alias("tags"))


@query(with_(ITEMS) + """SELECT id, CASE WHEN id % 5 = 0 THEN 'youth' WHEN id % 5 = 1 THEN 'senior' WHEN id % 5 = 2 THEN 'adult' ELSE '-' END AS "group", CASE WHEN id % 5 < 3 THEN 'eligibility' ELSE '-' END AS source FROM items""")
def age_groups(spark, sf_dir):
    text = F.element_at(F.array(F.lit("ages 13 to 17"), F.lit("for people 65 and over"), F.lit("adults only"), F.lit("all"), F.lit("")), (F.col("id") % 5 + 1).cast("int"))
    g = E.age_group([("eligibility", text), ("name", F.col("name"))])
    return items(spark, sf_dir).select("id", F.coalesce(g["group"], F.lit("-")).alias("group"), F.coalesce(g["source"], F.lit("-")).alias("source"))


@query(with_(ITEMS) + "SELECT id, contains(lower(description), 'brass') AND NOT contains(lower(description), 'size 1') AS is_faith_based, contains(lower(description), 'tin') AS is_12_step FROM items")
def exclusion_flags(spark, sf_dir):
    return items(spark, sf_dir).select("id", *E.exclusion_flags(F.when(F.contains("description", F.lit("size 1")), F.regexp_replace("description", "(?i)brass", "x")).otherwise(F.col("description")), "brass", "never said", "tin"))


@query(with_(ITEMS) + "SELECT id, 'no place' AS issue, 'add' AS suggestion, 'r1' AS reason FROM items WHERE location IS NULL UNION ALL SELECT id, 'list', 'split', 'r2' FROM items WHERE location LIKE '%,%'")
def category_issues(spark, sf_dir):
    return E.category_issues(items(spark, sf_dir), [("no place", F.col("location").isNull(), "add", "r1"), ("list", F.contains("location", F.lit(",")), "split", "r2")])


@query(with_(ITEMS) + """SELECT id, CASE WHEN location IS NULL THEN '-' WHEN location = 'Red Deer, Calgary' THEN 'Calgary' ELSE location END AS location, CASE WHEN location IS NULL THEN 'empty' WHEN location = 'Province-wide' THEN 'unresolved' WHEN location = 'Red Deer, Calgary' THEN 'changed' ELSE 'kept' END AS outcome FROM items""")
def normalised_locations(spark, sf_dir):
    g = spark.createDataFrame([(1, "calgary", "calgary"), (2, "edmonton", "edmonton")], "ordinal int, alias string, place string")
    return E.normalise_locations(items(spark, sf_dir), g).select("id", F.coalesce("location", F.lit("-")).alias("location"), "outcome")


@query(with_(ITEMS) + "SELECT id, coalesce(location, 'Alberta') AS location FROM items")
def default_locations(spark, sf_dir):
    return items(spark, sf_dir).select("id", E.fill_default("location", "Alberta").alias("location"))


@query(with_(ITEMS) + """SELECT id, CASE WHEN id % 10 = 0 THEN 'new ' || CAST(id + 2000000 AS VARCHAR) ELSE name END AS name, CASE WHEN id % 10 = 1 THEN false ELSE is_active END AS is_active FROM items""")
def applied_requests(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "name", "is_active", "last_updated")
    one = rows.select("id").where("id % 10 = 0")

    def request(base, offset, kind):
        return base.select((F.col("id") + offset).alias("request_id"), F.col("id").alias("item_id"), F.lit(kind).alias("change_type"), F.create_map(F.lit("name"), F.concat(F.lit("new "), (F.col("id") + offset).cast("string")), F.lit("id"), F.lit("9")).alias("proposed"), F.lit("pending").alias("status"))

    requests = request(one, 1_000_000, "update").unionByName(request(one, 2_000_000, "update")).unionByName(request(rows.select("id").where("id % 10 = 1"), 3_000_000, "deactivate"))
    return E.apply_requests(rows, requests, ["name"], now())[0].select("id", "name", "is_active")


@query("SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'approved' END AS status FROM orders")
def rejected_requests(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"))
    return E.reject_requests(r, r.where("request_id % 2 = 0").select("request_id"), "no", now()).select("request_id", "status")


@query(with_(ITEMS) + """SELECT id, CASE WHEN id % 4 = 0 THEN 'desc' ELSE description END AS description, CAST(CASE WHEN id % 4 = 0 AND id % 3 <> 0 THEN least(confidence_score, 49) ELSE confidence_score END AS INT) AS confidence_score, is_active OR id % 4 = 0 AS is_active FROM items""")
def applied_enrichment(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "description", F.when(F.col("id") % 3 == 0, F.array(F.lit("own"))).alias("process_steps"), F.lit(None).cast("boolean").alias("process_steps_inferred"), "confidence_score", "is_active")
    results = rows.where("id % 4 = 0").select("id", F.create_map(F.lit("description"), F.lit("descriptive"), F.lit("phone"), F.lit("1")).alias("fields"), F.array(F.lit("new")).alias("steps"), F.lit(True).alias("inferred"))
    return E.apply_enrichment(rows, results, {"description": 4}).select("id", "description", "confidence_score", "is_active")


@query(with_(ITEMS) + "SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'vector' END, CASE WHEN id % 2 = 0 THEN 'translation' END, CASE WHEN id % 2 = 1 THEN 'cache' END, CASE WHEN id % 2 = 0 THEN 'ai_fields' END) AS stale FROM items")
def stale_artifacts(spark, sf_dir):
    changed = F.when(F.col("id") % 2 == 0, F.array(F.lit("eligibility"))).otherwise(F.array(F.lit("is_active")))
    return items(spark, sf_dir).select("id", F.array_join(E.stale_artifacts(changed), ",").alias("stale"))


@query(with_(ITEMS) + "SELECT id, 'enrichment' AS change_type, 'phone' AS keys FROM items WHERE id % 5 = 0")
def enrichment_history(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "phone", "email")
    batch = rows.where("id % 5 = 0").select("id", F.create_map(F.lit("phone"), F.lit("1"), F.lit("other"), F.lit("x")).alias("fields"))
    return E.enrichment_batch(rows, batch, ["phone", "email"], now())[1].select("id", "change_type", F.array_join("keys", ",").alias("keys"))


@query(with_(ITEMS) + "SELECT id, phone FROM items WHERE is_active AND phone IS NOT NULL AND id % 2 = 0 UNION ALL SELECT id, 'kept' FROM items WHERE NOT (is_active AND phone IS NOT NULL AND id % 2 = 0) AND id % 10 = 0")
def archived_features(spark, sf_dir):
    rows = items(spark, sf_dir)
    archive = rows.where("id % 10 = 0").select("id", F.lit("kept").alias("phone"), F.lit(None).cast("timestamp_ntz").alias("archived_at"))
    return E.archive_features(rows.where("id % 2 = 0"), archive, ["phone"], now()).select("id", "phone")


@query(with_(ITEMS) + "SELECT id, CASE WHEN contains(d, 'brass') THEN 'Metal' WHEN contains(d, 'tin') THEN 'Tin' ELSE 'other' END AS category, concat_ws(',', CASE WHEN contains(d, 'size 1') THEN 'small' END, CASE WHEN contains(d, 'brass') THEN 'b' END) AS tags FROM (SELECT id, lower(description) AS d FROM items)")
def charity_records(spark, sf_dir):
    c = items(spark, sf_dir).select(F.col("id").alias("bn"), "name", F.lit("x").alias("city"), F.col("description").alias("programs"), F.lit(None).cast("string").alias("url"))
    out = E.charity_records(c, [("Metal", ["brass"]), ("Tin", ["tin"])], {"small": ["size 1"], "b": ["brass"]}, F.col("programs"))
    return out.select(F.col("bn").alias("id"), "category", F.array_join("tags", ",").alias("tags"))


@query(with_(ITEMS) + "SELECT id, id % 2 = 0 AS generic FROM items")
def generic_steps(spark, sf_dir):
    steps = F.when(F.col("id") % 2 == 0, F.array(F.lit("Contact the office for details"))).otherwise(F.array(F.lit("Bring two letters")))
    return items(spark, sf_dir).select("id", E.has_generic_steps(steps).alias("generic"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '\\b(low[- ]income|income (limit|test|threshold)|financial need)\\b', 'i') AS income_tested, concat_ws(',', CASE WHEN regexp_matches(text, 'the ', 'i') THEN 'the' END, CASE WHEN regexp_matches(text, ' und ', 'i') THEN 'und' END) AS populations FROM documents")
def eligibility_facts(spark, sf_dir):
    got = PG.extract_eligibility(table(spark, sf_dir, "documents"), [("the", "the "), ("und", " und ")], [], [])
    return got.select("doc_id", "income_tested", F.array_join("populations", ",").alias("populations"))


@query(None)
def intake_facts(spark, sf_dir):
    pages = PG.parse_pages(table(spark, sf_dir, "pages"))
    return PG.extract_intake(pages, [("id", r"\bid\b")]).select("page_id", "walk_in", "needs_referral", F.size("steps").alias("n_steps"))


_LCS = """list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda z: 0), list_transform(string_split(a, ''), lambda c: [ord(c)])),
  lambda r, c: list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda acc, j: list_append(acc, greatest(acc[-1], r[j[1] + 1], r[j[1]] + CASE WHEN ord(b[j[1]]) = c[1] THEN 1 ELSE 0 END))))[-1]"""


@query(with_(TERMS, ITEMS) + f"""SELECT raw_id, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY similarity DESC, item_id) AS k FROM (
  SELECT query_id AS raw_id, item_id, 2.0::DOUBLE * {_LCS} / (length(a) + length(b)) AS similarity FROM (SELECT query_id, lower(trim(text || 's')) AS a FROM terms) CROSS JOIN (SELECT lower(trim(name)) AS b, min(id) AS item_id FROM items WHERE is_active GROUP BY 1))
  WHERE similarity > 0.85) WHERE k = 1""")
def matched_entities(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "name", "is_active", F.lit(None).cast("string").alias("service_id"))
    raw = term_queries(spark, sf_dir).select(F.col("query_id").alias("raw_id"), F.lit(None).cast("string").alias("service_id"), F.concat("text", F.lit("s")).alias("name"))
    return E.match_entities(raw, rows)


@query(with_(LOG) + "SELECT query, CASE WHEN count(*) FILTER (rank <= 10) > 0 THEN 'pass' ELSE 'warning' END AS verdict FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM log) WHERE rank <= 20 GROUP BY 1")
def result_checks(spark, sf_dir):
    results = top(log(spark, sf_dir), ["query"], [F.col("id")], 20).select(F.col("query").alias("query_id"), "rank", F.col("query").alias("name"), F.lit("c").alias("category"))
    cases = results.select("query_id").distinct().select("query_id", F.array("query_id").alias("expected_patterns"), F.array(F.lit("zz")).alias("must_exclude"))
    return V.check_results(cases, results).withColumnRenamed("query_id", "query")



# -- review, provenance, tags ----------------------------------------------------------------------------------------------

_REQUESTS = """requests AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'approved' ELSE 'rejected' END AS status, lower(o_orderpriority) AS source,
  CASE WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'create' END AS change_type, o_orderdate AS created_at FROM orders)"""


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'approved' ELSE 'rejected' END AS status", "lower(o_orderpriority) AS source",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'create' END AS change_type", "o_orderdate AS created_at")


@query(with_(_REQUESTS) + "SELECT id, source FROM requests WHERE status = 'approved' AND change_type = 'update' ORDER BY created_at DESC, id LIMIT 25 OFFSET 25")
def change_requests(spark, sf_dir):
    return FL.list_change_requests(_requests(spark, sf_dir), page=2, status="approved", change_type="update")[0].select("id", "source")


_FEEDBACK = "feedback AS (SELECT event_id AS id, event_type AS kind, CASE WHEN user_id % 4 = 0 THEN 'new' ELSE 'seen' END AS status, ts AS created_at FROM events)"


def _feedback(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS kind", "CASE WHEN user_id % 4 = 0 THEN 'new' ELSE 'seen' END AS status", "ts AS created_at")


@query(with_(_FEEDBACK) + "SELECT id, status FROM feedback WHERE kind = 'click' ORDER BY created_at DESC, id LIMIT 25")
def feedback_listing(spark, sf_dir):
    return FL.list_feedback(_feedback(spark, sf_dir), kind="click")[0].select("id", "status")


@query(with_(_FEEDBACK) + """SELECT count(*) FILTER (kind = 'click') AS total, count(*) FILTER (status = 'new') AS "new" FROM feedback""")
def feedback_counts(spark, sf_dir):
    return FL.list_feedback(_feedback(spark, sf_dir), kind="click")[1]


@query(with_(LOG, ITEMS) + "SELECT log.id, item FROM log JOIN (SELECT id AS i FROM items WHERE is_active) ON i = item")
def kept_active(spark, sf_dir):
    active = FL.active_items(items(spark, sf_dir)).select(F.col("id").alias("item"))
    return J.keep_active(log(spark, sf_dir).select("id", "item"), active, "item")


@query(with_(ITEMS) + """SELECT id, concat_ws('; ', CASE WHEN click_count <> 0 THEN 'clicks ' || CAST(click_count * 2 AS VARCHAR) || ' popular' END, CASE WHEN coalesce(phone, '') = '' THEN 'contact -5 no phone' END) AS why FROM items""")
def score_explanations(spark, sf_dir):
    rows = P.explained(items(spark, sf_dir), "clicks", F.col("click_count") * 2, "popular")
    rows = P.explained(rows, "contact", F.when(F.coalesce("phone", F.lit("")) == "", -5), "no phone")
    return rows.select("id", F.array_join(F.transform("explanations", lambda e: F.concat_ws(" ", e["factor"], e["value"].cast("long").cast("string"), e["reason"])), "; ").alias("why"))


@query(with_(ITEMS) + """SELECT id, concat_ws(',', 'own', CASE WHEN id % 3 = 0 THEN 'women' END, CASE WHEN gender_restriction = 'women' AND id % 3 <> 0 THEN 'women' END, CASE WHEN age_group = 'senior' THEN 'seniors' END) AS tags, coalesce(age_group, 'all') AS age_group FROM items""")
def demographic_tags(spark, sf_dir):
    tags = F.when(F.col("id") % 3 == 0, F.array(F.lit("own"), F.lit("women"))).otherwise(F.array(F.lit("own")))
    tags = E.append_tags(E.append_tags(tags, F.col("gender_restriction") == "women", "women"), F.col("age_group") == "senior", "seniors")
    return items(spark, sf_dir).select("id", F.array_join(tags, ",").alias("tags"), E.fill_default("age_group", "all").alias("age_group"))


@query(with_(ITEMS) + """, lost AS (SELECT id, id - 1 AS keeper, phone, email FROM items WHERE id % 5 = 0 AND id > 1)
SELECT items.id, CASE WHEN coalesce(items.phone, '') = '' AND coalesce(lost.phone, '') <> '' THEN lost.phone ELSE items.phone END AS phone,
  CASE WHEN coalesce(items.email, '') = '' AND coalesce(lost.email, '') <> '' THEN lost.email ELSE items.email END AS email,
  CASE WHEN items.id % 5 = 0 AND items.id > 1 THEN false ELSE is_active END AS is_active FROM items LEFT JOIN lost ON keeper = items.id""")
def merged_into_keeper(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "phone", "email", "is_active")
    pairs = rows.where("id % 5 = 0 AND id > 1").select("id", (F.col("id") - 1).alias("keeper"))
    return E.deactivate_into(rows, pairs, ["phone", "email"])


@query(with_(ITEMS) + """SELECT id, CASE WHEN website_url IS NULL THEN 'name=old,phone=old' ELSE 'email=' || website_url || ',name=old,phone=' || website_url END AS sources, concat_ws(',', 'https://site1.test/a', CASE WHEN website_url <> 'https://site1.test/a' THEN website_url END) AS urls FROM items""")
def provenance(spark, sf_dir):
    old = F.create_map(F.lit("phone"), F.lit("old"), F.lit("name"), F.lit("old"))
    found = F.when(F.col("website_url").isNotNull(), F.create_map(F.lit("phone"), F.col("website_url"), F.lit("email"), F.col("website_url")))
    rows = items(spark, sf_dir).select("id", *E.record_provenance(old, F.array(F.lit("https://site1.test/a")), found, F.col("website_url")))
    entries = F.array_sort(F.transform(F.map_entries("field_sources"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("id", F.array_join(entries, ",").alias("sources"), F.array_join("source_urls", ",").alias("urls"))


@query(with_(ITEMS) + """, t AS (SELECT id, list_distinct(string_split(name, ' ')) AS old, list_distinct(list_concat(string_split(name, ' '), string_split(lower(description), ' '))) AS joint FROM items)
SELECT id, array_to_string(list_sort(joint), ' ') AS tags, len(joint) <> len(old) AS grew FROM t""")
def tag_unions(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", F.split("name", " ").alias("old"), F.split(F.lower("description"), " ").alias("more"))
    rows = rows.withColumn("tags", E.merge_tags("old", "more"))
    return rows.select("id", F.array_join("tags", " ").alias("tags"), E.tags_changed(F.col("old"), F.col("tags")).alias("grew"))
