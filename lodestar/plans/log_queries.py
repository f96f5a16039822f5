"""Queries over the search and click log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.common import shared_folder
from lodestar.operators import analytics as A
from lodestar.plans.tables import ITEMS, LOG, items, log, log_stream, now, query, with_
from lodestar.streaming import jobs

LOCAL = "timezone('America/Edmonton', timezone('UTC', ts))"
VISITOR = f"CAST(CAST({LOCAL} AS DATE) AS VARCHAR) || '|' || left(coalesce(user_agent, ''), 100)"


@query(with_(LOG) + f"""SELECT CAST(CAST({LOCAL} AS DATE) AS VARCHAR) AS day, count(*) AS searches, count(item) AS clicks, count(DISTINCT query) AS unique_queries,
  count(DISTINCT {VISITOR}) AS visitors FROM log GROUP BY 1""")
def daily_trends(spark, sf_dir):
    return A.daily_trends(log(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(with_(LOG) + f"""SELECT count(*) AS searches, count(*) FILTER (item IS NOT NULL) AS clicks, count(DISTINCT query) AS unique_queries,
  count(DISTINCT session) AS sessions, count(DISTINCT {VISITOR}) AS visitors, round(avg(result_count) FILTER (result_count > 0), 1) AS avg_results FROM log""")
def log_overview(spark, sf_dir):
    return A.overview(log(spark, sf_dir))


@query(with_(LOG) + f"SELECT CAST(extract('hour' FROM {LOCAL}) AS BIGINT) AS hour, count(*) AS searches FROM log GROUP BY 1")
def hourly_histogram(spark, sf_dir):
    return A.hourly(log(spark, sf_dir))


@query(with_(LOG) + "SELECT depth, count(*) AS sessions FROM (SELECT session, count(*) AS depth FROM log WHERE session IS NOT NULL GROUP BY 1) GROUP BY 1 ORDER BY 1 LIMIT 10")
def session_depth(spark, sf_dir):
    return A.session_depth(log(spark, sf_dir))


@query(with_(LOG) + "SELECT query, count(*) AS searches, count(item) AS clicks, max(ts) AS last_seen FROM log GROUP BY 1")
def query_stats(spark, sf_dir):
    return A.query_stats(log(spark, sf_dir))


@query(with_(LOG) + "SELECT query, count(*) AS searches FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def popular_searches(spark, sf_dir):
    return A.popular_searches(log(spark, sf_dir))


@query(with_(LOG) + "SELECT query, count(*) AS searches FROM log WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def popular_recent(spark, sf_dir):
    return A.popular_searches(log(spark, sf_dir), 10, 7, now())


@query(with_(LOG, ITEMS) + """SELECT c.item, clicks, last_click, name, category FROM (SELECT item, count(*) AS clicks, max(ts) AS last_click FROM log
  WHERE item IS NOT NULL GROUP BY 1) c LEFT JOIN items ON c.item = items.id""")
def item_clicks(spark, sf_dir):
    return A.item_click_stats(log(spark, sf_dir), items(spark, sf_dir))


@query(with_(LOG, ITEMS) + "SELECT category, count(*) AS clicks FROM log JOIN items ON item = items.id GROUP BY 1")
def category_clicks(spark, sf_dir):
    return A.category_clicks(log(spark, sf_dir), items(spark, sf_dir))


@query(with_(LOG) + "SELECT position, count(*) AS clicks FROM log WHERE item IS NOT NULL AND position IS NOT NULL GROUP BY 1")
def click_positions(spark, sf_dir):
    return A.click_positions(log(spark, sf_dir))


@query(with_(LOG) + "SELECT query, count(*) AS searches, max(result_count) AS most_results FROM log WHERE item IS NULL AND result_count > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def no_click_queries(spark, sf_dir):
    return A.no_click_queries(log(spark, sf_dir))


@query(with_(LOG) + "SELECT query, count(*) AS searches, max(result_count) AS most_results FROM log WHERE item IS NULL AND result_count > 0 AND ts >= TIMESTAMP '2024-01-24' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def volume_no_clicks(spark, sf_dir):
    return A.volume_no_clicks(log(spark, sf_dir), now())


@query(with_(LOG) + """SELECT CASE WHEN coalesce(user_agent, '') = '' THEN 'unknown' WHEN user_agent ILIKE '%mobile%' OR user_agent ILIKE '%iphone%' THEN 'mobile'
  WHEN user_agent ILIKE '%ipad%' OR user_agent ILIKE '%tablet%' THEN 'tablet' ELSE 'desktop' END AS device, count(*) AS searches FROM log GROUP BY 1""")
def device_mix(spark, sf_dir):
    return A.devices(log(spark, sf_dir))


VOTES = "votes AS (SELECT shown AS item, CASE WHEN query LIKE 'purchase%' THEN 'up' ELSE 'down' END AS vote FROM log WHERE query LIKE 'purchase%' OR query LIKE 'error%')"


def _votes(spark, sf_dir):
    return log(spark, sf_dir).where("query LIKE 'purchase%' OR query LIKE 'error%'").selectExpr("shown AS item", "CASE WHEN query LIKE 'purchase%' THEN 'up' ELSE 'down' END AS vote")


@query(with_(LOG, ITEMS, VOTES) + """SELECT item, name, count(*) FILTER (vote = 'up') AS up, count(*) FILTER (vote = 'down') AS down, count(*) AS total
  FROM votes JOIN items ON item = items.id GROUP BY 1, 2 ORDER BY total DESC, item LIMIT 100""")
def vote_summary(spark, sf_dir):
    return A.vote_summary(_votes(spark, sf_dir), items(spark, sf_dir))


@query(with_(LOG, ITEMS, VOTES) + """, s AS (SELECT item, name, count(*) FILTER (vote = 'up') AS up, count(*) FILTER (vote = 'down') AS down, count(*) AS total
  FROM votes JOIN items ON item = items.id GROUP BY 1, 2 ORDER BY total DESC, item LIMIT 100), n AS (SELECT *, up - down AS net FROM s)
  (SELECT *, 'best' AS side FROM n ORDER BY net DESC, item LIMIT 3) UNION ALL (SELECT *, 'worst' AS side FROM n ORDER BY net, item LIMIT 3)""".replace("\n,", ","))
def vote_extremes(spark, sf_dir):
    return A.best_and_worst(A.vote_summary(_votes(spark, sf_dir), items(spark, sf_dir)))


@query(with_(LOG, ITEMS) + """SELECT id, clicks, CAST(10 * clicks + confidence_score + CASE WHEN website_url IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 15 ELSE 0 END AS BIGINT) AS popularity
  FROM items JOIN (SELECT item, count(*) AS clicks FROM log WHERE item IS NOT NULL GROUP BY 1) ON id = item""")
def popularity(spark, sf_dir):
    return A.popularity(items(spark, sf_dir), log(spark, sf_dir), "id", F.col("confidence_score"), F.col("website_url").isNotNull(), F.col("phone").isNotNull())


AFFINITY = """aff AS (
  SELECT query, item, clicks, impressions, last_click, round(CASE WHEN impressions > 1 THEN clicks * 1.0 / impressions * coalesce(exp(-(epoch(TIMESTAMP '2024-01-31') - floor(epoch(last_click))) / 86400.0 / 30.0), 0) ELSE 0 END, 6) AS affinity
  FROM (SELECT coalesce(c.query, i.query) AS query, coalesce(c.item, i.item) AS item, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, last_click
    FROM (SELECT query, item, count(*) AS clicks, max(ts) AS last_click FROM log WHERE item IS NOT NULL GROUP BY 1, 2) c
    FULL JOIN (SELECT query, shown AS item, count(*) AS impressions FROM log GROUP BY 1, 2) i ON c.query = i.query AND c.item = i.item)
)"""


def _affinity(spark, sf_dir):
    rows = log(spark, sf_dir)
    return A.affinity(rows.where("item IS NOT NULL").select("query", "item", "ts"), rows.select("query", F.col("shown").alias("item")), now(), least=1)


@query(with_(LOG, AFFINITY) + "SELECT * FROM aff")
def affinity(spark, sf_dir):
    return _affinity(spark, sf_dir)


@query(with_(LOG, AFFINITY) + "SELECT query, item, affinity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY affinity DESC, item) AS rank FROM aff) WHERE rank <= 50")
def top_affinities(spark, sf_dir):
    return A.top_affinities(_affinity(spark, sf_dir)).select("query", "item", "affinity", "rank")


FAILED = "failed AS (SELECT query, coalesce(location, '') AS location, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM log WHERE result_count = 0 GROUP BY 1, 2)"


@query(with_(LOG, FAILED) + "SELECT * FROM failed")
def failed_queries(spark, sf_dir):
    return A.failed_queries(log(spark, sf_dir))


@query(with_(LOG, FAILED) + "SELECT * FROM failed ORDER BY n DESC, last_seen DESC, query, location LIMIT 20")
def top_failed_queries(spark, sf_dir):
    return A.top_failed_queries(A.failed_queries(log(spark, sf_dir)))


@query(with_(LOG) + "SELECT id, session, ts, coalesce(epoch_us(lead(ts) OVER (PARTITION BY session ORDER BY ts, id)) - epoch_us(ts) <= 30 * 60000000, false) AS reformulated FROM log")
def reformulations(spark, sf_dir):
    return A.reformulations(log(spark, sf_dir), 1800).select("id", "session", "ts", "reformulated")


@query(with_(LOG, FAILED) + "SELECT * FROM failed")
def stored_failed_queries(spark, sf_dir):
    """The stream of events, added batch by batch to a stored table."""
    root = f"{shared_folder(spark)}/failed-{uuid.uuid4().hex}"
    stored = jobs.failed_query_table(f"{root}/table", 16)
    add = jobs.store_failed_queries(stored)
    log_stream(spark, sf_dir).writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    seen = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")]
    return jobs.read_failed_queries(stored, spark).select("query", "location", "n", *seen)


@query(with_(LOG) + """SELECT * FROM (SELECT id, CAST(session AS VARCHAR) AS session, ts, coalesce(epoch_us(lead(ts) OVER (PARTITION BY session ORDER BY ts, id)) - epoch_us(ts) <= 30 * 60000000, false) AS reformulated FROM log)
  WHERE epoch_us(ts) + 30 * 60000000 < (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM log)""")
def streamed_reformulations(spark, sf_dir):
    """The stream of events; what the last watermark has not passed is not judged yet."""
    root = f"{shared_folder(spark)}/reformulated-{uuid.uuid4().hex}"
    before = spark.conf.get(jobs.STORE)
    try:
        judged = jobs.stream_reformulations(log_stream(spark, sf_dir), 1800, "1 hour")
        judged.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    finally:
        spark.conf.set(jobs.STORE, before)
    return spark.read.schema(jobs.REFORMULATED).parquet(f"{root}/rows").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_(LOG) + """, s AS (SELECT id, session, ts, result_count FROM log WHERE item IS NULL), c AS (SELECT session, ts, position FROM log WHERE item IS NOT NULL),
m AS (SELECT c.session, c.ts, c.position, (SELECT arg_max(s.id, (s.ts, s.id)) FROM s WHERE s.session = c.session AND s.ts <= c.ts) AS of_ FROM c),
g AS (SELECT of_, count(*) AS n, arg_min(position, (ts, position)) AS p FROM m WHERE of_ IS NOT NULL GROUP BY 1)
SELECT id, session, CAST(coalesce(n, 0) AS BIGINT) AS click_count, CAST(coalesce(p, 0) AS BIGINT) AS first_click_position FROM s LEFT JOIN g ON id = of_""".replace("\n, s", ", s", 1))
def click_attribution(spark, sf_dir):
    rows = log(spark, sf_dir)
    searches = rows.where("item IS NULL").select("id", "session", "ts", "result_count")
    return A.attribute_clicks(searches, rows.where("item IS NOT NULL").select("session", "ts", "position")).select("id", "session", F.col("click_count").cast("long").alias("click_count"), F.coalesce(F.col("first_click_position").cast("long"), F.lit(0)).alias("first_click_position"))


@query(with_(LOG) + """, m AS (SELECT id, position AS first_click_position, result_count, coalesce(epoch_us(lead(ts) OVER (PARTITION BY session ORDER BY ts, id)) - epoch_us(ts) <= 30 * 60000000, false) AS reformulated FROM log)
SELECT count(*) AS searches, round(avg(first_click_position), 4) AS avg_first_click, round(avg(CASE WHEN reformulated THEN 1.0 ELSE 0 END), 4) AS reformulation_rate,
  round(avg(CASE WHEN result_count = 0 THEN 1.0 ELSE 0 END), 4) AS zero_result_rate FROM m""".replace("\n, m", ", m", 1))
def search_quality(spark, sf_dir):
    return A.search_quality(A.reformulations(log(spark, sf_dir), 1800).withColumn("first_click_position", F.col("position")))


@query(with_(LOG) + "SELECT count(*) AS searches, count(item) AS clicks, count(DISTINCT query) AS unique_queries FROM log WHERE ts >= TIMESTAMP '2024-01-30'")
def volume_report(spark, sf_dir):
    return A.volume_report(log(spark, sf_dir), now())


@query(with_(LOG) + "SELECT count(*) AS lookups, round(avg(CASE WHEN result_count > 2 THEN 1.0 ELSE 0 END), 4) AS hit_rate FROM log")
def cache_hit_rate(spark, sf_dir):
    return A.hit_rate(log(spark, sf_dir).withColumn("cache_hit", F.col("result_count") > 2))


@query(with_(LOG, ITEMS) + f"""SELECT (SELECT count(*) FROM items WHERE is_active) AS active,
  (SELECT round(avg((CASE WHEN coalesce(phone, '') <> '' THEN 1.0 ELSE 0 END + CASE WHEN coalesce(email, '') <> '' THEN 1.0 ELSE 0 END + CASE WHEN coalesce(address, '') <> '' THEN 1.0 ELSE 0 END + CASE WHEN coalesce(location, '') <> '' THEN 1.0 ELSE 0 END) / 4) * 100, 1) FROM items WHERE is_active) AS completeness,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending,
  (SELECT count(*) FROM log WHERE CAST({LOCAL} AS DATE) = DATE '2024-01-30') AS searches_today""")
def dashboard(spark, sf_dir):
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'done' END AS status")
    return A.dashboard(items(spark, sf_dir), requests, log(spark, sf_dir), ["phone", "email", "address", "location"], now())
