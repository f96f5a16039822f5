import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestar.operators import analytics as A
from lodestar.plans.tables import items, log
from lodestar.sources import readers, writers
from lodestar.streaming import jobs


def test_open_data_with_missing_optional_file(spark, tmp_path):
    (tmp_path / "ident.csv").write_text('BN,Legal Name,Address Line 1,City,Province,Postal Code,Category,Sub Category,Designation\nb1,"One, Inc ""X""",a,c,p,z,1,2,A\n')
    (tmp_path / "urls.csv").write_text("BN,Other\nb1,x\n")
    ident, programs, _ = (*readers.read_open_data(spark, str(tmp_path / "ident.csv"), str(tmp_path / "none.csv"), str(tmp_path / "none2.csv")),)
    assert ident.first().name == 'One, Inc "X"' and programs.count() == 0 and programs.columns == ["bn", "description", "line"]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "urls.csv"), readers.URLS)


def test_change_files_and_pages(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps([{"id": 1, "fields": {"phone": "1"}, "reason": "r"}, {"id": 2, "fields": {}}]))
    got = readers.read_change_file(spark, str(tmp_path / "u.json"), "update").orderBy("id").collect()
    assert got[0].fields == {"phone": "1"} and got[1].reason is None
    (tmp_path / "p.jsonl").write_text(json.dumps({"site": "s", "url": "u", "links": [{"href": "/a"}]}) + "\n")
    assert readers.read_pages(spark, str(tmp_path / "p.jsonl")).first().links[0].href == "/a"


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', ["x"]), (2, None, [])], "id int, t string, tags array<string>")
    writers.export_items(df, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert back[0].t == 'a "q", b\nc' and back[0].tags == '["x"]'
    writers.export_items(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        writers.export_items(df, str(tmp_path / "x"), "xml")


def test_table_versions_and_queue(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, k string")
    assert writers.write_table(df, str(tmp_path), "v1", ["k"]).count() == 1
    assert writers.read_table(spark, str(tmp_path), "v1").count() == 1
    for _ in range(2):
        writers.append_requests(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    xml = writers.sitemap_xml(spark.createDataFrame([("u", "d", "daily", "1.0")], "loc string, lastmod string, changefreq string, priority string")).first().value
    assert xml.startswith("<url><loc>u</loc>")


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    """The log as a stream of three files in order of time, and the same rows as a batch."""
    rows = log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    for k, (low, high) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01"))):
        rows.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{path}/b={k}")
    import pathlib
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(3):
        for p in pathlib.Path(f"{path}/b={k}").glob("*.parquet"):
            shutil.copy(p, flat / f"{k}.parquet")
        # A source takes files by their times, which copies within one millisecond would share.
        os.utime(flat / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return jobs.read_events(spark, str(flat), rows.schema), rows


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_failed_queries_stream_equals_batch(spark, stream, rows):
    s, b = stream
    got = run(spark, jobs.stream_failed_queries(s), "complete", "failed")
    cols = ("query", "location", "n", "first_seen", "last_seen")
    assert rows(got, *cols) == rows(A.failed_queries(b), *cols)


def test_trends_and_clicks_equal_batch(spark, stream, rows):
    s, b = stream
    got = run(spark, jobs.stream_trends(s), "complete", "trends").groupBy("day").agg(F.sum("searches").alias("searches"), F.sum("clicks").alias("clicks"))
    assert rows(got, "day", "searches", "clicks") == rows(A.daily_trends(b), "day", "searches", "clicks")
    got = run(spark, jobs.stream_click_counts(s), "complete", "clicks").groupBy("item").agg(F.sum("clicks").alias("clicks"), F.max("last_click").alias("last"))
    want = b.where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("clicks"), F.max("ts").alias("last"))
    assert rows(got, "item", "clicks", "last") == rows(want, "item", "clicks", "last")


def test_affinity_stream_equals_batch(spark, stream, rows):
    s, b = stream
    now = F.lit(dt.datetime(2024, 1, 31))
    got = jobs.affinity_at(run(spark, jobs.stream_affinity(s), "complete", "aff"), now, 1)
    want = A.affinity(b.where("item IS NOT NULL").select("query", "item", "ts"), b.select("query", F.col("shown").alias("item")), now, 1)
    assert rows(got, "query", "item", "affinity") == rows(want, "query", "item", "affinity")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_attribution_stream_equals_batch(spark, stream, rows, tmp_path, order):
    s, b = stream
    # A last event of another session, long after the others, lets the watermark pass them.
    last = b.limit(1).withColumn("ts", F.lit(dt.datetime(2026, 1, 1)).cast("timestamp")).withColumn("session", F.lit(-1).cast(b.schema["session"].dataType)).withColumn("item", F.lit(None).cast(b.schema["item"].dataType))
    last.coalesce(1).write.parquet(str(tmp_path / "last"))
    shutil.copy(next((tmp_path / "last").glob("*.parquet")), tmp_path / "flat" / "3.parquet")
    for place, k in enumerate((*order, 3)):
        os.utime(tmp_path / "flat" / f"{k}.parquet", (1_700_000_000 + 10 * place,) * 2)
    seen = run(spark, jobs.stream_attribution(s, "40 days"), "update", "attributed" + "".join(map(str, order)))
    got = seen.groupBy("id").agg(F.max("click_count").alias("n"), F.max_by("first_click_position", "click_count").alias("p"))
    searches = b.where("item IS NULL").select("id", "session", "ts")
    want = A.attribute_clicks(searches, b.where("item IS NOT NULL").select("session", "ts", "position")).where("click_count > 0")
    assert rows(got, "id", "n", "p") == rows(want, "id", F.col("click_count"), "first_click_position")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_reformulation_stream_equals_batch(spark, stream, rows, tmp_path, order):
    s, b = stream
    last = b.limit(1).withColumn("ts", F.lit(dt.datetime(2026, 1, 1)).cast("timestamp")).withColumn("session", F.lit(-1).cast(b.schema["session"].dataType))
    last.coalesce(1).write.parquet(str(tmp_path / "last"))
    shutil.copy(next((tmp_path / "last").glob("*.parquet")), tmp_path / "flat" / "3.parquet")
    for place, k in enumerate((*order, 3)):
        os.utime(tmp_path / "flat" / f"{k}.parquet", (1_700_000_000 + 10 * place,) * 2)
    # Some events lose their session; these are never reformulated.
    s, b = (x.withColumn("session", F.when(F.col("id") % 9 != 4, F.col("session"))) for x in (s, b))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        seen = run(spark, jobs.stream_reformulations(s, 1800, "40 days"), "append", "reformulated" + "".join(map(str, order)))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    got = seen.where("coalesce(session, '') <> '-1'")
    want = A.reformulations(b, 1800).withColumn("session", F.col("session").cast("string"))
    cols = ("id", "session", F.unix_micros(F.col("ts").cast("timestamp")), "reformulated")
    assert want.where("reformulated").count() and rows(got, *cols) == rows(want, *cols)


def test_reformulation_state_grows_with_buckets_not_with_sessions(spark, rows, tmp_path):
    # 600 sessions search at 0, 10 and 100 s; half of them have a search again within 20 s. A last event passes them all.
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    base = spark.range(600).select(F.col("id").alias("session"), F.explode(F.array(F.lit(0), F.when(F.col("id") % 2 == 0, 10).otherwise(50), F.lit(100))).alias("at"))
    b = base.select((F.col("session") * 1000 + F.col("at")).alias("id"), "session", F.timestamp_seconds(F.unix_seconds(start) + F.col("at")).alias("ts"))
    b.coalesce(1).write.parquet(str(tmp_path / "all"))
    spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("session"), F.lit(dt.datetime(2025, 1, 1)).cast("timestamp").alias("ts")).write.mode("append").parquet(str(tmp_path / "all"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        judged = jobs.stream_reformulations(spark.readStream.schema(b.schema).parquet(str(tmp_path / "all")), 20, "1 hour", buckets=5)
        q = judged.writeStream.format("memory").queryName("bucketed").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    held = max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < held <= 30
    want = A.reformulations(b, 20).withColumn("session", F.col("session").cast("string"))
    assert want.where("reformulated").count() == 300
    cols = ("id", "session", F.unix_micros("ts"), "reformulated")
    assert rows(spark.table("bucketed"), *cols) == rows(want, *cols)


def test_stored_failed_queries_survive_replays(spark, stream, rows, tmp_path):
    s, b = stream
    table = jobs.failed_query_table(str(tmp_path / "failed"), 8)
    add, batches = jobs.store_failed_queries(table), {}

    def write(df, batch_id):
        batches[batch_id] = df.collect()
        add(df, batch_id)
        add(df, batch_id)

    q = s.writeStream.foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ("query", "location", "n", "first_seen", "last_seen")
    assert len(batches) == 3
    assert rows(jobs.read_failed_queries(table, spark), *cols) == rows(A.failed_queries(b), *cols)
    # A restart that sends the last batches again changes nothing.
    for i in (1, 2):
        add(spark.createDataFrame(batches[i], s.schema), i)
    assert rows(jobs.read_failed_queries(table, spark), *cols) == rows(A.failed_queries(b), *cols)


def test_stored_failed_queries_expire(spark, tmp_path):
    schema = "ts timestamp, query string, location string, result_count long"
    table = jobs.failed_query_table(str(tmp_path / "old"), 1)
    add = jobs.store_failed_queries(table, 30)
    add(spark.createDataFrame([(dt.datetime(2024, 1, 1), "a", None, 0), (dt.datetime(2024, 1, 1), "ok", None, 3)], schema), 0)
    add(spark.createDataFrame([(dt.datetime(2024, 3, 1), "b", "x", 0)], schema), 1)
    add(spark.createDataFrame([], schema), 2)
    assert [(r["query"], r.location, r.n) for r in jobs.read_failed_queries(table, spark).collect()] == [("b", "x", 1)]


def test_duplicates_and_sessions(spark, stream):
    s, b = stream
    assert run(spark, jobs.dedupe_events(s.unionByName(s)), "append", "unique").count() == b.count()
    sessions = run(spark, jobs.stream_sessions(s), "complete", "sessions")
    assert sessions.agg(F.sum("depth")).first()[0] == b.count()


def test_foreach_batch_skips_empty(spark):
    seen = []
    f = jobs.upsert_batches(lambda df, i: seen.append(i))
    f(spark.range(0), 1)
    f(spark.range(1), 2)
    assert seen == [2]


def test_view_rows(spark, sf_dir):
    v = writers.build_search_view(items(spark, sf_dir), ["id"])
    assert v.where("search_text <> lower(search_text)").count() == 0
