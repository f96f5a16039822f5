import datetime as dt

from pyspark.sql import functions as F

from lodestar.common import upsert
from lodestar.functions.text import slug
from lodestar.operators import filters as FL, joins as J, projections as P


def now():
    return F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")


def test_derived_filters_do_not_override(spark, rows):
    q = spark.createDataFrame([(1, "single mother", None, None), (2, "teen", "men", None), (3, None, None, None)], "query_id int, demographic string, gender string, age string")
    assert rows(FL.derive_filters(q), "query_id", "gender", "age") == [(1, "women", None), (2, "men", "youth"), (3, None, None)]


def test_conditional_exclusion_and_age(spark, rows):
    df = spark.createDataFrame([(1, "faith", None, 0.0, "x church"), (2, "food", "faith", 0.6, "church"), (3, "food", "faith", 0.4, "church")], "id int, primary string, secondary string, secondary_confidence double, t string")
    got = FL.exclude_by_pattern_when(df, FL.intent_is("faith"), F.col("t"), "church")
    assert rows(got, "id") == [(3,)]
    ages = spark.createDataFrame([(1, "youth", 0.9, "senior"), (2, "youth", 0.9, None), (3, "youth", 0.5, "senior"), (4, "youth", 0.9, "youth_and_adult")], "id int, query_age string, age_confidence double, age_group string")
    assert rows(FL.apply_age_filter(ages), "id") == [(2,), (3,), (4,)]


def test_enrichment_candidates_and_need(spark, rows):
    df = spark.createDataFrame([(1, None, None), (2, dt.datetime(2023, 1, 1), ["a"]), (3, dt.datetime(2024, 1, 1), ["a"])], "id int, enrichment_date timestamp_ntz, process_steps array<string>")
    assert rows(df.where(FL.needs_enrichment(now())), "id") == [(1,), (2,)]
    got = FL.enrichment_candidates(df, 2, [F.col("id") == 3, F.col("id") < 3])
    assert [(r.id, r.priority) for r in got.collect()] == [(3, 1), (1, 2)]


def test_relevance_needs_override_after_veto(spark, rows):
    df = spark.createDataFrame([(1, "food bank", "A"), (2, "worship only church food bank", "A"), (3, "worship only with shelter food bank", "A"), (4, "youth", "B"), (5, "youth", "A"), (6, None, None)], "id int, t string, c string")
    got = df.where(FL.is_relevant(F.col("t"), F.col("c"), ["food bank"], ["youth", "family"], ["A"], "worship only", "shelter"))
    assert rows(got, "id") == [(1,), (3,), (5,)]


def test_small_filters(spark, rows):
    df = spark.createDataFrame([(1, "Org — A", "open 24 hours", False, None, "http://a", None), (2, "org — B", "", True, [1.0], None, None), (3, "x", None, None, None, "http://b", ["u"])], "id int, name string, t string, is_24_7 boolean, embedding array<double>, website_url string, source_urls array<string>").withColumn("is_active", F.lit(True)).withColumn("confidence_score", F.lit(1))
    assert rows(FL.always_open_candidates(df, F.col("t")), "id") == [(1,)]
    assert rows(FL.org_prefix(df, "ORG"), "id") == [(1,), (2,)]
    assert rows(FL.embedding_worklist(df), "id") == [(1,), (3,)]
    assert rows(FL.embedding_worklist(df, "ids", [2]), "id") == [(2,)]
    reach = spark.createDataFrame([("http://a", True)], "url string, reachable boolean")
    assert rows(FL.backfill_sources(df, reach), "id", "outcome") == [(1, "set"), (2, "no-source")]


def test_supplement_and_region_wide(spark, rows):
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id int, item_id int")
    extra = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "query_id int, item_id int")
    assert rows(J.supplement(base, extra, ["query_id", "item_id"], 2), "query_id", "item_id") == [(1, 1), (1, 2), (2, 1), (2, 9)]
    df = spark.createDataFrame([(1, 1, "Help Line", True), (1, 2, "Help Line Calgary", False), (1, 3, "Other", True), (2, 4, "Help Line", True), (1, 5, "He", True)], "query_id int, id int, name string, wide boolean")
    got = J.suppress_region_wide(df, F.col("wide"), F.col("name"))
    assert rows(got, "query_id", "id") == [(1, 2), (1, 3), (1, 5), (2, 4)]


def test_charities(spark, rows):
    ident = spark.createDataFrame([("b1", "One"), ("b2", "Two")], "bn string, name string")
    programs = spark.createDataFrame([("b1", "second", 2), ("b1", " first ", 1), ("b1", "", 0)], "bn string, description string, line long")
    urls = spark.createDataFrame([("b1", "a.org", 1), ("b1", "https://b.org", 2)], "bn string, url string, line long")
    assert rows(J.build_charities(ident, programs, urls), "bn", "programs", "url") == [("b1", "first second", "https://b.org"), ("b2", None, None)]


def test_siblings_warnings_known_duplicates(spark, rows):
    ranked = spark.createDataFrame([(1, 10, "Org — A", 100.0, 0.9), (1, 11, "Z", 20.0, 0.1), (2, 10, "Org — A", 100.0, 0.9), (2, 11, "Z", 90.0, 0.1)], "query_id int, item_id int, name string, score double, similarity double")
    items = spark.createDataFrame([(10, "Org — A", "780-555-0000", True), (12, "ORG — B", "1", True), (13, "Other — C", None, False)], "id int, name string, phone string, is_active boolean")
    assert rows(J.insert_org_siblings(ranked, items), "query_id", "item_id") == [(1, 12)]
    req = spark.createDataFrame([(1, "other", "(780) 555-0000"), (2, "Org", None)], "request_id int, name string, phone string")
    assert rows(J.create_warnings(req, items), "request_id", "item_id", "reason") == [(1, 10, "phone"), (1, 13, "name"), (2, 10, "name"), (2, 12, "name")]
    known = spark.createDataFrame([(10, 12), (10, 13)], "kept int, removed int")
    assert rows(J.apply_known_duplicates(items, known), "kept", "removed") == [(10, 12)]


def test_lookups(spark, rows):
    items = spark.createDataFrame([(1, "a", 51.0, -114.0), (2, "b", None, None)], "id int, name string, latitude double, longitude double")
    hist = spark.createDataFrame([(1, 1, 5), (2, 9, 6), (3, 2, 4)], "history_id int, item_id int, changed_at int")
    assert rows(J.recent_activity(hist, items, 2), "history_id", "name") == [(1, "a"), (2, None)]
    pts = spark.createDataFrame([(7, 51.0, -114.0)], "query_id int, lat double, lng double")
    got = J.attach_distance(items.withColumn("query_id", F.lit(7)), pts)
    assert rows(got, "id", "distance_km") == [(1, 0.0), (2, None)]
    tr = spark.createDataFrame([(1, "fr", "A!")], "item_id int, language string, name string")
    out, flag = J.localise(items, tr, "fr", ["name"])
    assert rows(out, "id", "name", "translated") == [(1, "A!", True), (2, "b", False)]
    assert flag.first().mostly_missing is False
    new = spark.createDataFrame([(1, "A"), (2, "New"), (3, "new"), (4, "Fresh")], "id int, name string")
    ins, skipped = J.insert_absent(new, items.select("id", "name"), slug("name"))
    assert rows(ins, "id") == [(2,), (4,)] and rows(skipped, "id") == [(1,), (3,)]
    assert rows(J.attach(items.select("id"), items, "id", ["name"]), "id", "name") == [(1, "a"), (2, "b")]


def test_duplicate_candidates_by_contact(spark, rows):
    df = spark.createDataFrame([(1, "780-555-0000", "a@b.c", "", "A B C D"), (2, "(780) 555 0000", "A@b.c ", "x", "a b c e"), (3, None, None, None, "a b c f"), (4, None, "", "", "z")], "id int, phone string, email string, address string, name string")
    got = J.duplicate_candidates(df, J.contact_rules())
    assert rows(got, "a", "b", "rule") == [(1, 2, "phone"), (1, 3, "name"), (2, 3, "name")]


def test_upsert_inserts_updates_and_keeps(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, n int")
    delta = spark.createDataFrame([(2, "B", 5), (3, "c", 7), (None, "N", 1)], "k int, v string, n int")
    got = upsert(base, delta, ["k"], {"n": F.coalesce(F.col("b.n"), F.lit(0)) + F.col("d.n")})
    assert rows(got, "k", "v", "n") == [(1, "a", 1), (2, "B", 7), (3, "c", 7), (None, "N", 1)]


def test_projections(spark, rows):
    df = spark.createDataFrame([(1, "", "x", 51.04449, -114.0, 0.5)], "id int, phone string, email string, latitude double, longitude double, distance_km double")
    got = df.select(P.enrichment_updates({"phone": F.col("phone"), "email": F.col("email")}, {"phone": F.lit("1"), "email": F.lit("2")}).alias("u")).first().u
    assert got == {"phone": "1"}
    assert P.card(df, ["id"]).first().asDict() == {"id": 1, "latitude": 51.044, "longitude": -114.0, "distance_text": "500 m"}
    text = df.select(P.summary_text(F.lit(1), F.lit("q"), F.lit(None).cast("string")), P.summary_text(F.lit(3), F.lit("q"), F.lit("Here"))).first()
    assert tuple(text) == ('1 result for "q"', '3 results for "q" in Here')
    e = P.explained(P.explained(df, "a", F.lit(2), "r"), "b", F.lit(0), "r").first().explanations
    assert [tuple(x) for x in e] == [("a", 2.0, "r")]


def test_pairs_of_candidates_and_warnings_are_not_gathered(spark, rows):
    df = spark.createDataFrame([(1, "x", "k"), (2, "x", "k"), (3, "y", "k"), (4, None, "k"), (5, " ", None)], "id int, v string, w string")
    got = J.duplicate_candidates(df, [("v", F.col("v")), ("w", F.col("w"))])
    assert rows(got, "a", "b", "rule") == [(1, 2, "v"), (1, 3, "w"), (1, 4, "w"), (2, 3, "w"), (2, 4, "w"), (3, 4, "w")]
    items = spark.createDataFrame([(k, ["Blue ring", "blue", None][k % 3], "1" if k < 3 else None) for k in range(6)], "id int, name string, phone string")
    asked = spark.createDataFrame([(1, "BLUE ring ", "1"), (2, None, None)], "request_id int, name string, phone string")
    warned = J.create_warnings(asked, items)
    assert rows(warned, "request_id", "item_id", "reason") == [(1, 0, "phone"), (1, 1, "phone"), (1, 2, "phone"), (1, 3, "name"), (1, 4, "name")]
    for df in (got, warned):
        assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_copies_of_one_name_pair_up_in_many_tasks(spark):
    # 1200 rows of one name, 300 of one like it, one far from both, and a row without an id.
    names = F.when(F.col("id") < 1200, " Red bolt").when(F.col("id") < 1500, "red bolts").otherwise("zebra")
    df = spark.range(1501).select("id", names.alias("name")).unionByName(spark.createDataFrame([(None, "RED BOLTS")], "id long, name string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.similar_pairs(df, "name", 0.6)
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        seen = got.groupBy("similarity").agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("d"), F.count_if(F.col("a") > F.col("b")).alias("wrong")).orderBy("similarity").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Without an id a row still meets other names, as in SQL, but no copy of its own.
    assert [(r.n, r.d, r.wrong) for r in seen] == [(1200 * 301, 1200 * 301, 0), (1200 * 1199 // 2 + 300 * 299 // 2,) * 2 + (0,)]
    assert max(shares) < 0.6 * sum(shares)


def test_warnings_of_one_name_or_phone_come_from_many_tasks(spark):
    # 1000 items and 40 requests of one name, a third of them of one phone; a request and an item without a name or phone.
    phone = F.when(F.col("id") % 3 == 0, "780 555 0000").otherwise(F.concat(F.lit("9"), F.col("id").cast("string")))
    items = spark.range(1000).select("id", F.lit("Red bolt").alias("name"), phone.alias("phone")).unionByName(spark.createDataFrame([(1000, None, None)], "id long, name string, phone string"))
    asked = spark.range(40).select(F.col("id").alias("request_id"), F.lit(" RED bolt north").alias("name"), F.when(F.col("id") % 3 == 0, "7805550000").alias("phone")).unionByName(spark.createDataFrame([(40, None, None)], "request_id long, name string, phone string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.create_warnings(asked, items)
        shares = {kind: [r["count"] for r in got.where(F.col("reason") == kind).groupBy(F.spark_partition_id()).count().collect()] for kind in ("phone", "name")}
        seen = {r.reason: (r.n, r.d) for r in got.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("request_id", "item_id").alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen == {"phone": (14 * 334,) * 2, "name": (40 * 1000 - 14 * 334,) * 2}
    assert all(max(n) < 0.8 * sum(n) for n in shares.values())


def test_a_name_of_many_copies_is_cut_into_few_pieces(spark, monkeypatch):
    copies = spark.range(20_000).select(F.lit("red bolt").alias("_v"), F.col("id").alias("_k"))
    assert J._pieces(copies, "_v", "_k", "x").count() == J.PIECES  # each is shuffled with each other, so more would grow with the square
    monkeypatch.setattr(J, "MOST_ROWS", 400)
    assert J._pieces(copies, "_v", "_k", "x").count() == 50
    got = J.similar_pairs(spark.range(2_000).select("id", F.lit("red bolt").alias("name")), "name", 0.6)
    assert tuple(got.agg(F.count("*"), F.count_distinct("a", "b"), F.count_if(F.col("a") >= F.col("b"))).first()) == (2_000 * 1_999 // 2,) * 2 + (0,)
