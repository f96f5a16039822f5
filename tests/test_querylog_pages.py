from pyspark.sql import functions as F

from lodestar.operators import pages as P, querylog as Q


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, text string")


def test_corrections(spark, rows):
    t = Q.tokens(queries(spark, "helth shleter xyzzy the", "houseing"))
    vocab = spark.createDataFrame([("health",), ("shelter",), ("housing",)], "word string")
    fix = spark.createDataFrame([("xyzzy", "magic")], "wrong string, right string")
    got = rows(Q.correct_typos(t, fix, vocab, ["the"]), "token", "corrected")
    assert ("shleter", "shelter") in got and ("xyzzy", "magic") in got and ("the", "the") in got and ("houseing", "housing") in got
    p = Q.correct_phonetic(spark.createDataFrame([(1, "fone"), (1, "xx")], "query_id int, token string"), fix, spark.createDataFrame([("phone",)], "word string"))
    assert rows(p, "token", "corrected") == [("fone", "phone"), ("xx", "xx")]


def test_negatives_critical_alias(spark, rows):
    q = queries(spark, "food not church without a referral gluten-free", "i want to die", "book about suicide", "ymca pool")
    assert q.select(Q.negative_terms("text", ["referral"])).first()[0] == ["church", "gluten"]
    got = Q.flag_critical(q, r"\bsuicide\b", r"want to die", r"\bmy friend\b", r"\bbook\b", r"\bi\b")
    assert [r[0] for r in rows(got.where("critical"), "query_id")] == [2]
    aliases = spark.createDataFrame([("ymca", 7), ("ymca pool", 8)], "alias string, item_id int")
    assert rows(Q.match_alias(q, aliases).where("alias_item IS NOT NULL"), "query_id", "alias_item") == [(4, 7)]


def test_labels_context_topics(spark, rows):
    q = queries(spark, "my son needs a doctor tonight", "student housing")
    got = Q.detect(q)
    assert rows(got, "query_id", "urgency", "student", "family") == [(1, "now", None, "relative"), (2, None, "student", None)]
    c = Q.query_context(q.withColumn("labels", F.array(F.lit("health"))), {"health": ["clinic"], "x": ["y"]})
    assert rows(c, "query_id", "searcher", "target") == [(1, "relative", "son"), (2, "self", "self")] and c.first().needs == ["clinic"]
    labels = spark.createDataFrame([(1, "health"), (2, "home")], "query_id int, label string")
    subs = spark.createDataFrame([("health", "doctor", "doctor"), ("home", "doctor", "doctor")], "parent string, sub_label string, pattern string")
    assert rows(Q.sub_labels(q, labels, subs), "query_id", "sub_labels") == [(1, ["doctor"])]
    assert rows(Q.topic_flags(q, {"minor": r"\bson\b"}), "query_id", "minor") == [(1, True), (2, False)]
    key = q.select(Q.cache_key(F.lit("h"), F.lit("m"), F.col("text"), F.lit("Here"))).first()[0]
    assert key == "h:m:my son needs a doctor tonight:here"
    assert q.select(Q.org_of(F.lit("YMCA of Calgary"), [("ymca", "ymca")])).first()[0] == "ymca"


def test_merge_labels(spark, rows):
    p = spark.createDataFrame([(1, "food", 0.4, None, None, ["a"], False), (2, "crisis", 0.4, None, None, None, False), (3, "food", 0.4, "home", 0.5, None, False)], "query_id int, primary string, primary_confidence double, secondary string, secondary_confidence double, sub_labels array<string>, first_person boolean")
    e = spark.createDataFrame([(1, "home", 1.7, ["b"]), (1, "bad", 0.9, []), (2, "food", 0.55, []), (3, "crisis", 0.9, []), (3, "food", 0.6, [])], "query_id int, label string, confidence double, sub_labels array<string>")
    got = rows(Q.merge_labels(p, e, ["food", "home", "crisis"], "crisis"), "query_id", "primary", "primary_confidence", "secondary", "sub_labels")
    assert got == [(1, "home", 1.0, None, ["a", "b"]), (2, "crisis", 0.4, None, []), (3, "food", 0.4, "food", [])]


HTML = """<html><head><title>Intake</title><script>x()</script></head><body><nav><a href="/home">Home</a></nav>
<h1>How to apply</h1><p>Call 780-555-1234. Self-referral, no appointment needed. For women only, ages 18 to 65, residents of Alberta.</p>
<ol><li>Fill the form</li><li>Wait <b>here</b></li></ol><a href="apply?x=1#f">Apply now</a><a href="http://else.test/">Else</a></body></html>"""


def test_page_parsing(spark):
    df = P.parse_pages(spark.createDataFrame([(1, "http://a.test/in/x", HTML), (2, "http://a.test", None)], "page_id int, url string, html string"))
    r = df.orderBy("page_id").collect()
    assert r[0].title == "Intake" and r[0].headings == ["How to apply"] and r[0].ol_items == ["Fill the form", "Wait here"]
    assert "Home" not in r[0].text and "x()" not in r[0].text and r[1].text == ""
    links = P.prioritise_links(df, [("apply", 1.0), ("home", 0.4)], [])
    assert [(x.link, x.priority) for x in links.orderBy("rank").collect()] == [("http://a.test/in/apply", 1.0), ("http://a.test/home", 0.5)]
    e = P.extract_eligibility(df, [("newcomers", "newcomer")], [("no pets", "no pets")], ["french"]).orderBy("page_id").first()
    assert (e.age_min, e.age_max, e.gender, e.residency) == (18, 65, "women", "Alberta")
    i = P.extract_intake(df, [("id", "photo id")]).orderBy("page_id").first()
    assert i.phones == ["780-555-1234"] and not i.needs_referral and i.steps == ["Fill the form", "Wait here"]


def test_steps_from_sentences(spark):
    df = spark.createDataFrame([("Step 1: Call the office. Step 2: Bring your papers.", [])], "text string, ol_items array<string>")
    assert P.extract_intake(df, []).first().steps == ["Call the office", "Bring your papers"]


def test_listings_need_a_name(spark, rows):
    html = '<div class="x"><h3>One</h3><p>in Calgary</p></div><div class="x"><h3></h3></div>'
    got = P.extract_listings(spark.createDataFrame([(1, html)], "page_id int, html string"), {"block": r'<div class="x">(.*?)</div>', "name": "<h3>(.*?)</h3>", "description": "<p>(.*?)</p>"}, ["Calgary"], "Alberta")
    assert rows(got, "page_id", "name", "description", "location") == [(1, "One", "in Calgary", "Calgary")]


def test_lines_keep_digits_at_their_ends(spark):
    line = " 0123 Main Street " + "has rooms and meals for everyone who asks " * 2
    got = spark.createDataFrame([("\n".join([line] * 3),)], "text string").select(P.description_lines("text")).first()[0]
    assert got == [line.strip(" ")] * 3
    said = spark.createDataFrame([(1, "First, call 555 1230. Then bring form 10. Next go to room 21.", [])], "page_id int, text string, ol array<string>")
    steps = P.extract_intake(said, [], ol_items="ol").first()["steps"]
    assert [s.split()[-1] for s in steps] == ["1230", "10", "21"]


def test_words_end_at_letters_that_are_not_ascii(spark, rows):
    q = queries(spark, "éthe", "theé", "thé the", "other", "lathe")
    assert rows(q.select("query_id", Q.first_label("text", [("english", r"\bthe\b")]).alias("x")), "query_id", "x") == [(1, "english"), (2, "english"), (3, "english"), (4, None), (5, None)]
    patterns = spark.createDataFrame([("a", "the", r"\bthe\b", 1.0, None), ("a", "slash", r"x\\b", 1.0, None)], "label string, sub_label string, pattern string, points double, requires string")
    assert rows(Q.score_labels(q, patterns), "query_id") == [(1,), (2,), (3,)]
    labels = q.select("query_id", F.lit("a").alias("label"))
    assert rows(Q.sub_labels(q, labels, patterns.withColumnRenamed("label", "parent")), "query_id") == [(1,), (2,), (3,)]


def test_negatives_beside_other_letters(spark, rows):
    assert rows(queries(spark, "énot pets", "cannot wait").select("query_id", Q.negative_terms("text").alias("n")), "query_id", "n") == [(1, ["pets"]), (2, [])]
