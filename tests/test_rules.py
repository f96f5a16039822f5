"""Rule tables through required literals give what trying every rule on every text gives."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestar.operators import demographics as D, rules as U

PATTERNS = ["brass|tin", r"\bre", "^x", r"(shel?ter|food)s?\s+bank", r"\d+", "a.*b", "(ab)+c?", "x?", "[ab]c", r"(?:women|girls).*only", "ſ", "K", "strasse", "i", r"\p{L}{3}", "(", "24\\/7|drop-?in", "(?=.*a)b", "m[eé]tis", None]


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p and p not in ("(", r"\p{L}{3}", "(?=.*a)b")])
def test_a_match_holds_a_required_literal(pattern):
    found = U.required_literals(pattern)

    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(re.compile(pattern, re.I)))
    def holds(text):
        assert found is None or any(x in U.folded(text) for x in found)

    holds()


def test_literals_are_the_best_of_a_sequence():
    assert U.required_literals(r"\bfood\s+bank") == {"food"}
    assert U.required_literals("(cat|horse) shed") == {" shed"}
    assert U.required_literals("dog|x?") is None and U.required_literals(r"\d{3}") is None and U.required_literals("(") is None
    assert U.folded("İıſK") == "iisk"


def test_rules_equal_trying_all(spark, rows):
    texts = ["A brass pin", "TIN", "x re", "shelters bank", "SHETER BANK", "12", None, "", "aXb", "Women and girls\nonly", "girls x ONLY", "métis", "ſ", "s", "ı", "straße", "Drop-In", "abcabc", "K", "bc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    valid = [p for p in PATTERNS if p not in ("(",)]
    table = spark.createDataFrame([(k, p, "tin" if k % 2 else None) for k, p in enumerate(valid)], "rule_id int, pattern string, unless string")
    got = U.match_rules(df, "id", {None: F.col("text")}, table, unless="unless")
    flags = lambda c: F.concat(F.lit("(?iu)"), F.col(c))
    every = df.crossJoin(table).where(F.regexp_like("text", flags("pattern")) & ~F.coalesce(F.regexp_like("text", flags("unless")), F.lit(False)))
    assert rows(got, "id", "rule_id") == rows(every, "id", "rule_id") and every.count() > 40


def test_no_nested_loop_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "brass")], "id int, text string")
    table = spark.createDataFrame([(1, "brass")], "rule_id int, pattern string")
    plan = U.match_rules(df, "id", {None: F.col("text")}, table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert U.match_rules(df.limit(0), "id", {None: F.col("text")}, table).count() == 0
    assert U.match_rules(df, "id", {None: F.col("text")}, table.limit(0)).count() == 0


def test_demographics(spark, rows):
    items = spark.createDataFrame([(1, "YWCA women's shelter"), (2, "Shelter for men only"), (3, "Youth and adult drop-in"), (4, "Red Deer college student centre"), (5, "Youth only centre")], "id int, name string")
    pairs = spark.createDataFrame([(q, i, 0.0) for q in (1, 2, 3, 4, 5) for i in range(1, 6)], "query_id int, item_id int, score double")
    attributes = spark.createDataFrame([(1, "gender", "women_only"), (2, "gender", "men_only"), (3, "age", "adult"), (4, "student", "reddeer"), (5, "age", "senior"), (5, "urgency", "immediate")], "query_id int, attribute string, value string")
    # The pattern for men only also finds "men's shelter" inside "women's shelter": as the rules are given.
    got = D.boost_demographics(pairs, attributes, items).where("score <> 0")
    assert rows(got, "query_id", "item_id", "score") == [(1, 1, -7.0), (1, 2, -15.0), (2, 1, -7.0), (2, 2, 8.0), (3, 3, 100.0), (3, 5, -200.0), (4, 4, 100.0), (5, 3, 10.0), (5, 5, -100.0)]
