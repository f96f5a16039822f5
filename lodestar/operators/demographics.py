"""Boosts by who asks: gender, age, urgency, family, community, studies, language. A rule table and one join of gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.operators.ranking import boost_by_rules

_WOMEN = r"women|woman|female|mother|girl|domestic violence|yw\s|ywca"
_MEN_ONLY = r"men'?s.*shelter|men only|males only|for men\b"
_WOMEN_ONLY = r"women'?s.*shelter|women only|females only|for women\b"
_YOUTH = r"youth|teen|adolescent|young|under 25|child|kids?|juvenile|minor|school"
_SENIOR = r"senior|elderly|aging|aged|older adult|65\+|retirement|dementia|alzheimer"
_ADULT = r"\badult\b"
_ONLY = r"only|exclusive"
_STUDENT = r"student|university|campus|college|wellness.*centre|counsell?ing.*centre|student.*services"
_MANY_LANGUAGES = r"\b(interpreter|multilingual|translation|multiple languages)\b"

# Fixed values: (attribute, value, pattern, pattern that must not fit, points, only the first of these counts).
RULES: list[tuple[str, str, str, str | None, float, str | None]] = [
    ("gender", "women_only", _WOMEN, None, 8.0, None),
    ("gender", "women_only", _MEN_ONLY, None, -15.0, None),
    ("gender", "men_only", r"\bmen\b|male|father|\bmen'?s\b", _WOMEN, 8.0, "men"),
    ("gender", "men_only", _MEN_ONLY, None, 8.0, "men"),
    ("gender", "men_only", _WOMEN_ONLY, None, -15.0, None),
    ("age", "youth", _YOUTH, None, 50.0, None),
    ("age", "youth", _SENIOR, None, -100.0, None),
    ("age", "youth", _ADULT, _YOUTH, -50.0, None),
    ("age", "adult", _YOUTH, _ADULT, -200.0, None),
    ("age", "adult", _ADULT, None, 100.0, None),
    ("age", "adult", _SENIOR, None, -50.0, None),
    ("age", "senior", _SENIOR, None, 50.0, None),
    ("age", "senior", f"({_YOUTH}).*({_ONLY})|({_ONLY}).*({_YOUTH})", None, -100.0, None),
    ("urgency", "immediate", r"24\/7|24 hour|walk-?in|emergency|crisis|immediate|no appointment|same day|drop-?in|open now", None, 10.0, None),
    ("urgency", "immediate", r"appointment required|waitlist|intake process|wait time|waiting list", None, -3.0, None),
    ("waiting", "none", r"walk-?in|no appointment|same day|drop-?in|immediate access|no wait|open now|24\/7|24 hour", None, 100.0, None),
    ("waiting", "none", r"waitlist|waiting list|wait time|intake process|referral required", None, -15.0, None),
    ("family", "single_parent", r"single parent|single mom|single dad|sole parent|family|child|parenting", None, 6.0, None),
    ("family", "family_legal", r"legal|court|mediation|family services|custody|divorce|lawyer|law", None, 8.0, None),
    ("family", "pregnancy", r"prenatal|maternity|infant|baby|parenting|newborn|pregnancy|pregnant|postpartum|maternal", None, 8.0, None),
    ("family", "family_general", r"family|families|parent|child|kids", None, 4.0, None),
    ("community", "indigenous", r"indigenous|first nations?|aboriginal|native|metis|m[eé]tis|inuit|fnmi", None, 10.0, None),
    ("community", "newcomer", r"immigrant|refugee|newcomer|settlement|new canadian|esl|language|citizenship", None, 10.0, None),
    ("community", "lgbtq", r"lgbtq|lgbt|pride|queer|trans|gay|lesbian|2slgbtq|two-spirit|non-?binary", None, 10.0, None),
    ("community", "veteran", r"veteran|military|armed forces|canadian forces|vac\b|legion", None, 10.0, None),
    ("student", "ucalgary", r"\b(ucalgary|u of c|uofc|ucrc|university of calgary|uc wellness|uc counselling)\b", None, 100.0, "student"),
    ("student", "ualberta", r"\b(ualberta|u of a|uofa|university of alberta|ua wellness|ua counselling)\b", None, 100.0, "student"),
    ("student", "mru", r"\b(mount royal|mru)\b", None, 100.0, "student"),
    ("student", "ulethbridge", r"\b(lethbridge|uleth|u of l)\b", None, 100.0, "student"),
    ("student", "macewan", r"\b(macewan)\b", None, 100.0, "student"),
    ("student", "athabasca", r"\b(athabasca)\b", None, 100.0, "student"),
    ("student", "sait", r"\b(sait|southern alberta institute)\b", None, 100.0, "student"),
    ("student", "nait", r"\b(nait|northern alberta institute)\b", None, 100.0, "student"),
    ("student", "bowvalley", r"\b(bow valley)\b", None, 100.0, "student"),
    ("student", "norquest", r"\b(norquest)\b", None, 100.0, "student"),
    ("student", "olds", r"\b(olds college)\b", None, 100.0, "student"),
    ("student", "reddeer", r"\b(red deer)\b", None, 100.0, "student"),
    ("student", "other", _STUDENT, None, 50.0, "student"),
    ("student", "other", r"youth|young adult|18-24|18-25|under 25", None, 15.0, "student"),
    ("language", "spanish", r"\b(spanish|español|hispanic|latino|latina)\b", None, 25.0, None),
    ("language", "french", r"\b(french|français|francophone|bilingual)\b", None, 25.0, None),
    ("language", "arabic", r"\b(arabic|arab|muslim)\b", None, 25.0, None),
    ("language", "mandarin", r"\b(mandarin|chinese|cantonese|asian)\b", None, 25.0, None),
    ("language", "punjabi", r"\b(punjabi|sikh|south asian)\b", None, 25.0, None),
    ("language", "tagalog", r"\b(tagalog|filipino|philippines)\b", None, 25.0, None),
    ("language", "vietnamese", r"\b(vietnamese|viet)\b", None, 25.0, None),
    ("language", "ukrainian", r"\b(ukrainian|ukrain)\b", None, 25.0, None),
    ("language", "hindi", r"\b(hindi|indian|south asian)\b", None, 25.0, None),
    ("language", "urdu", r"\b(urdu|pakistan)\b", None, 25.0, None),
    ("language", "korean", r"\b(korean)\b", None, 25.0, None),
    ("language", "nonEnglish", r"\b(multilingual|interpreter|translation|multiple languages)\b", None, 25.0, None),
    ("relatives", "any", r"\b(family support|family services|loved ones|concerned persons|al-?anon|nar-?anon|family counsell?ing|parent support|caregiver|coping)\b", None, 20.0, None),
    ("relatives", "any", r"\b(intervention|family therapy|family program)\b", None, 15.0, None),
]
#: Institutions and languages share one more rule each: a generic service of 30 points, and one in several languages of 15.
GENERIC = [("student", _STUDENT, 30.0, "student"), ("language", _MANY_LANGUAGES, 15.0, None)]

SHAPE = "rule_id string, ordinal int, gate string, item_field string, item_pattern string, item_not_pattern string, points double, only_if_zero boolean, once string"


def rule_rows() -> list[tuple]:
    rows = list(RULES)
    for attribute, pattern, points, once in GENERIC:
        values = dict.fromkeys(v for a, v, *_ in RULES if a == attribute and v != "other")
        rows += [(attribute, v, pattern, None, points, once) for v in values]
    return [(f"{a}-{v}-{k}", k, f"{a}={v}", None, p, n, x, False, f"{a}={v}:{o}" if o else None) for k, (a, v, p, n, x, o) in enumerate(rows)]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), SHAPE)


def boost_demographics(df: DataFrame, attributes: DataFrame, items: DataFrame, key: str = "id", rules: DataFrame | None = None) -> DataFrame:
    """Adds the points of the rules of all attributes of a query (query_id, attribute, value) that fit the text of an item."""
    opened = attributes.select("query_id", F.concat_ws("=", "attribute", "value").alias("gate")).distinct()
    return boost_by_rules(df, attributes, items, None, rules if rules is not None else rule_table(df.sparkSession), key, opened=opened)
