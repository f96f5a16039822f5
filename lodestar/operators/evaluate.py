"""Evaluation of ranked results against test cases.

results: (query_id, rank, name, category, description); cases: (query_id, label, got_label, expected_patterns, must_include,
must_exclude). Scores are between 0 and 100.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.common import edges_of, true


@dataclass(frozen=True)
class Weights:
    include: float = 25
    exclude: float = 25
    patterns: float = 25
    label: float = 15
    filled: float = 10
    name_only: bool = False


DEFAULT = Weights(25, 10, 25, 30, 10)
CI = Weights(30, 30, 20, 20, 0, name_only=True)


def _texts(results: DataFrame, depth: int, name_only: bool) -> Column:
    text = F.lower(F.concat_ws(" ", "name", "category") if name_only else F.concat_ws(" ", "name", "category", "description"))
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= depth, F.struct("rank", text.alias("t"))))), lambda r: r["t"])


def score_results(cases: DataFrame, results: DataFrame, weights: Weights = DEFAULT, depth: int = 10) -> DataFrame:
    """(query_id, label, score, failures): parts of a score that a case does not ask for count as reached; no results score 0."""
    all_ = results.groupBy("query_id").agg(_texts(results, 1_000_000, False).alias("_all"), _texts(results, depth, False).alias("_top"), _texts(results, depth, weights.name_only).alias("_names"))
    j = cases.join(all_, "query_id", "left")
    e = F.array().cast("array<string>")
    want = {c: F.coalesce(F.col(c), e) for c in ("must_include", "must_exclude", "expected_patterns")}
    tops, names = F.coalesce("_top", e), F.coalesce("_names", e)
    inc = F.filter(want["must_include"], lambda w: ~F.exists(tops, lambda t: F.contains(t, F.lower(w))))
    exc = F.filter(want["must_exclude"], lambda w: F.exists(names, lambda t: F.contains(t, F.lower(w))))
    hit = F.size(want["expected_patterns"]) == 0
    hit = hit | F.exists(want["expected_patterns"], lambda p: F.exists(tops, lambda t: F.regexp_like(t, F.concat(F.lit("(?iu)"), edges_of(p)))))
    label = F.col("got_label").eqNullSafe(F.col("label"))
    filled = F.size(F.coalesce("_all", e)) > 0
    score = (
        weights.include * (1 - F.size(inc) / F.greatest(F.size(want["must_include"]), F.lit(1)))
        + F.when(F.size(exc) == 0, weights.exclude).otherwise(0.0)
        + F.when(true(hit), weights.patterns).otherwise(0.0)
        + F.when(label, weights.label).otherwise(0.0)
        + F.when(filled, weights.filled).otherwise(0.0)
    )
    failures = F.array_compact(F.concat(
        F.transform(inc, lambda w: F.concat(F.lit("missing "), w)),
        F.transform(exc, lambda w: F.concat(F.lit("unwanted "), w)),
        F.array(F.when(~true(hit), "no pattern"), F.when(~label, "label"), F.when(~filled, "empty")),
    ))
    return j.select("query_id", "label", F.when(filled, F.round(score, 2)).otherwise(0.0).alias("score"), failures.alias("failures"))


def gate(scores: DataFrame, critical: list[str], overall: float = 85, critical_least: float = 90, label_least: float = 60, low: float = 50, most_low: int = 5) -> DataFrame:
    """Violations (rule, label, value) of the thresholds; an empty result passes."""
    by = scores.groupBy("label").agg(F.round(F.avg("score"), 4).alias("value"))
    all_ = scores.agg(F.round(F.avg("score"), 4).alias("value"), F.count_if(F.col("score") < low).cast("double").alias("n"))
    rules = [
        all_.where(F.col("value") < overall).select(F.lit("overall").alias("rule"), F.lit("").alias("label"), "value"),
        by.where(F.col("label").isin(critical) & (F.col("value") < critical_least)).select(F.lit("critical").alias("rule"), "label", "value"),
        by.where(F.col("value") < label_least).select(F.lit("label").alias("rule"), "label", "value"),
        all_.where(F.col("n") > most_low).select(F.lit("low scores").alias("rule"), F.lit("").alias("label"), F.col("n").alias("value")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def rollup(scores: DataFrame, passed: float = 80, warned: float = 60) -> DataFrame:
    """Per label: cases, mean score, how many pass, warn and fail."""
    s = F.col("score")
    return scores.groupBy("label").agg(F.count("*").alias("cases"), F.round(F.avg(s), 4).alias("mean_score"), F.count_if(s >= passed).alias("passed"), F.count_if((s < passed) & (s >= warned)).alias("warned"), F.count_if(s < warned).alias("failed"))


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, item_id, rank_a, rank_b, moved): how far each item moved; items in one list only have no move."""
    x = a.select("query_id", "item_id", F.col("rank").alias("rank_a"))
    y = b.select("query_id", "item_id", F.col("rank").alias("rank_b"))
    return x.join(y, ["query_id", "item_id"], "full_outer").withColumn("moved", F.col("rank_a") - F.col("rank_b"))


def check_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, verdict): a pattern in the first ten passes, in the next ten warns, else fails; an unwanted word fails."""
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", F.lower(F.concat_ws(" ", "name", "category")).alias("t"))))), lambda r: r["t"])
    later = F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") > 10) & (F.col("rank") <= 20), F.struct("rank", F.lower(F.concat_ws(" ", "name", "category")).alias("t"))))), lambda r: r["t"])
    j = cases.join(results.groupBy("query_id").agg(first.alias("_a"), later.alias("_b")), "query_id", "left")
    e = F.array().cast("array<string>")

    def found(texts: str) -> Column:
        return F.exists(F.coalesce("expected_patterns", e), lambda p: F.exists(F.coalesce(texts, e), lambda t: F.regexp_like(t, F.concat(F.lit("(?iu)"), edges_of(p)))))

    bad = F.exists(F.coalesce("must_exclude", e), lambda w: F.exists(F.coalesce("_a", e), lambda t: F.contains(t, F.lower(w))))
    return j.select("query_id", F.when(bad, "fail").when(found("_a"), "pass").when(found("_b"), "warning").otherwise("fail").alias("verdict"))


def score_band(score: str | Column) -> Column:
    """pass from 80, warning from 60, else fail."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= 80, "pass").when(c >= 60, "warning").otherwise("fail")


def evaluation_report(scores: DataFrame, least: int = 2) -> DataFrame:
    """(issue, queries): failures that occur in several queries."""
    return scores.select("query_id", F.explode(F.array_distinct("failures")).alias("issue")).groupBy("issue").agg(F.count_distinct("query_id").alias("queries")).where(F.col("queries") >= least)
