"""Whole jobs: ranking of a query table and curation of discovery records, as chains of operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.common import blank, matches
from lodestar.operators import curate as E, filters as FL, joins as J, ranking as R
from lodestar.sources import writers as S


@dataclass
class Ranking:
    """What one ranking job uses. Empty tables and lists leave their step out."""

    stop_words: list[str] = field(default_factory=list)
    gates: DataFrame | None = None
    rules: DataFrame | None = None
    owned: DataFrame | None = None
    broad: list[str] = field(default_factory=list)
    groups: DataFrame | None = None
    external: DataFrame | None = None
    pins: DataFrame | None = None
    extra: DataFrame | None = None
    active: DataFrame | None = None
    max_km: float | None = None
    rescue: str = "$^"
    page: int = 1
    size: int = 25


def rank(queries: DataFrame, items: DataFrame, now: Column, cfg: Ranking, vectors: DataFrame | None = None) -> DataFrame:
    """One page of results per query: candidates, fusion, boosts, diversity, activity, filters, supplements, trimming.

    queries: (query_id, text, location, primary, unwanted array, lat, lng). The steps keep a fixed order; each is one operator.
    """
    lexical = R.relevance_search(queries, items, now)
    if vectors is not None:
        fused = R.rrf(lexical, R.semantic_search(vectors, items, 0.15, 50))
    else:
        fused = lexical.select("query_id", "item_id", "score")
    rows = fused.select("query_id", "item_id", "score").join(items.withColumnRenamed("id", "item_id").withColumnRenamed("location", "place"), "item_id")
    rows = rows.join(queries.select("query_id", "text", F.col("location").alias("query_location"), "primary", "unwanted"), "query_id")
    rows = R.boost_name_match(rows.withColumn("aliases", F.array().cast("array<string>")), cfg.stop_words).drop("aliases")
    if cfg.rules is not None:
        rows = R.boost_by_rules(rows, queries, items, cfg.gates, cfg.rules)
    if cfg.external is not None:
        rows = R.blend_scores(rows, cfg.external)
    if cfg.owned is not None:
        rows = R.penalise_off_category(rows, cfg.owned, cfg.broad)
    rows = R.penalise_terms(rows, "unwanted", F.concat_ws(" ", "name", "description"))
    rows = R.boost_quality(rows)
    if cfg.active is not None:
        rows = J.keep_active(rows, cfg.active.withColumnRenamed("id", "item_id"))
    rows = rows.where(blank("query_location") | FL.location_match("place", []) | F.contains(F.lower("place"), F.lower("query_location")))
    if cfg.extra is not None:
        rows = J.supplement(rows, cfg.extra, ["query_id", "item_id"], 15)
    if cfg.max_km is not None:
        rows = FL.within_km(J.attach_distance(rows, queries), cfg.max_km)
    if cfg.groups is not None:
        rows = R.diversify_categories(rows, cfg.groups)
        rows = rows.withColumn("score", F.when(F.col("score").isNotNull(), F.col("score") - F.when(F.col("rank") > 15, 1e-6).otherwise(0.0))).drop("rank")
    rows = R.trim_relevant(rows, matches("category", cfg.rescue)).drop("rank")
    if cfg.pins is not None:
        rows = R.pin(rows, cfg.pins).drop("rank").withColumn("score", F.when(F.col("name").isNotNull(), F.col("score")))
    return R.paginate(rows, cfg.page, cfg.size)


def curate(raw: DataFrame, items: DataFrame, results: DataFrame, keywords: dict[str, list[str]], places: dict[str, list[str]], widths: dict[str, int], run_id: str) -> tuple[DataFrame, DataFrame]:
    """(items after, run summary): resolve records, apply enrichment, normalise contacts, tag, retire region-wide doubles."""
    after, _, outcomes = E.resolve_upsert(raw, items, review=False)
    after = E.apply_enrichment(after, results, widths)
    after = E.normalise_contacts(after)
    text = F.concat_ws(" ", "name", "description")
    after = after.withColumn("tags", E.enhance_tags(text, F.col("location"), F.col("tags"), keywords, places))
    gone = E.dedupe_regional(after, F.regexp_replace("name", r"\s*\(.*\)$", ""), FL.contains("location", "province"))
    return E.set_active(after, gone.select("id"), False), S.run_summary(outcomes, run_id, ["discover", "enrich", "finalise"], "{}")
