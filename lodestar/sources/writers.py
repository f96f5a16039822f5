"""Sinks: exports, sitemap rows, the search view, run logs, and write-and-swap of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.common import true


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any text format can hold the rows."""
    nested = ("array", "map", "struct")
    return df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in df.schema))


def export_items(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The whole table as CSV (RFC 4180 quoting) or JSON lines."""
    if fmt == "csv":
        flat(df).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def _escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def sitemap_urls(items: DataFrame, categories: DataFrame, cities: DataFrame, base: str, today: Column) -> DataFrame:
    """(loc, lastmod, changefreq, priority): homepage, categories, categories in cities, items. Categories and cities are small lists."""
    day = F.date_format(today, "yyyy-MM-dd")
    spark = items.sparkSession

    def rows(df: DataFrame, path: Column, freq: str, priority: str, mod: Column = day) -> DataFrame:
        return df.select(_escaped(F.concat(F.lit(base.rstrip("/")), path)).alias("loc"), mod.alias("lastmod"), F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"))

    both = categories.withColumn("_one", F.lit(1)).join(F.broadcast(cities.withColumn("_one", F.lit(1))), "_one")
    own = F.coalesce(F.date_format("last_updated", "yyyy-MM-dd"), day)
    out = rows(spark.range(1), F.lit("/"), "daily", "1.0")
    out = out.unionByName(rows(categories, F.concat(F.lit("/services/"), "category_slug"), "weekly", "0.8"))
    out = out.unionByName(rows(both, F.concat(F.lit("/services/"), "category_slug", F.lit("/"), "city_slug"), "weekly", "0.7"))
    return out.unionByName(rows(items, F.concat(F.lit("/service/"), F.col("id").cast("string")), "monthly", "0.6", own))


def sitemap_xml(urls: DataFrame) -> DataFrame:
    """One text row per sitemap entry."""
    return urls.select(F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod><changefreq>"), "changefreq", F.lit("</changefreq><priority>"), "priority", F.lit("</priority></url>")).alias("value"))


def build_search_view(items: DataFrame, columns: list[str]) -> DataFrame:
    """Active rows with the lower-cased location and the text that is searched."""
    text = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("category", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    return items.where(true(F.col("is_active"))).select(*columns, F.lower(F.coalesce("location", F.lit(""))).alias("location_lower"), text.alias("search_text"))


def run_summary(outcomes: DataFrame, run_id: str, phases: list[str], config: str, kinds: tuple[str, ...] = ("created", "enriched", "skipped", "failed")) -> DataFrame:
    """One row per run: a counter per outcome, the phases and the configuration."""
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    return outcomes.agg(*counts).select(F.lit(run_id).alias("run_id"), *kinds, F.array(*map(F.lit, phases)).alias("phases"), F.lit(config).alias("config"))


def write_table(df: DataFrame, root: str, version: str, by: list[str] = ()) -> DataFrame:
    """A new version of a table beside the old ones; the caller points readers at it once it is whole."""
    path = f"{root.rstrip('/')}/{version}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_requests(requests: DataFrame, path: str) -> None:
    requests.write.mode("append").parquet(path)


def read_table(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")


