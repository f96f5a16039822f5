"""Row-wise projections of item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.common import blank, blank_array, col
from lodestar.functions.geo import coarsen, format_distance

#: Parts of the text that a vector is made of, the category twice.
EMBEDDING_PARTS = (("", "name"), ("Category: ", "category"), ("Type: ", "category"), ("Location: ", "location"), ("", "description"), ("Eligibility: ", "eligibility"))
MAX_EMBEDDING_CHARS = 30_000


def fill_gaps(base: DataFrame, side: DataFrame, spec: dict[str, str], key: str = "id", side_key: str = "id") -> DataFrame:
    """Base values where they are not blank, else the side table's. spec: base column -> side column."""
    extra = side.select(F.col(side_key).alias("_k"), *(F.col(s).alias(f"_s_{b}") for b, s in spec.items()))
    joined = base.join(extra, F.col(key) == F.col("_k"), "left")
    filled = []
    for f in base.schema:
        c = F.col(f.name)
        if f.name in spec:
            own = ~blank_array(c) if f.dataType.typeName() == "array" else ~blank(c.cast("string"), True)
            c = F.when(own, c).otherwise(F.col(f"_s_{f.name}"))
        filled.append(c.alias(f.name))
    return joined.select(*filled)


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds which fields are empty, how many are filled, and whether all are."""
    kinds = dict(df.dtypes)
    empty = {f: blank_array(f) if kinds[f].startswith("array") else blank(F.col(f).cast("string"), True) for f in fields}
    gaps = F.array_compact(F.array(*(F.when(c, f) for f, c in empty.items())))
    return df.withColumn("empty_fields", gaps).withColumn("n_filled", F.lit(len(fields)) - F.size("empty_fields")).withColumn("is_complete", F.size("empty_fields") == 0)


def enrichment_updates(current: dict[str, Column], proposed: dict[str, Column]) -> Column:
    """Map of the proposed values whose current value is blank; null if there is none."""
    keys = list(proposed)
    values = F.array(*(F.when(blank(current[k].cast("string"), True), proposed[k].cast("string")) for k in keys))
    updates = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), values), lambda _, v: ~blank(v, True))
    return F.when(F.size(updates) > 0, updates)


def embedding_text(parts: tuple[tuple[str, str], ...] = EMBEDDING_PARTS, size: int = MAX_EMBEDDING_CHARS) -> Column:
    """Labelled parts that are not blank, one per line, cut."""
    return F.substring(F.concat_ws("\n", *(F.when(~blank(c, True), F.concat(F.lit(label), F.trim(c))) for label, c in parts)), 1, size)


def card(df: DataFrame, columns: list[str], lat: str = "latitude", lng: str = "longitude", distance: str = "distance_km") -> DataFrame:
    """Columns of a result card with coordinates of about a hundred metres and the distance as text."""
    return df.select(*columns, coarsen(lat).alias(lat), coarsen(lng).alias(lng), format_distance(distance).alias("distance_text"))


def summary_text(n: str | Column, query: str | Column, place: str | Column) -> Column:
    count = F.when(col(n) == 1, F.lit("1 result")).otherwise(F.concat(col(n).cast("string"), F.lit(" results")))
    return F.concat(count, F.lit(' for "'), col(query), F.lit('"'), F.when(~blank(place), F.concat(F.lit(" in "), col(place))).otherwise(F.lit("")))


def explained(df: DataFrame, factor: str, value: Column, reason: str, explanations: str = "explanations") -> DataFrame:
    """Adds a (factor, value, reason) entry to the explanations of rows whose value is not 0."""
    entry = F.struct(F.lit(factor).alias("factor"), value.cast("double").alias("value"), F.lit(reason).alias("reason"))
    have = F.col(explanations) if explanations in df.columns else F.array().cast("array<struct<factor:string,value:double,reason:string>>")
    return df.withColumn(explanations, F.when(F.coalesce(value, F.lit(0)) != 0, F.concat(have, F.array(entry))).otherwise(have))
