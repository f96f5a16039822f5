"""Completion of typed prefixes from a table of the best entries of each prefix.

The table is built once: every entry goes to each of its prefixes, and of a prefix and kind the best few are kept. That top-k merges: each
task keeps its own best before the shuffle, so a prefix that a third of all entries share moves a few rows per task only. A lookup is then
one equi-join. Prefixes longer than the table's go to the entries themselves, by their first characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.common import blank, top

LEAST, LONGEST = 2, 12


def _order() -> list[Column]:
    return [F.desc("weight"), F.col("text")]


def prefix_entries(entries: DataFrame, sensitive: list[str] = ()) -> DataFrame:
    """Distinct (kind, text, weight, _t) of the entries (kind, text, weight): weights of equal texts add up; texts with a sensitive word,
    blank ones and those shorter than LEAST go. A null weight counts as 0."""
    e = entries.where(~blank("text", True)).groupBy("kind", "text").agg(F.sum(F.coalesce("weight", F.lit(0)).cast("double")).alias("weight"))
    e = e.withColumn("_t", F.lower(F.trim("text"))).where(F.length("_t") >= LEAST)
    for word in sensitive:
        e = e.where(~F.contains("_t", F.lit(word.lower())))
    return e


def prefix_table(entries: DataFrame, k: int = 10) -> DataFrame:
    """(kind, prefix, text, weight, rank): the k best of prefix_entries for each prefix of LEAST to LONGEST characters."""
    ends = F.sequence(F.lit(LEAST), F.least(F.length("_t"), F.lit(LONGEST)))
    flat = entries.withColumn("_n", F.explode(ends)).select("kind", F.substr("_t", F.lit(1), F.col("_n")).alias("prefix"), "text", "weight")
    return top(flat, ["kind", "prefix"], _order(), k)


def complete(prefixes: DataFrame, entries: DataFrame, table: DataFrame, caps: dict[str, int], total: int = 7) -> DataFrame:
    """(prefix_id, kind, text, weight, rank) for (prefix_id, text): at most ``caps`` of a kind, which the table must hold, and ``total`` in all,
    kinds in the order of ``caps``. Prefixes shorter than LEAST find nothing."""
    p = prefixes.select("prefix_id", F.lower(F.ltrim("text")).alias("_p"))
    near = p.where(F.length("_p") <= LONGEST).join(table.select("kind", F.col("prefix").alias("_p"), "text", "weight"), "_p")
    head = F.substr("_p", F.lit(1), F.lit(LONGEST))
    far = p.where(F.length("_p") > LONGEST).withColumn("_h", head).join(entries.withColumn("_h", F.substr("_t", F.lit(1), F.lit(LONGEST))), "_h").where(F.startswith("_t", F.col("_p")))
    rows = near.select("prefix_id", "kind", "text", "weight").unionByName(far.select("prefix_id", "kind", "text", "weight"))
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))
    place = F.create_map(*(F.lit(x) for kv in zip(caps, range(len(caps)), strict=True) for x in kv))
    nth = F.row_number().over(Window.partitionBy("prefix_id", "kind").orderBy(*_order()))
    kept = rows.where(F.col("kind").isin(list(caps))).withColumn("_k", nth).where(F.col("_k") <= F.try_element_at(cap, F.col("kind"))).withColumn("_o", F.try_element_at(place, F.col("kind")))
    return top(kept, ["prefix_id"], [F.col("_o"), *_order()], total).drop("_k", "_o")
