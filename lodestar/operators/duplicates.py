"""Duplicate rows by several rules, as classes instead of pairs.

A rule gives each row a key; rows with one key are one class. What comes out is linear in the rows: the classes with their sizes and
least ids, and for each row its group, which is what remains when classes that share a row are taken together. No class is ever
collected, and no pair of its rows is formed. Classes that hold a large part of all rows are cut into shards by the row's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.common import blank, checkpointed, true

#: A class larger than this is cut into shards of about this many rows.
SHARD_ROWS = 100_000
#: Bound on the number of such classes, as they are broadcast: the shard size grows with the table beyond it.
MAX_LARGE = 10_000


def duplicate_keys(df: DataFrame, rules: list[tuple[str, Column]], key: str = "id") -> DataFrame:
    """(id, rule, k): a row per row and rule whose key is not blank; k is the key's md5, so that long keys travel as 32 characters.

    Each id stands once in the rows; rows without an id are left out.
    """
    keyed = F.array(*(F.struct(F.lit(label).alias("rule"), expr.cast("string").alias("v")) for label, expr in rules))
    flat = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(keyed).alias("_r")).where(~blank("_r.v", True))
    return flat.select("id", "_r.rule", F.md5(F.col("_r.v").cast("binary")).alias("k"))


def duplicate_classes(keys: DataFrame) -> DataFrame:
    """(rule, k, n, rep) of the keys that at least two rows have: their number and least id."""
    return keys.groupBy("rule", "k").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1")


def _attach(rows: DataFrame, side: DataFrame, on: list[str], size: str, shard_rows: int) -> DataFrame:
    """Inner join of rows with a side that holds each key once; keys of more than ``shard_rows`` rows are spread over shards by id.

    The keys to spread are broadcast: sizes add up to at most the number of keyed rows, so there are at most MAX_LARGE of them.
    """
    total = side.agg(F.sum(size)).first()[0] or 0
    shard = max(shard_rows, -(-total // MAX_LARGE))
    side = side.withColumn("_s", F.ceil(F.col(size) / F.lit(shard)).cast("int"))
    large = side.where("_s > 1").select(*on, F.col("_s").alias("_l"))
    placed = rows.join(F.broadcast(large), on, "left").withColumn("_p", F.pmod(F.xxhash64("id"), F.coalesce("_l", F.lit(1))).cast("int"))
    spread = side.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return placed.join(spread, [*on, "_p"]).drop("_p", "_s", "_l")


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of the ids that the links (a, b) join, root the least id of each connected part.

    Each round points every id at the least id among its neighbours, first the larger neighbours, then the smaller ones; the number
    of rounds grows with the logarithm of the longest chain (Kiveris et al., 2014). Each round is written to the checkpoint folder.
    Two numbers of the driver tell when the links stay as they are.
    """

    def settled(df: DataFrame) -> DataFrame:
        return checkpointed(df.where("hi <> lo").distinct())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("hi").agg(F.min("lo").alias("m"))

    links = settled(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    seen = None
    for _ in range(rounds):
        # Larger neighbours of an id go to the least of the id and its neighbours.
        around = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        goal = around.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        wide = around.join(goal, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # An id and its smaller neighbours go to the least of these.
        pointed = wide.join(least(wide), "hi")
        links = settled(pointed.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(pointed.select("hi", F.col("m").alias("lo"))))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(links.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def duplicate_members(keys: DataFrame, classes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, rules, class_id): each row that shares a key, the sorted rules by which it does, and the least id of its group.

    Groups are the connected parts of rows and keys: rows that no rule joins directly are in one group if a chain of rows does.
    A row is in at most one class per rule, so its list of classes is as short as the list of rules.
    """
    met = _attach(keys, checkpointed(classes), ["rule", "k"], "n", shard_rows)
    rows = met.groupBy("id").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_set("rep")).alias("_c"))
    rows = checkpointed(rows)
    # Classes that share a row belong together. Their pairs are few even where a class is large: equal ones fold before the shuffle.
    links = rows.where(F.size("_c") > 1).select(F.col("_c")[0].alias("a"), F.explode(F.slice("_c", 2, 1_000)).alias("b")).distinct()
    roots = connected(links).withColumnsRenamed({"id": "_rep", "root": "class_id"})
    first = rows.select("id", "rules", F.col("_c")[0].alias("_rep"))
    sizes = first.groupBy("_rep").agg(F.count("*").alias("_n"))
    named = sizes.join(roots, "_rep", "left").select("_rep", "_n", F.coalesce("class_id", "_rep").alias("class_id"))
    return _attach(first, checkpointed(named), ["_rep"], "_n", shard_rows).select("id", "rules", "class_id")


def duplicate_summary(members: DataFrame, rows: DataFrame, score: Column, rules: list[str], key: str = "id") -> DataFrame:
    """(class_id, n, representative, and n_<rule> each): size, best row (greatest score, null last, then least id) and rows per rule."""
    scored = members.join(rows.select(F.col(key).alias("id"), (-score.cast("double")).alias("_s")), "id")
    best = F.min(F.struct(F.col("_s").isNull().alias("u"), F.col("_s").alias("s"), F.col("id").alias("id")))["id"]
    counts = [F.count_if(true(F.array_contains("rules", r))).alias(f"n_{r}") for r in rules]
    return scored.groupBy("class_id").agg(F.count("*").alias("n"), best.alias("representative"), *counts)
