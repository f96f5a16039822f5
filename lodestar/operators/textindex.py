"""A stored text index that follows the changes of its items.

Postings and document frequencies lie in buckets of terms. A batch of changed items is turned into the postings that come, go or differ, and
only these are written, as a delta beside the base. Reading takes the base without the postings that a delta speaks of, and the deltas' last
word on them. ``compact`` merges the deltas into the buckets that they touch. After any batches the index equals one built anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.operators.ranking import index_terms
from lodestar.sources.bucketed import BucketedTable, committed_versions

POSTING = ["weight", "pos", "tf"]


def changed_items(before: DataFrame, after: DataFrame, columns: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(old rows, new rows) of the items that differ in these columns, came or went. Ids are unique on both sides."""
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns]
    equal = reduce(lambda x, y: x & y, same)
    a, b = after.alias("a"), before.alias("b")
    on = F.col(f"a.{key}") == F.col(f"b.{key}")
    return b.join(a, on & equal, "left_anti"), a.join(b, on & equal, "left_anti")


def posting_changes(old: DataFrame, new: DataFrame, fields: dict[str, str], key: str = "id", stop: list[str] = ()) -> DataFrame:
    """(term, item_id, weight, pos, tf, was, live): postings of changed items that come, go or differ; those that go keep null values."""
    x = index_terms(old, fields, key, stop).withColumn("was", F.lit(True)).alias("x")
    y = index_terms(new, fields, key, stop).withColumn("live", F.lit(True)).alias("y")
    both = x.join(y, ["term", "item_id"], "full_outer")
    equal = reduce(lambda p, q: p & q, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in POSTING))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("was", "live")]
    return both.where(~equal).select("term", "item_id", *(F.col(f"y.{c}").alias(c) for c in POSTING), *flags)


@dataclass(frozen=True)
class TextIndex:
    """root: a folder that all executors see; fields: column -> class A to D."""

    root: str
    fields: dict[str, str]
    key: str = "id"
    key_type: str = "bigint"
    buckets: int = 64
    stop: tuple[str, ...] = ()

    @property
    def base(self) -> BucketedTable:
        return BucketedTable(f"{self.root}/postings", ("term",), f"term string, item_id {self.key_type}, weight double, pos int, tf bigint", self.buckets)

    @property
    def counts(self) -> BucketedTable:
        return BucketedTable(f"{self.root}/frequencies", ("term",), "term string, df bigint", self.buckets)

    def build(self, items: DataFrame, version: int = 0) -> None:
        """Write base and frequencies from all items. Null texts have no terms; an empty table gives an empty index."""
        self.base.commit(index_terms(items, self.fields, self.key, list(self.stop)), version)
        spark = items.sparkSession
        self.counts.commit(self.base.read(spark).groupBy("term").agg(F.count("*").alias("df")), version)

    def refresh(self, old: DataFrame, new: DataFrame, version: int) -> bool:
        """Write what a batch of changed items (rows before, rows after) changes. The same version again replaces its delta, and does
        nothing once it is merged."""
        spark = old.sparkSession
        if version <= self.base.version(spark):
            return False
        posting_changes(old, new, self.fields, self.key, list(self.stop)).write.mode("overwrite").parquet(f"{self.root}/delta/v={version}")
        return True

    def _deltas(self, spark: SparkSession, after: int) -> DataFrame:
        schema = self.base.schema + ", was boolean, live boolean"
        parts = [spark.read.schema(schema).parquet(f"{self.root}/delta/v={v}").withColumn("_v", F.lit(v)) for v in committed_versions(spark, f"{self.root}/delta") if v > after]
        return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema + ", _v int"))

    def _merged(self, spark: SparkSession, base: DataFrame) -> DataFrame:
        """Base rows with the last word of the deltas; deltas are small beside the base and are what Spark broadcasts if they are."""
        last = self._deltas(spark, self.base.version(spark)).groupBy("term", "item_id").agg(F.max_by(F.struct(*POSTING, "live"), "_v").alias("_d"))
        kept = base.join(last.select("term", "item_id"), ["term", "item_id"], "left_anti")
        return kept.unionByName(last.where("_d.live").select("term", "item_id", *(F.col(f"_d.{c}").alias(c) for c in POSTING)))

    def _frequencies(self, spark: SparkSession, base: DataFrame) -> DataFrame:
        delta = self._deltas(spark, self.counts.version(spark)).select("term", (F.col("live").cast("bigint") - F.col("was").cast("bigint")).alias("df"))
        return base.unionByName(delta.where("df <> 0")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def postings(self, spark: SparkSession) -> DataFrame:
        """(term, item_id, weight, pos, tf) as of the last batch."""
        return self._merged(spark, self.base.read(spark))

    def frequencies(self, spark: SparkSession) -> DataFrame:
        """(term, df): items per term as of the last batch."""
        return self._frequencies(spark, self.counts.read(spark))

    def compact(self, spark: SparkSession) -> list[int]:
        """Merge all deltas into the buckets that they touch; other buckets keep their files. Gives the touched buckets."""
        last = max(committed_versions(spark, f"{self.root}/delta"), default=-1)
        touched = self.base.touched(self._deltas(spark, self.base.version(spark)))
        if last > self.base.version(spark):
            self.base.commit(self._merged(spark, self.base.read(spark, touched)), last, touched)
        if last > self.counts.version(spark):
            terms = self.counts.touched(self._deltas(spark, self.counts.version(spark)))
            self.counts.commit(self._frequencies(spark, self.counts.read(spark, terms)), last, terms)
        return touched
