"""A stored table in buckets of its key, of which a commit rewrites only those that changed.

Files lie under ``root/rows/v=<version>/_bucket=<b>``. A manifest per version says in which version each bucket was last written. It is
written after the rows, so a commit is seen whole or not at all, and a job that died in between writes the same version again. Versions
only grow: a commit of a version that is already there does nothing, which makes replayed batches harmless. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.common import upsert

MANIFEST = "bucket int, version long"


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions under path/v=<n> whose write ended, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def _bucket_folders(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [int(s.getPath().getName().split("=")[1]) for s in found if s.getPath().getName().startswith("_bucket=")]


@dataclass(frozen=True)
class BucketedTable:
    """root: a folder that all executors see; keys: columns that name a row; schema: all columns, as DDL."""

    root: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self, spark: SparkSession) -> int:
        """The last version that was committed, -1 before the first."""
        return max(committed_versions(spark, f"{self.root}/manifest"), default=-1)

    def places(self, spark: SparkSession) -> dict[int, int]:
        """bucket -> version of its rows; buckets without rows are absent."""
        last = self.version(spark)
        return {} if last < 0 else {r.bucket: r.version for r in spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={last}").collect()}

    def read(self, spark: SparkSession, only: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = self.places(spark)
        paths = [f"{self.root}/rows/v={v}/_bucket={b}" for b, v in wanted.items() if only is None or b in set(only)]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows: at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def commit(self, rows: DataFrame, version: int, touched: Iterable[int] | None = None) -> bool:
        """Replace the touched buckets (null: all) by the given rows, which lie in these. False if the version was there already."""
        spark = rows.sparkSession
        if version <= self.version(spark):
            return False
        before = self.places(spark)
        path = f"{self.root}/rows/v={version}"
        # Spark packs small buckets into one task and cuts large ones, so there are about as many files as buckets or target sizes.
        placed = rows.select(*spark.createDataFrame([], self.schema).columns).withColumn("_bucket", self.bucket())
        placed.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        replaced = set(range(self.buckets) if touched is None else touched)
        after = {b: v for b, v in before.items() if b not in replaced} | dict.fromkeys(_bucket_folders(spark, path), version)
        spark.createDataFrame(list(after.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return True

    def merge(self, delta: DataFrame, version: int, how: dict[str, Column] | None = None, keep: Column | None = None) -> bool:
        """Insert or update the delta's rows (each key once; ``how`` as in ``upsert``), and drop what ``keep`` does not hold for.

        Only the delta's buckets are read and written, so rows that ``keep`` drops stay in the others until these change.
        """
        if version <= self.version(delta.sparkSession):
            return False
        delta = delta.persist()
        try:
            touched = self.touched(delta)
            merged = upsert(self.read(delta.sparkSession, touched), delta, list(self.keys), how)
            return self.commit(merged if keep is None else merged.where(keep), version, touched)
        finally:
            delta.unpersist()
