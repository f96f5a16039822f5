"""What the training-data operators share: words, the shared folder, components of a link table.

Names of columns that an operator makes for itself start with an underscore or are the documented result columns;
each operator first selects the columns it reads, so extra columns of its input cannot clash with them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where staged frames lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): equal inputs give equal, well spread outputs everywhere."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740992.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it may be unset, a new one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here, and a lost executor loses nothing.

    The shuffle files of the write go with it, as nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing will read any more."""
    for df in frames:
        if path := _PATHS.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(links: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table (a, b): a frame (id, root) of the linked ids, root = least id.

    Alternates large-star and small-star steps (Kiveris et al., 2014), whose number of rounds grows with the logarithm of
    the longest path. Each step is one aggregation and one join on ids; nothing is gathered per component. A fingerprint
    of the edge set, one row, tells when it no longer changes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = staged(edges, label)
    before = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        last, edges = edges, staged(small.where("u <> v").distinct(), label)
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())

