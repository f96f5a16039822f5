"""The stored index after batches of changes equals one built anew and leaves other buckets alone; bucketed tables and replays."""

from pyspark.sql import functions as F

from lodestar.operators import ranking as R, textindex as X
from lodestar.sources.bucketed import BucketedTable

COLS = "id long, name string, note string"
FIELDS = {"name": "A", "note": "C"}
FIRST = [(1, "red house", "the house"), (2, "blue house", None), (3, None, ""), (4, "old bridge", "red"), (5, "plain words here", "words")]
SECOND = [(1, "red house", "the house"), (2, "blue boat", "house"), (3, "now a name", ""), (5, None, None), (6, "red boat", "red")]
THIRD = [(1, "red", "house"), (2, "blue house", None), (5, "plain words here", "words"), (6, "red boat", "red")]


def same(index, spark, items, rows):
    built = R.index_terms(items, FIELDS)
    cols = ("term", "item_id", "weight", "pos", "tf")
    assert rows(index.postings(spark), *cols) == rows(built, *cols)
    assert rows(index.frequencies(spark), "term", "df") == rows(built.groupBy("term").agg(F.count("*").alias("df")), "term", "df")


def test_refreshed_index_equals_rebuild(spark, rows, tmp_path):
    one, two, three = (spark.createDataFrame(r, COLS) for r in (FIRST, SECOND, THIRD))
    index = X.TextIndex(str(tmp_path / "index"), FIELDS, buckets=8)
    index.build(one)
    same(index, spark, one, rows)
    assert index.refresh(*X.changed_items(one, two, ["name", "note"]), 1)
    same(index, spark, two, rows)
    # The same batch again, and one more before anything is merged.
    assert index.refresh(*X.changed_items(one, two, ["name", "note"]), 1)
    assert index.refresh(*X.changed_items(two, three, ["name", "note"]), 2)
    same(index, spark, three, rows)
    index.compact(spark)
    same(index, spark, three, rows)
    assert not index.refresh(*X.changed_items(one, two, ["name", "note"]), 1)
    same(index, spark, three, rows)


def test_compact_rewrites_touched_buckets_only(spark, rows, tmp_path):
    one = spark.createDataFrame(FIRST, COLS)
    two = spark.createDataFrame([r if r[0] != 4 else (4, "old bridges", "red") for r in FIRST] + [(9, "bridge", None)], COLS)
    index = X.TextIndex(str(tmp_path / "index"), FIELDS, buckets=64)
    index.build(one)
    before = index.base.places(spark)
    old, new = X.changed_items(one, two, ["name", "note"])
    assert {r.id for r in old.collect()} == {4} and {r.id for r in new.collect()} == {4, 9}
    index.refresh(old, new, 1)
    touched = index.compact(spark)
    after = index.base.places(spark)
    assert len(touched) < len(before) and {b for b in after if after[b] == 1} <= set(touched)
    assert all(after[b] == before[b] for b in before if b not in touched)
    same(index, spark, two, rows)


def test_index_of_no_items(spark, rows, tmp_path):
    none = spark.createDataFrame([], COLS)
    index = X.TextIndex(str(tmp_path / "index"), FIELDS, buckets=4)
    index.build(none)
    same(index, spark, none, rows)
    one = spark.createDataFrame(FIRST, COLS)
    index.refresh(*X.changed_items(none, one, ["name", "note"]), 1)
    index.compact(spark)
    same(index, spark, one, rows)
    index.refresh(*X.changed_items(one, none, ["name", "note"]), 2)
    index.compact(spark)
    same(index, spark, none, rows)


def test_bucketed_table_replays_and_expires(spark, rows, tmp_path):
    t = BucketedTable(str(tmp_path / "t"), ("k",), "k string, n long, seen int", 8)
    how = {"n": F.coalesce("b.n", F.lit(0)) + F.col("d.n")}
    batch = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), (None, 5, 1)], "k string, n long, seen int")
    assert t.merge(batch, 0, how) and not t.merge(batch, 0, how)
    more = spark.createDataFrame([("a", 4, 9), (None, 1, 9)], "k string, n long, seen int")
    # A write that died before its manifest leaves rows that nobody reads, and is done again.
    more.withColumn("_bucket", t.bucket()).write.partitionBy("_bucket").parquet(f"{t.root}/rows/v=1")
    assert rows(t.read(spark), "k", "n") == sorted([("a", 1), ("b", 2), (None, 5)], key=repr)
    assert t.merge(more, 1, how)
    assert rows(t.read(spark), "k", "n") == sorted([("a", 5), ("b", 2), (None, 6)], key=repr)
    assert t.merge(spark.createDataFrame([("b", 1, 2)], "k string, n long, seen int"), 2, how, F.col("seen") > 5)
    assert "b" not in {r.k for r in t.read(spark).collect()}
