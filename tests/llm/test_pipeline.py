"""The pipeline's stages keep what they should, and each works on what the one before kept."""

import corpus_pipeline
from lodestar.llm import decontaminate, near_duplicates
from lodestar.llm.common import staged
from lodestar.llm.queries import ORACLES, QUERIES
from tests.compare import connection, rows as compared


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"test-{name}")
        sizes.append(docs.count())
        if name != "mix":
            assert docs.columns == columns, name
        if name == "near_dedup":
            classes = near_duplicates.near_duplicates(docs)
            assert classes.where("doc_id <> class_id").count() == 0
        if name == "decontaminate":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontaminate.decontaminate(docs, bench).where("contaminated").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0.7 * sizes[0]


def test_stage_names_and_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "mix"]
    assert corpus_pipeline.run(spark, sf_dir).columns[:2] == ["doc_id", "size"]


def test_stages_take_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_queries_with_sql(spark, sf_dir):
    duck = connection(sf_dir)
    for name, sql in ORACLES.items():
        assert compared(QUERIES[name](spark, sf_dir).toPandas()) == compared(duck.execute(sql).df()), name
