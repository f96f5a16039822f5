"""Sources: open data in CSV, change files and crawled pages in JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.common import require_columns

IDENT = {"BN": "bn", "Legal Name": "name", "Address Line 1": "address", "City": "city", "Province": "province", "Postal Code": "postal_code", "Category": "category", "Sub Category": "sub_category", "Designation": "designation"}
PROGRAMS = {"BN": "bn", "Description": "description"}
URLS = {"BN/NE": "bn", "Contact URL": "url"}
CHANGES = {
    "update": "id long, fields map<string,string>, reason string",
    "deactivate": "id long, reason string, keeperId long, mergeFields array<string>",
    "create": "name string, category string, description string, location string, fields map<string,string>",
}
PAGES = "site string, url string, depth int, is_homepage boolean, html string, text string, markdown string, links array<struct<href:string,text:string,context:string,in_nav:boolean>>"


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], required: bool = True) -> DataFrame:
    """CSV with a header; columns are chosen and renamed, and ``line`` numbers rows within the file. A missing optional file is empty."""
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns.values()) + ", line long")
    require_columns(df, columns)
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in columns.items()), F.monotonically_increasing_id().alias("line"))


def read_open_data(spark: SparkSession, ident: str, programs: str, urls: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_csv(spark, ident, IDENT), read_csv(spark, programs, PROGRAMS, False), read_csv(spark, urls, URLS, False)


def read_change_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Updates, deactivations or new records from a JSON array or JSON lines."""
    return spark.read.schema(CHANGES[kind]).option("multiLine", not path.endswith("l")).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).option("multiLine", path.endswith(".json")).json(path)
