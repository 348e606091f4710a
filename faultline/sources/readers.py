"""Readers for training records, pages and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUNDLE = (
    "examples array<struct<id:bigint,source:string,job_name:string,failed_stage:string,failed_method:string,tool_name:string,"
    "error_snippet:string,root_cause:string,fix:string,category:string,confidence:double,is_retriable:boolean>>"
)


def read_training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw records, one per non-empty line, numbered for error reports."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.withColumn("line_id", F.monotonically_increasing_id())


def read_training_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Examples of JSON files that hold them in one array."""
    whole = spark.read.schema(BUNDLE).option("multiLine", True).json(path)
    return whole.select(F.explode("examples").alias("e")).select("e.*").filter(
        (F.trim(F.coalesce("error_snippet", F.lit(""))) != "") & (F.trim(F.coalesce("root_cause", F.lit(""))) != "")
    )


def is_bundle(spark: SparkSession, path: str) -> bool:
    """Whether the first file starts as a JSON object with examples; reads one short text."""
    head = spark.read.text(path).limit(20).agg(F.array_join(F.collect_list("value"), " ").alias("t")).first()["t"] or ""
    return head.lstrip().startswith("{") and '"examples"' in head


def read_sources(spark: SparkSession, path: str, pattern: str = "*.{java,groovy,Jenkinsfile}") -> DataFrame:
    """Source files, one row each, with the language their name tells."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("wholetext", True).text(path)
    name = F.col("path")
    lang = F.when(name.endswith(".java"), "java").when(name.endswith(".groovy") | name.contains("Jenkinsfile"), "groovy").otherwise("other")
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content")).withColumn("lang", lang)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_training_bundle_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bundles stored one per line, which Spark can split over tasks."""
    rows = spark.read.schema(BUNDLE).json(path).select(F.explode("examples").alias("e")).select("e.*")
    return rows.filter((F.trim("error_snippet") != "") & (F.trim("root_cause") != ""))
