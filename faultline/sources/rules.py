"""User-supplied rules: checked once, then used like the built-in ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from faultline.rules import errors as RE


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM accepts the pattern; a one-row job that never touches data."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception:  # noqa: BLE001 - any rejection means the pattern cannot be used
        return False
    return True


def register_rules(spark: SparkSession, user: dict[str, list[str]]) -> tuple[dict[str, tuple[str, ...]], list[str]]:
    """User categories with their usable patterns, and the patterns that were left out."""
    dropped, kept = [], {}
    for category, patterns in user.items():
        good = [p for p in patterns if valid_pattern(spark, p)]
        dropped += [p for p in patterns if p not in good]
        if good:
            kept[category.upper()] = tuple(good)
    return kept, dropped


@udtf(returnType="line_no: bigint, line: string")
class ParseLog:
    """SELECT * FROM parse_log(text): the lines of a log as rows, for SQL users."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for i, line in enumerate((text or "").split("\n")):
            yield i + 1, line


def register_sql(spark: SparkSession) -> None:
    spark.udtf.register("parse_log", ParseLog)
