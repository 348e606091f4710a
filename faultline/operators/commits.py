"""Risk of recent changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import top_per

# Files that often cause failures, critical files, and risky words of a message.
HIGH_RISK = (
    r"^.*\.py$", r"^.*\.java$", r"^.*\.js$", r"^.*\.ts$", r"^.*\.go$", r"^.*\.rs$", r"^requirements.*\.txt$", r"^package.*\.json$",
    r"^pom\.xml$", r"^build\.gradle$", r"^Dockerfile$", r"^.*\.yml$", r"^.*\.yaml$", r"^Jenkinsfile$", r"^Makefile$",
)
CRITICAL = (
    r"^Jenkinsfile$", r"^Dockerfile$", r"^.*\.yml$", r"^requirements.*\.txt$", r"^package.*\.json$", r"^pom\.xml$", r"^build\.gradle$",
)
RISKY_WORDS = (
    "refactor", "rewrite", "breaking", "major", "migration", "upgrade", "update dependencies", "security", "auth", "database",
    "schema", "config", "deploy", "ci", "build",
)


def newest_commits(commits: DataFrame, k: int = 10) -> DataFrame:
    return top_per(commits, k, [F.col("ts").desc(), F.col("sha").desc()], ["repo"], "age")


def commit_window(commits: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """Newest commits of each repository with their change totals and risky files."""
    new = newest_commits(commits, k)
    per = files.groupBy("sha").agg(
        F.count("*").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.count_if(F.col("path").rlike(X.any_of(HIGH_RISK))).alias("risky_files"),
        F.max(F.col("path").rlike(X.any_of(CRITICAL))).alias("critical"),
    )
    out = new.join(per, "sha", "left")
    return out.na.fill({"files": 0, "insertions": 0, "deletions": 0, "risky_files": 0, "critical": False})


def _norm(path: str) -> Column:
    return F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))


def files_match(changed: DataFrame, wanted: DataFrame, key: str = "repo") -> DataFrame:
    """Pairs of a changed file and a file named in errors: same base name, or the one ends with the other.

    A path with a directory that is a suffix has the same base name, so equality on the base name finds
    it. Only a bare name can end another name; those meet the suffixes of changed base names that are as long as a
    bare name of the same key.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    left = changed.withColumn("_p", _norm("path")).withColumn("_b", base(F.col("_p")))
    right = wanted.select(key, F.col("path").alias("error_file"), _norm("path").alias("_e")).distinct()
    same = left.join(right.withColumn("_b", base(F.col("_e"))), [key, "_b"])
    bare = right.filter(~F.col("_e").contains("/"))
    sizes = bare.groupBy(key).agg(F.collect_set(F.length("_e")).alias("_sizes"))
    shorter = F.filter("_sizes", lambda n: (n > 0) & (n < F.length("_b")))
    tails = F.transform(shorter, lambda n: F.right(F.col("_b"), n))
    ends = left.join(sizes, key).withColumn("_t", F.explode(tails)).join(bare.withColumn("_t", F.col("_e")), [key, "_t"])
    cols = [*changed.columns, "error_file"]
    return same.select(*cols).unionByName(ends.select(*cols))


def suspicion(window: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Score of each recent commit."""
    changed = files.join(window.select("sha", "repo"), "sha")
    hits = files_match(changed, wanted).groupBy("sha").agg(F.count("*").alias("hits"))
    low = F.lower("message")
    words = F.size(F.filter(F.array(*[F.lit(w) for w in RISKY_WORDS]), lambda w: low.contains(w)))
    size = F.col("insertions") + F.col("deletions")
    score = (
        F.coalesce("hits", F.lit(0)) * 10 + words * 3 + F.col("risky_files") * 2
        + F.when(size > 500, 5).when(size > 100, 2).otherwise(0)
    )
    return window.join(hits, "sha", "left").withColumn("score", score.cast("bigint")).drop("hits")


def suspicious(scored: DataFrame, least: int = 5, k: int = 5) -> DataFrame:
    return top_per(scored.filter(F.col("score") >= least), k, [F.col("age")], ["repo"]).select("repo", "rn", "sha", "score")


def risk_score(scored: DataFrame) -> DataFrame:
    """Risk of a repository's recent commits; each window holds at most ten commits."""
    per = scored.groupBy("repo").agg(
        F.least(F.count_if(F.col("score") >= 5), F.lit(5)).alias("suspicious"), F.sum(F.col("insertions") + F.col("deletions")).alias("changes"),
        F.max("critical").alias("critical"), F.count_distinct("author").alias("authors"), F.count("*").alias("commits"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("spread"),
    )
    c = F.col
    parts = (
        (c("suspicious") > 0, F.least(c("suspicious") * 0.15, F.lit(0.4)), "suspicious commits"),
        (c("changes") > 1000, F.lit(0.2), "large changes"),
        (c("changes").between(501, 1000), F.lit(0.1), "moderate changes"),
        (c("critical"), F.lit(0.15), "critical files"),
        (c("authors") > 3, F.lit(0.1), "many authors"),
        ((c("commits") >= 5) & (c("spread") < 3600), F.lit(0.15), "rapid succession"),
    )
    total = F.lit(0.0)
    for cond, weight, _ in parts:
        total = total + F.when(cond, weight).otherwise(0.0)
    factors = F.array_compact(F.array(*[F.when(cond, name) for cond, _, name in parts]))
    return per.select("repo", "suspicious", "changes", F.round(F.least(total, F.lit(1.0)), 6).alias("risk"), F.array_join(factors, ",").alias("factors"))
