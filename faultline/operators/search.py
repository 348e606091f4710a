"""Searches over a console-log index: failed builds, signal lines, focused logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import by_key, top_per, whole_keys
from faultline.operators import classify as C

FAILED_TEXT = "Finished: FAILURE"
JOB_ID = r"/(\d+)/console$"
INTERESTING = (
    r"(?i)error|exception|fatal|script returned exit code|permission denied|not found|unable to checkout revision"
    r"|couldn'?t find any revision"
)
# Texts that make a line a signal, matched without case.
SIGNALS = (
    r"could not find any revision to build", r"couldn't find any revision to build", r"unable to checkout revision",
    r"checkout failed", r"hudson\.plugins\.git\.GitException", r"fatal:", r"error:", r"exception",
    r"script returned exit code", r"permission denied", r"not found",
)
# Weight of a signal line; the highest counts, 12 without any.
SIGNAL_WEIGHTS = (
    (r"(?i)couldn'?t find any revision to build|could not find any revision to build", 100),
    (r"(?i)unable to checkout revision|checkout failed", 95),
    (r"(?i)hudson\.plugins\.git\.GitException|org\.jenkinsci\.plugins\.git", 95),
    (r"(?i)permission denied|access denied|unauthorized|forbidden", 88), (r"(?i)fatal:", 80),
    (r"(?i)(?:^|\s)(?:error|ERROR):\s*\S", 50), (r"(?i)java\.[a-z.]+\.(?:Exception|Error)", 78),
    (r"(?i)npm ERR!|yarn error|pip.*error|maven.*failure", 72), (r"(?i)script returned exit code\s+[1-9]\d*", 38),
    (r"(?i)\bexception\b", 45), (r"(?i)not found|no such file", 55),
)
TAIL_NOISE = (
    r"(?i)^(?:\[[^\]]+\]\s*)?(?:\d{2}:\d{2}:\d{2}\s+)?(?:\+\s*)?(?:Finished:\s*(?:FAILURE|ABORTED|UNSTABLE|NOT_BUILT)\s*"
    r"|Build (?:step .* )?marked build as failure\.?\s*|script returned exit code\s+\d+\s*|Sending interrupt signal to process.*\s*)$"
)


def scan_index(events: DataFrame, now: str, minutes: int, suffix: str = "/console") -> DataFrame:
    """Rows of the last minutes before `now` whose source ends as given; the time bound reaches the scan."""
    # the column's own type, so that the bound is compared without a cast and pushed down
    upper = F.lit(now).cast(events.schema["ts"].dataType)
    return events.filter((F.col("ts") >= upper - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= upper)).filter(
        F.col("src").endswith(suffix)
    )


def job_id(src: Column) -> Column:
    return X.extract(src, JOB_ID)


def count_failures(events: DataFrame, src: Column | None = None) -> DataFrame:
    out = events.withColumn("job_id", job_id(F.col("src"))).filter("job_id is not null")
    if src is not None:
        out = out.withColumn("src", src)
    return out.groupBy("host", "src", "job_id").agg(F.count("*").alias("failures"))


def newest_failures(counted: DataFrame, k: int = 100) -> DataFrame:
    return counted.orderBy(F.col("failures").desc(), "host", "src", "job_id").limit(k)


def failed_builds(events: DataFrame, k: int = 100) -> DataFrame:
    return newest_failures(count_failures(events.filter(F.col("raw").contains(FAILED_TEXT))), k)


def result_of(raw: Column) -> Column:
    return F.upper(F.regexp_extract(raw, r"Finished:\s+(\w+)", 1))


def normalize_src(src: Column, host: Column) -> Column:
    """Source path without the build number, per-country job copies and doubled slashes."""
    whole = F.coalesce(src, host)
    cut = F.regexp_replace(whole, r"/\d+/console$|/console$", "")
    cut = F.when(cut == whole, F.regexp_replace(whole, r"/[^/]+/[^/]+$", "")).otherwise(cut)
    return F.regexp_replace(F.regexp_replace(cut, r"/job/[a-z]{2}(?:-[a-z]+)*-\d+", ""), r"/+", "/")


def normalized_failures(events: DataFrame, k: int = 100) -> DataFrame:
    failed = events.filter(result_of(F.col("raw")) == "FAILURE")
    return newest_failures(count_failures(failed, normalize_src(F.col("src"), F.col("host"))), k)


def inline_snippets(events: DataFrame, lines: int = 120, chars: int = 12000, k: int = 100) -> DataFrame:
    """Failed builds with their distinct interesting rows in order; the rows are limited before they are gathered."""
    keys = ["host", "src", "job_id"]
    failed = (
        events.filter(result_of(F.col("raw")) == "FAILURE")
        .withColumn("job_id", job_id(F.col("src"))).filter("job_id is not null")
        .withColumn("src", normalize_src(F.col("src"), F.col("host")))
    )
    head = failed.groupBy(*keys).agg(F.count("*").alias("failures")).orderBy("src", "job_id", "host").limit(k)
    signal = failed.filter(F.col("raw").rlike(INTERESTING)).select(*keys, "raw").distinct()
    first = top_per(signal, lines, [F.col("raw")], keys).groupBy(*keys).agg(F.array_sort(F.collect_list("raw")).alias("s"))
    return head.join(first, keys, "left").select(
        *keys, "failures", F.coalesce(F.left(F.array_join("s", "\n"), F.lit(chars)), F.lit("")).alias("snippet")
    )


def source_filter(events: DataFrame, marker: str, outer: DataFrame) -> DataFrame:
    """Rows whose source has the marker on any of its rows."""
    marked = events.filter(F.col("raw").contains(marker)).select("src").distinct()
    return outer.join(marked, "src", "left_semi")


def failed_with_fallback(events: DataFrame, marker: str, k: int = 100) -> DataFrame:
    """Failures that carry the marker themselves; if there are none, failures of sources that carry it."""
    failed = events.filter(F.col("raw").contains(FAILED_TEXT))
    fast = failed.filter(F.col("raw").contains(marker))
    slow = source_filter(events, marker, failed).select(*events.columns)
    none = fast.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(True).alias("none"))
    return newest_failures(count_failures(fast.unionByName(slow.join(F.broadcast(none)).drop("none"))), k)


def signal_score(line: Column) -> Column:
    best = X.best_weight(line, SIGNAL_WEIGHTS)
    return F.when(X.strip(line) == "", 0).when(best > 0, best).otherwise(12)


def signal_lines(lines: DataFrame, k: int = 120, extra: tuple[str, ...] = ()) -> DataFrame:
    return top_per(lines.filter(X.found(F.col("line"), [*SIGNALS, *extra], True)), k, [F.col("line_no")], whole_keys(lines))


def tail_lines(lines: DataFrame, k: int = 500) -> DataFrame:
    return C.sample_lines(lines, k, from_end=True)


def rank_candidates(signals: DataFrame, k: int = 5, keys=("build_id",)) -> DataFrame:
    """Distinct signal lines, heaviest and then longest first. `keys` as in `whole_keys`."""
    one = signals.groupBy(*keys, X.strip(F.col("line")).alias("key")).agg(
        F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line")
    ).filter("key <> ''")
    scored = one.withColumn("score", signal_score(F.col("line")))
    order = [F.col("score").desc(), F.length("line").desc(), F.col("line_no")]
    return top_per(scored, k, order, keys).select(*keys, "rn", "line_no", "line", "score")


def is_noise(line: Column) -> Column:
    return X.strip(line).rlike(TAIL_NOISE)


def partition_noise(tail: DataFrame) -> DataFrame:
    return tail.withColumn("noise", is_noise(F.col("line")))


def focused_log(lines: DataFrame, chars: int = 12000) -> DataFrame:
    """Candidates, signals, the rest of the tail and its noise in one text; at most 625 lines per build."""
    keys = whole_keys(lines)
    signals = signal_lines(lines)
    tail = partition_noise(tail_lines(lines))
    # a part is one list a build, which lies where the lines do; lists meet by the keys of a build, and no line of the tail is shuffled
    gathered = lambda df, order, *more: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "line", *more))).alias("c"))
    heard = F.transform("signals", lambda x: X.strip(x["line"]))
    parts = (
        gathered(tail, "line_no", "noise").withColumnRenamed("c", "tail")
        .join(by_key(gathered(signals, "line_no").withColumnRenamed("c", "signals")), keys, "left")
        .join(by_key(gathered(rank_candidates(signals, keys=keys), "rn").withColumnRenamed("c", "candidates")), keys, "left")
        .withColumn("heard", F.coalesce(heard, F.expr("cast(array() as array<string>)")))
    )
    rest = F.filter("tail", lambda x: ~x["noise"] & ~F.array_contains("heard", X.strip(x["line"])))
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"=== {title} ===\n"), F.array_join(F.transform(c, lambda x: x["line"]), "\n")))
    whole = F.concat_ws(
        "\n\n", section("candidates", F.col("candidates")), section("signals", F.col("signals")), section("tail", rest),
        section("noise", F.filter("tail", lambda x: x["noise"])),
    )
    return parts.select("build_id", F.left(whole, F.lit(chars)).alias("log"))


def latest_failed_build(builds: DataFrame) -> DataFrame:
    """Newest build of each job that failed outright."""
    order = F.struct("ts", "number")
    return builds.filter("status = 'FAILURE' and not building").groupBy("job").agg(
        F.max_by("build_id", order).alias("build_id"), F.max("number").alias("highest"), F.count("*").alias("failures")
    )


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 60, F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def build_history(builds: DataFrame, k: int = 5) -> DataFrame:
    w = top_per(builds, k, [F.col("ts").desc(), F.col("number").desc()], ["job"])
    return w.select("job", "rn", "build_id", "status", "building", duration_text(F.col("duration_ms")).alias("duration"))


def history_retention(builds: DataFrame, now: str, days: int = 30, k: int = 1000) -> DataFrame:
    """The newest entries of each job that are not too old."""
    fresh = builds.filter(F.col("ts") >= F.lit(now).cast(builds.schema["ts"].dataType) - F.expr(f"interval {days} days"))
    return top_per(fresh, k, [F.col("ts").desc(), F.col("build_id").desc()], ["job"])
