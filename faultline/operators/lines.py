"""Profiling jobs over the whole table of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import attach_facts, scan, top_per
from faultline.operators import classify as C, errors as E
from faultline.rules import errors as RE, shell

CLOCK_FORMS = (
    r"^\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})",
    r"^(\d{2}:\d{2}:\d{2})",
    r"^\[(\d+:\d{2}:\d{2})\]",
)

# Forms of an API answer and the kind each stands for; the first one found wins.
API_FORMS = (
    (r"HTTP/[\d.]+ (\d{3})", "http_status"), (r'"status":\s*(\d{3})', "json_status"), (r'"error":\s*"([^"]+)"', "json_error"),
    (r'"message":\s*"([^"]+)"', "json_message"), (r'"code":\s*"?([^",}\s]+)', "error_code"),
    (r"Response:\s*(.+)", "response"), (r"API Error:\s*(.+)", "api_error"),
)
# Variables that are looked up by name.
KNOWN_VARIABLES = (
    "BUILD_NUMBER", "BUILD_URL", "JOB_NAME", "WORKSPACE", "JENKINS_URL", "NODE_NAME", "EXECUTOR_NUMBER",
    "BRANCH_NAME", "CHANGE_ID", "GIT_COMMIT",
)
SECRET_NAMES = "password|secret|token|key|credential"


def explode_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per line of a text; empty lines stay, numbers start at 1."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(
        key, (F.col("pos") + 1).cast("long").alias("line_no"), "line"
    )


def clip_tail(texts: DataFrame, text: str = "text", limit: int = 10 * 1024 * 1024) -> DataFrame:
    """Keep the end of an oversized text."""
    return texts.withColumn(text, F.when(F.length(text) > limit, F.right(text, F.lit(limit))).otherwise(F.col(text)))


def severity_profile(lines: DataFrame) -> DataFrame:
    placed = C.place_lines(lines).withColumn("severity", X.severity(F.col("line")))
    return placed.groupBy("build_id", "stage", "severity").agg(F.count("*").alias("n"))


def noise_report(lines: DataFrame, extra: str | None = None) -> DataFrame:
    drop = F.col("line").rlike(E.IGNORED)
    if extra:
        drop = drop | F.col("line").rlike(extra)
    return (
        lines.groupBy("build_id")
        .agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"))
        .withColumn("ratio", F.round(F.col("dropped") / (F.col("kept") + F.col("dropped")), 6))
    )


def clock_seconds(line: Column) -> Column:
    stamp = F.coalesce(*[X.extract(line, p) for p in CLOCK_FORMS])
    part = lambda i: F.regexp_extract(stamp, r"(\d+):(\d{2}):(\d{2})$", i).cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def silent_gaps(lines: DataFrame, k: int = 3) -> DataFrame:
    """Longest pauses between two stamped lines of a build."""
    stamped = lines.withColumn("at", clock_seconds(F.col("line"))).filter("at is not null")
    pairs = scan(stamped, {"before_at": ("last", F.col("at"), False), "before_line": ("last", F.col("line_no"), False)})
    gaps = pairs.filter("before_line is not null").withColumn("gap", F.col("at") - F.col("before_at"))
    return top_per(gaps, k, [F.col("gap").desc(), F.col("line_no")]).select("build_id", "gap", "before_line", "line_no", "rn")


def command_of(line: Column) -> Column:
    return F.coalesce(X.shell_command(line), X.continued_command(line))


def command_usage(lines: DataFrame) -> DataFrame:
    """Runs and builds per tool: two aggregations, so that a popular tool is combined per build first."""
    used = lines.select("build_id", X.tool_name(command_of(F.col("line"))).alias("tool")).filter("tool is not null")
    return (
        used.groupBy("tool", "build_id").agg(F.count("*").alias("n"))
        .groupBy("tool").agg(F.count("*").alias("builds"), F.sum("n").alias("runs"))
    )


def exit_code_profile(invocations: DataFrame) -> DataFrame:
    return invocations.filter("exit_code is not null").groupBy("tool", "exit_code").agg(F.count("*").alias("n"))


def output_failure_rate(invocations: DataFrame) -> DataFrame:
    return invocations.groupBy("tool").agg(
        F.count("*").alias("runs"), F.round(F.avg(F.col("output_failed").cast("double")), 6).alias("rate")
    )


def api_answers(lines: DataFrame, k: int = 5) -> DataFrame:
    """First k API answers of each build."""
    line = F.col("line")
    hits = (
        lines.withColumn("kind", X.first_match(line, API_FORMS))
        .filter("kind is not null")
        .withColumn("value", F.coalesce(*[X.extract(line, p) for p, _ in API_FORMS]))
    )
    return top_per(hits, k, [F.col("line_no")]).drop("rn", "line")


def api_failed() -> Column:
    status = F.col("kind").isin("http_status", "json_status") & (F.col("value").try_cast("int") >= 400)
    return F.col("kind").isin("json_error", "api_error") | status


def api_failures(lines: DataFrame, k: int = 3) -> DataFrame:
    """Last k failing answers among the first five of a build, with the lines around them."""
    bad = api_answers(lines).filter(api_failed())
    last = top_per(bad, k, [F.col("line_no").desc()]).select("build_id", F.col("line_no").alias("at"), "kind", "value")
    return (
        E.around(last, lines, 3, 2).groupBy("build_id", "at", "kind", "value")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "near_line"))).alias("ctx"))
        .select(
            "build_id", F.col("at").alias("line_no"), "kind", "value",
            F.left(F.array_join("ctx.near_line", "\n"), F.lit(500)).alias("context"),
        )
    )


def identifier_hotlist(errors: DataFrame, k: int = 50) -> DataFrame:
    """Most frequent identifiers of error lines."""
    line = F.col("line")
    ids = F.array_distinct(F.concat(E.identifiers(line), E.deep_identifiers(line)))
    named = errors.select("build_id", F.explode(ids).alias("identifier"))
    per_build = named.groupBy("identifier", "build_id").agg(F.count("*").alias("n"))
    totals = per_build.groupBy("identifier").agg(F.count("*").alias("builds"), F.sum("n").alias("errors"))
    return totals.orderBy(F.col("builds").desc(), F.col("errors").desc(), "identifier").limit(k)


def resource_mentions(errors: DataFrame) -> DataFrame:
    line = F.col("line")
    every = lambda kind, p: F.transform(
        F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    )
    found = F.concat(every("path", RE.PATHS), every("url", RE.URLS), *[every("variable", p) for p in RE.VARIABLES])
    rows = errors.select("build_id", F.explode(found).alias("r")).select("build_id", "r.*").distinct()
    return rows.groupBy("kind", "value").agg(F.count("*").alias("builds"))


def exception_profile(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    name = X.extract(line, r"(\w+Exception|\w+Error):")
    message = X.strip(F.regexp_replace(X.strip(F.regexp_extract(line, r"(?:\w+Exception|\w+Error):(.*)$", 1)), r"^:+", ""))
    rows = lines.select(name.alias("exception"), message.alias("message")).filter("exception is not null")
    return rows.groupBy("exception").agg(F.count("*").alias("n"), F.min("message").alias("sample"))


def method_file(name: Column, prefix: str | None = None) -> Column:
    """File a method would live in: past the known prefix, before `:` or `.`."""
    bare = F.regexp_replace(X.strip(name), r"\(\)$", "")
    parts = F.split(bare, ":")
    of_parts = parts.getItem(0)
    if prefix:
        of_parts = F.when(F.lower(parts.getItem(0)) == prefix.lower(), F.get(parts, F.lit(1))).otherwise(of_parts)
    return F.when(F.size(parts) >= 2, of_parts).when(bare.contains("."), F.substring_index(bare, ".", 1)).otherwise(bare)


def method_durations(lines: DataFrame) -> DataFrame:
    t = X.strip(F.col("line"))
    rows = lines.select(
        X.method_key(X.extract(t, r"^(.+?)\s+:time-elapsed-seconds:\d+")).alias("method"),
        F.regexp_extract(t, r":time-elapsed-seconds:(\d+)", 1).try_cast("long").alias("seconds"),
    ).filter("method is not null")
    return rows.groupBy("method").agg(
        F.count("*").alias("runs"), F.round(F.avg("seconds"), 6).alias("avg_s"),
        F.round(F.percentile("seconds", F.lit(0.95)), 6).alias("p95_s"),
        F.max(method_file(F.col("method"))).alias("file"),
    )


def job_path(src: Column) -> Column:
    """Job name of a source path: the `job` segments and the build number at the end are left out."""
    parts = F.filter(F.split(src, "/"), lambda x: (x != "") & (x != "job") & (x != "console") & ~x.rlike(r"^\d+$"))
    return F.array_join(parts, "/")


def job_failures(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("raw").contains("Finished: FAILURE"))
        .groupBy(job_path(F.col("src")).alias("job")).agg(F.count("*").alias("failures"))
    )


def clip_both_ends(text: Column, limit: int, head: float = 0.5) -> Column:
    """Keep the start and the end of a long text."""
    left = int(limit * head)
    cut = F.concat(F.left(text, F.lit(left)), F.lit("\n...\n"), F.right(text, F.lit(limit - left)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def clip_corpus(docs: DataFrame, limit: int = 12000, by: str = "source") -> DataFrame:
    clipped = docs.withColumn("clipped", clip_both_ends(F.col("text"), limit))
    return clipped.groupBy(by).agg(
        F.count("*").alias("docs"), F.count_if(F.length("text") > limit).alias("cut"),
        F.sum(F.length("clipped")).cast("long").alias("chars"),
    )


def env_settings(lines: DataFrame) -> DataFrame:
    """Variables a build shows: the block behind its first printenv, and well-known names anywhere."""
    line = F.col("line")
    is_env = line.rlike(r"^[\w]+=")
    start = (
        lines.groupBy("build_id")
        .agg(F.min(F.when(line.contains("printenv"), F.col("line_no"))).alias("printed"), F.max("line_no").alias("n_lines"))
        .filter("printed is not null")
    )
    after = attach_facts(lines, start).filter(F.col("line_no") > F.col("printed"))
    stop = after.groupBy("build_id").agg(F.min(F.when(~is_env, F.col("line_no"))).alias("stop"))
    block = (
        attach_facts(after.drop("n_lines"), stop.join(start.select("build_id", "n_lines"), "build_id"))
        .filter(F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
        .select(
            "build_id", "line_no", F.lit(0).alias("tier"),
            X.strip(F.regexp_extract(line, r"^(\w+)=", 1)).alias("variable"),
            F.left(X.strip(F.regexp_extract(line, r"^\w+=(.*)$", 1)), F.lit(100)).alias("value"),
        )
    )
    named = [
        F.struct(F.lit(v).alias("variable"), X.extract(line, rf"\b{v}[=:]\s*['\"]?([^'\"\s\n]+)").alias("value"))
        for v in KNOWN_VARIABLES
    ]
    known = (
        lines.filter(line.rlike("|".join(KNOWN_VARIABLES)))
        .select("build_id", "line_no", F.explode(F.array(*named)).alias("v"))
        .filter("v.value is not null")
        .groupBy("build_id", "v.variable").agg(F.min("line_no").alias("line_no"), F.min_by("v.value", "line_no").alias("value"))
        .select("build_id", "line_no", F.lit(1).alias("tier"), "variable", "value")
    )
    order = F.struct("tier", "line_no")
    merged = block.unionByName(known).groupBy("build_id", "variable").agg(F.max_by("value", order).alias("value"))
    return merged.withColumn("value", F.when(F.lower("variable").rlike(SECRET_NAMES), "[REDACTED]").otherwise(F.col("value")))


def env_inventory(lines: DataFrame) -> DataFrame:
    return env_settings(lines).groupBy("variable").agg(
        F.count("*").alias("builds"), F.count_if(F.col("value") == "[REDACTED]").alias("masked")
    )


def grep_context(lines: DataFrame, pattern: str, around: int = 3, k: int = 10) -> DataFrame:
    """First k lines of each build that match, with the lines around them."""
    hits = top_per(lines.filter(F.col("line").rlike("(?i)" + pattern)), k, [F.col("line_no")])
    points = hits.select("build_id", F.col("line_no").alias("at"))
    return (
        E.around(points, lines, around, around).groupBy("build_id", "at")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "near_line"))).alias("ctx"))
        .select(
            "build_id", F.col("at").alias("line_no"),
            F.array_join(
                F.transform("ctx", lambda c: F.concat(
                    F.when(c["line_no"] == F.col("at"), ">>> [").otherwise("    ["), c["line_no"], F.lit("] "), c["near_line"])),
                "\n",
            ).alias("snippet"),
        )
    )


def around_targets(targets: DataFrame, lines: DataFrame, k: int = 10) -> DataFrame:
    """Lines around the first line that names a target; a build's targets travel as one array."""
    facts = targets.groupBy("build_id").agg(F.collect_set("target").alias("targets")).join(C.line_count(lines), "build_id")
    low = F.lower("line")
    hits = (
        attach_facts(lines, facts)
        .withColumn("target", F.explode(F.filter("targets", lambda t: low.contains(F.lower(t)))))
        .groupBy("build_id", "target").agg(F.min("line_no").alias("at"))
    )
    return E.around(hits, lines, k, k - 1).select("build_id", "target", "at", "line_no", "near_line")


def setter_lines(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that set a target; a build's targets travel as one array."""
    facts = targets.groupBy("build_id").agg(F.collect_set("target").alias("targets")).join(C.line_count(lines), "build_id")
    low = F.lower("line")
    hits = attach_facts(lines, facts).withColumn(
        "target", F.explode(F.filter("targets", lambda t: low.contains(F.lower(t))))
    )
    name = F.concat(F.lit(r"\Q"), F.col("target"), F.lit(r"\E"))
    sets = F.concat(F.lit("(?i)(?:"), name, F.lit(r"\s*=|--"), name, F.lit("|-D"), name, F.lit(r"|export\s+"), name, F.lit(")"))
    return hits.filter(F.regexp_like("line", sets)).select("build_id", "target", "line_no", "line")
