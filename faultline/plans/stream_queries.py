"""Queries that run as streams over whole tables, and queries that go through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.scan import attach_facts
from faultline.operators import classify as C, errors as E, knowledge as K, records as R, search as S, triage as TG
from faultline.plans import errors_queries, lines_queries, oracle as O, records_queries
from faultline.plans.oracle import cte, extract, hit, q
from faultline.plans.registry import query
from faultline.session import checkpointed, new_shared_path
from faultline.sources import code as SC, readers, rules as UR, tables as T, writers
from faultline.streaming import streams as M

_FAILED = "upper(regexp_extract(raw, 'Finished:\\s+(\\w+)', 1)) = 'FAILURE'"


def event_stream(spark, d):
    return T.failure_events_of(M.read_stream(spark, d, "events"))


@query("m01_stream_failures", f"SELECT event_id, host, src FROM failure_events WHERE {_FAILED}")
def m01(spark, d):
    return M.drain(M.stream_failures(event_stream(spark, d)).select("event_id", "host", "src"))


@query("m02_stream_dedupe", f"SELECT host, src FROM failure_events WHERE {_FAILED} GROUP BY ALL")
def m02(spark, d):
    return M.drain(M.stream_dedupe(M.stream_failures(event_stream(spark, d)), late="400 days").select("host", "src"))


@query("m03_failure_windows", f"SELECT host, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS failures FROM failure_events WHERE {_FAILED} GROUP BY ALL HAVING time_bucket(INTERVAL 15 MINUTE, any_value(ts)) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM failure_events WHERE {_FAILED})")
def m03(spark, d):
    out = M.drain(M.failure_windows(M.stream_failures(event_stream(spark, d))))
    return out.select("host", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "failures")


cte("event_texts", "SELECT event_id, raw FROM failure_events")


@query("m05_stream_kb_match", "SELECT event_id, tool, code, CAST(confidence AS DOUBLE) AS confidence FROM (" + records_queries.match_sql("event_texts", "t.raw") + ")")
def m05(spark, d):
    events = event_stream(spark, d).select("event_id", "raw")
    known = checkpointed(K.merge_errors(T.tool_errors(spark, d)))
    return M.stream_kb_match(events, known).select("event_id", "tool", "code", "confidence")


@query("m06_stream_line_state", "SELECT build_id, line_no, in_sh, nullif(owner, 0) AS cmd_line FROM owned")
def m06(spark, d):
    """The lines of each build come in three arrivals, as they do while builds run."""
    lines = checkpointed(attach_facts(T.log_lines(spark, d), C.line_count(T.log_lines(spark, d))))
    part = F.floor((F.col("line_no") - 1) * 3 / F.col("n_lines"))
    return M.line_states_of([lines.filter(part == i) for i in range(3)]).select("build_id", "line_no", "in_sh", "cmd_line")


@query("m07_stream_to_queue", f"SELECT host, src, CAST(regexp_extract(src, '/(\\d+)/console$', 1) AS BIGINT) AS job_id, min(event_id) AS event_id FROM failure_events WHERE {_FAILED} GROUP BY ALL")
def m07(spark, d):
    path = new_shared_path(spark, "queue")
    fresh = M.stream_failures(event_stream(spark, d)).select("event_id", "host", "src", S.job_id(F.col("src")).cast("bigint").alias("job_id"))
    spark.createDataFrame([], fresh.schema).write.parquet(path)
    M.stream_to_queue(fresh, path)
    return spark.read.parquet(path).select("host", "src", "job_id", "event_id")


@query("m08_stream_join_build_log", f"SELECT f.event_id AS failure, o.event_id, f.host, o.raw FROM failure_events f JOIN failure_events o ON o.host = f.host AND o.ts BETWEEN f.ts - INTERVAL 10 MINUTE AND f.ts WHERE f.event_id IN (SELECT event_id FROM failure_events WHERE {_FAILED}) AND NOT (upper(regexp_extract(o.raw, 'Finished:\\s+(\\w+)', 1)) = 'FAILURE')")
def m08(spark, d):
    events = event_stream(spark, d)
    others = event_stream(spark, d).filter(S.result_of(F.col("raw")) != "FAILURE")
    return M.drain(M.stream_join_build_log(M.stream_failures(events), others))


# ---- through files ----------------------------------------------------------------------------


@query("a04_read_training_jsonl", "SELECT id % 7 AS job, count(*) AS n FROM examples WHERE trim(error_snippet) <> '' GROUP BY 1")
def a04_files(spark, d):
    path = new_shared_path(spark, "jsonl")
    writers.write_openai_jsonl(records_queries.exported(spark, d), path)
    back = R.restore_examples(readers.read_training_jsonl(spark, path)).filter("error is null")
    return back.groupBy(F.substring_index("job_name", "-", -1).cast("bigint").alias("job")).agg(F.count("*").alias("n"))


@query("a05_read_training_bundle", "SELECT id, error_snippet, root_cause FROM examples WHERE trim(error_snippet) <> '' AND trim(root_cause) <> ''")
def a05(spark, d):
    path = new_shared_path(spark, "bundle")
    ex = records_queries.exported(spark, d).select("id", "source", *R.EXAMPLE_FIELDS)
    # one bundle per source and hundred ids, as users would upload them
    part = ex.groupBy("source", F.floor(F.col("id") / 100).alias("g")).agg(F.collect_list(F.struct(*ex.columns)).alias("examples"))
    part.select(F.to_json(F.struct("examples")).alias("value")).repartition(8).write.option("lineSep", "\n").text(path)
    return readers.read_training_bundle_lines(spark, path).select("id", "error_snippet", "root_cause")


@query("a09_examples_json", "SELECT count(*) AS n FROM examples")
def a09(spark, d):
    path = new_shared_path(spark, "json")
    writers.write_examples_json(T.examples(spark, d), path)
    return spark.read.json(path + "/manifest").select(F.col("count").alias("n"))


@query("a12_read_sources", "SELECT lang, count(*) AS files FROM (SELECT CASE WHEN ends_with(path, '.java') THEN 'java' ELSE 'groovy' END AS lang FROM sources) GROUP BY 1")
def a12(spark, d):
    """Sources as stored files: partitioned by kind and file, each file read whole."""
    path = new_shared_path(spark, "sources")
    src = SC.sources(spark, d)
    kind = F.when(F.col("path").endswith(".java"), "java").otherwise("groovy")
    src.select(kind.alias("kind"), F.col("content")).write.partitionBy("kind").option("lineSep", "\x02\n").text(path)
    files = spark.read.option("lineSep", "\x02\n").text(path)
    return files.groupBy(F.col("kind").alias("lang")).agg(F.count("*").alias("files"))


@query("a13_write_findings", "SELECT status, count(*) AS n FROM builds WHERE NOT building AND (status = 'FAILURE' OR status IS NULL) AND build_id IN (SELECT build_id FROM log_lines) GROUP BY 1")
def a13(spark, d):
    path = new_shared_path(spark, "findings")
    writers.write_findings(TG.findings(T.stored_lines(spark, d), T.builds(spark, d), checkpointed).withColumn("day", F.left("day", F.lit(7))), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


# ---- user rules -------------------------------------------------------------------------------


@query("n01_register_rules", "SELECT category, count(*) AS n FROM errors GROUP BY 1 UNION ALL SELECT 'SITE_RULE', count(*) FROM (SELECT DISTINCT build_id, trim(line, ' ' || chr(9)) FROM clean WHERE regexp_matches(line, 'Checking out branch'))")
def n01(spark, d):
    user, _ = UR.register_rules(spark, {"site_rule": ["Checking out branch", "broken[("]})
    errs = E.parsed_errors(T.stored_lines(spark, d), custom=user, cut=checkpointed)
    return errs.groupBy("category").agg(F.count("*").alias("n"))


@query("n03_parse_log", "SELECT conv_id, turn, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)")
def n03(spark, d):
    UR.register_sql(spark)
    return spark.sql("SELECT c.conv_id, c.turn, p.line_no, p.line FROM {c} c, LATERAL parse_log(c.text) p", c=T.read(spark, d, "conversations"))


# ---- stages in time ---------------------------------------------------------------------------

cte("exec_marks", f"SELECT build_id, line_no, {extract('line', C.STAGE_LABEL)} AS stage FROM log_lines WHERE {extract('line', C.STAGE_LABEL)} IS NOT NULL")
cte("cum_chars", "SELECT build_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY build_id ORDER BY line_no) AS upto FROM log_lines")


@query(
    "c21_execution_path",
    """SELECT m.build_id, m.line_no, m.stage, CASE WHEN bool_or(regexp_matches(l.line, 'ERROR|FAILURE|FAILED')) THEN 'FAILURE' WHEN bool_or(regexp_matches(l.line, 'SUCCESS|PASSED')) THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status
  FROM exec_marks m JOIN cum_chars s ON s.build_id = m.build_id AND s.line_no = m.line_no LEFT JOIN cum_chars l ON l.build_id = m.build_id AND l.line_no > m.line_no AND l.upto <= s.upto + 5000 GROUP BY m.build_id, m.line_no, m.stage""",
)
def c21(spark, d):
    return C.execution_path(T.stored_lines(spark, d))


@query(
    "c28_stage_durations",
    f"""SELECT build_id, start_line, stage, max(sec) - min(sec) AS seconds, count(sec) AS stamps FROM (SELECT p.build_id, p.sec, s.start_line, s.stage FROM (
    SELECT build_id, line_no, {lines_queries._PART(1)} * 3600 + {lines_queries._PART(2)} * 60 + {lines_queries._PART(3)} AS sec FROM log_lines WHERE {lines_queries._STAMP} IS NOT NULL) p
    JOIN spans s ON s.build_id = p.build_id AND p.line_no BETWEEN s.start_line AND s.end_line) GROUP BY ALL""",
)
def c28(spark, d):
    return C.stage_durations(T.stored_lines(spark, d))
