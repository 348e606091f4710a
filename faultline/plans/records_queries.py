"""Queries over the log index, the review queue, feedback, training examples and tool knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.scan import top_per, whole_keys
from faultline.operators import classify as C, errors as E, knowledge as K, records as R, search as S
from faultline.plans import lines_queries, oracle as O
from faultline.plans.oracle import any_hit, best_weight, cte, extract, hit, q, strip
from faultline.plans.registry import query
from faultline.session import dealt
from faultline.sources import tables as T

_T = strip("line")

# ---- log index --------------------------------------------------------------------------------


@query(
    "a03_scan_index",
    "SELECT event_id, host, src FROM failure_events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 4320 MINUTE AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND ends_with(src, '/console')",
)
def a03(spark, d):
    return S.scan_index(T.failure_events(spark, d), "2024-01-20 00:00:00", 4320).select("event_id", "host", "src")


_JID = extract("src", S.JOB_ID)
_NEWEST = "ORDER BY failures DESC, host, src, job_id LIMIT 100"


@query("f01_failed_builds", f"SELECT host, src, {_JID} AS job_id, count(*) AS failures FROM failure_events WHERE contains(raw, '{S.FAILED_TEXT}') AND {_JID} IS NOT NULL GROUP BY ALL {_NEWEST}")
def f01(spark, d):
    return S.failed_builds(T.failure_events(spark, d))


_CUT = "regexp_replace(src, '/\\d+/console$|/console$', '', 'g')"
_NORM = f"regexp_replace(regexp_replace(CASE WHEN {_CUT} = src THEN regexp_replace(src, '/[^/]+/[^/]+$', '', 'g') ELSE {_CUT} END, '/job/[a-z]{{2}}(?:-[a-z]+)*-\\d+', '', 'g'), '/+', '/', 'g')"
cte("failed_rows", f"SELECT event_id, host, {_NORM} AS src, {_JID} AS job_id, raw FROM failure_events WHERE upper(regexp_extract(raw, 'Finished:\\s+(\\w+)', 1)) = 'FAILURE' AND {_JID} IS NOT NULL")


@query("f02_normalize_src", f"SELECT host, src, job_id, count(*) AS failures FROM failed_rows GROUP BY ALL {_NEWEST}")
def f02(spark, d):
    return S.normalized_failures(T.failure_events(spark, d))


@query(
    "f03_inline_snippets",
    f"""SELECT h.*, coalesce(left(array_to_string(list_sort(s)[1:120], chr(10)), 12000), '') AS snippet FROM (SELECT host, src, job_id, count(*) AS failures FROM failed_rows GROUP BY ALL ORDER BY src, job_id, host LIMIT 100) h
  LEFT JOIN (SELECT host, src, job_id, list(DISTINCT raw) AS s FROM failed_rows WHERE {hit("raw", S.INTERESTING)} GROUP BY ALL) f USING (host, src, job_id)""",
)
def f03(spark, d):
    return S.inline_snippets(T.failure_events(spark, d))


@query("e12_source_filter", "SELECT event_id, src FROM failure_events WHERE src IN (SELECT src FROM failure_events WHERE contains(raw, 'code 1'))")
def e12(spark, d):
    ev = T.failure_events(spark, d)
    return S.source_filter(ev, "code 1", ev).select("event_id", "src")


@query(
    "e14_failed_builds_with_fallback",
    f"""SELECT host, src, {_JID} AS job_id, count(*) AS failures FROM failure_events WHERE contains(raw, '{S.FAILED_TEXT}') AND {_JID} IS NOT NULL AND
  (contains(raw, 'ERROR: step') OR (NOT EXISTS (SELECT 1 FROM failure_events WHERE contains(raw, '{S.FAILED_TEXT}') AND contains(raw, 'ERROR: step')) AND src IN (SELECT src FROM failure_events WHERE contains(raw, 'ERROR: step')))) GROUP BY ALL {_NEWEST}""",
)
def e14(spark, d):
    return S.failed_with_fallback(T.failure_events(spark, d), "ERROR: step")


cte("fresh", "SELECT event_id, host, src, CAST(regexp_extract(src, '/(\\d+)/console$', 1) AS BIGINT) AS job_id, raw FROM failure_events WHERE contains(raw, 'Finished: FAILURE')")
cte("queued", "SELECT DISTINCT host, src, job_id FROM fresh WHERE event_id % 3 = 0")


def fresh(spark, d):
    ev = T.failure_events(spark, d).filter(F.col("raw").contains(S.FAILED_TEXT))
    return ev.select("event_id", "host", "src", S.job_id(F.col("src")).cast("bigint").alias("job_id"), "raw")


def queued(spark, d):
    return fresh(spark, d).filter("event_id % 3 = 0").select("host", "src", "job_id").distinct()


@query("e13_not_in_queue", "SELECT event_id FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM queued k WHERE k.host = f.host AND k.src = f.src AND k.job_id = f.job_id)")
def e13(spark, d):
    return R.not_in_queue(fresh(spark, d), queued(spark, d)).select("event_id")


@query("h04_queue_insert", "SELECT host, src, job_id, min(event_id) AS event_id, arg_min(raw, event_id) AS raw FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM queued k WHERE k.host = f.host AND k.src = f.src AND k.job_id = f.job_id) GROUP BY ALL")
def h04(spark, d):
    return R.queue_insert(queued(spark, d), fresh(spark, d))


# ---- signals and focused logs -----------------------------------------------------------------

_SCORE = f"CASE WHEN {_T} = '' THEN 0 WHEN {best_weight('line', S.SIGNAL_WEIGHTS)} > 0 THEN {best_weight('line', S.SIGNAL_WEIGHTS)} ELSE 12 END"
cte("signals", f"SELECT build_id, line_no, line, row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS rn FROM log_lines WHERE {any_hit('line', S.SIGNALS, True)} QUALIFY rn <= 120")
cte("signal_one", f"SELECT build_id, {_T} AS k, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM signals WHERE {_T} <> '' GROUP BY ALL")
cte("candidates", f"SELECT build_id, row_number() OVER (PARTITION BY build_id ORDER BY score DESC, length(line) DESC, line_no) AS rn, line_no, line, score FROM (SELECT *, {_SCORE} AS score FROM signal_one) QUALIFY rn <= 5")
cte("tail_rows", f"SELECT build_id, line_no, line, {hit(_T, S.TAIL_NOISE)} AS noise FROM sized WHERE line_no > n_lines - 500")


@query("g04_rank_candidates", "SELECT build_id, rn, line_no, line, score FROM candidates")
def g04(spark, d):
    return S.rank_candidates(S.signal_lines(T.log_lines(spark, d)))


@query("g05_signal_score", f"SELECT score, count(*) AS n FROM (SELECT {_SCORE} AS score FROM log_lines) GROUP BY 1")
def g05(spark, d):
    return T.log_lines(spark, d).select(S.signal_score(F.col("line")).alias("score")).groupBy("score").agg(F.count("*").alias("n"))


@query("g06_signal_lines", "SELECT build_id, line_no, line, rn FROM signals")
def g06(spark, d):
    return S.signal_lines(T.log_lines(spark, d))


@query("g07_tail_lines", "SELECT build_id, line_no, line FROM sized WHERE line_no > n_lines - 10")
def g07(spark, d):
    return S.tail_lines(T.log_lines(spark, d), 10)


@query("g08_partition_noise", "SELECT build_id, count(*) FILTER (noise) AS noise, count(*) FILTER (NOT noise) AS kept FROM tail_rows GROUP BY 1")
def g08(spark, d):
    tail = S.partition_noise(S.tail_lines(T.log_lines(spark, d)))
    return tail.groupBy("build_id").agg(F.count_if("noise").alias("noise"), F.count_if(~F.col("noise")).alias("kept"))


@query(
    "g09_focused_log",
    f"""SELECT build_id, left(string_agg(txt, chr(10) || chr(10) ORDER BY p), 12000) AS log FROM (
    SELECT build_id, 1 AS p, '=== candidates ===' || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS txt FROM candidates GROUP BY 1
    UNION ALL SELECT build_id, 2, '=== signals ===' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) FROM signals GROUP BY 1
    UNION ALL SELECT build_id, 3, '=== tail ===' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) FROM tail_rows t WHERE NOT noise AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.build_id = t.build_id AND {strip("s.line")} = {strip("t.line")}) GROUP BY 1
    UNION ALL SELECT build_id, 4, '=== noise ===' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) FROM tail_rows WHERE noise GROUP BY 1) GROUP BY 1""",
)
def g09(spark, d):
    return S.focused_log(T.stored_lines(spark, d))


# ---- builds -----------------------------------------------------------------------------------


@query("g10_latest_failed_build", "SELECT job, arg_max(build_id, (ts, number)) AS build_id, max(number) AS highest, count(*) AS failures FROM builds WHERE status = 'FAILURE' AND NOT building GROUP BY 1")
def g10(spark, d):
    return S.latest_failed_build(T.builds(spark, d))


@query(
    "g11_build_history",
    """SELECT job, row_number() OVER (PARTITION BY job ORDER BY ts DESC, number DESC) AS rn, build_id, status, building,
  CASE WHEN duration_ms // 1000 >= 60 THEN (duration_ms // 60000) || 'm ' || ((duration_ms // 1000) % 60) || 's' ELSE (duration_ms // 1000) || 's' END AS duration FROM builds QUALIFY rn <= 5""",
)
def g11(spark, d):
    return S.build_history(T.builds(spark, d))


@query("g13_history_retention", "SELECT build_id, job, row_number() OVER (PARTITION BY job ORDER BY ts DESC, build_id DESC) AS rn FROM builds WHERE ts >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 900 DAY QUALIFY rn <= 3")
def g13(spark, d):
    return S.history_retention(T.builds(spark, d), "1998-08-01 00:00:00", 900, 3).select("build_id", "job", "rn")


# ---- feedback and queue -----------------------------------------------------------------------


@query("f04_feedback_stats", "SELECT error_category, count(*) AS total, count(*) FILTER (was_correct) AS correct, round(avg(CAST(was_correct AS DOUBLE)), 6) AS accuracy FROM feedback GROUP BY ROLLUP (error_category)")
def f04(spark, d):
    return R.feedback_stats(T.feedback(spark, d))


@query(
    "f07_queue_stats",
    "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, round(avg(ai_confidence) FILTER (status = 'approved'), 6) AS avg_confidence FROM review_queue",
)
def f07(spark, d):
    return R.queue_stats(T.review_queue(spark, d))


@query(
    "f08_test_summary",
    """SELECT l_orderkey AS build_id, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS passed, count(*) FILTER (l_returnflag = 'R' OR l_returnflag <> 'A' AND l_linenumber <> 1) AS failed,
  count(*) FILTER (l_returnflag NOT IN ('A','R') AND l_linenumber = 1) AS skipped FROM lineitem GROUP BY 1""",
)
def f08(spark, d):
    return R.test_summary(T.test_cases(spark, d))


@query("g01_recent_feedback", "SELECT id, error_category, was_correct FROM feedback WHERE error_category = 'EN' ORDER BY id DESC LIMIT 50")
def g01(spark, d):
    return T.feedback(spark, d).filter("error_category = 'EN'").orderBy(F.col("id").desc()).limit(50).select("id", "error_category", "was_correct")


@query("g12_queue_list", "SELECT id, host, status FROM review_queue WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 100")
def g12(spark, d):
    q_ = T.review_queue(spark, d).filter("status = 'pending'")
    return q_.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(100).select("id", "host", "status")


@query(
    "h05_queue_update",
    """SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 0 THEN 'approved' ELSE status END ELSE status END AS status, CASE WHEN id % 5 = 0 THEN coalesce(CASE WHEN id % 3 = 0 THEN 'seen ' || host END, reviewer_root_cause) ELSE reviewer_root_cause END AS reviewer_root_cause,
  CASE WHEN id % 5 = 0 THEN '2024-02-01' END AS reviewed_at FROM review_queue""",
)
def h05(spark, d):
    queue = T.review_queue(spark, d)
    updates = queue.filter("id % 5 = 0").select(
        "id", F.when(F.col("id") % 10 == 0, "approved").alias("status"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("seen "), "host")).alias("reviewer_root_cause"), F.lit("2024-02-01").alias("reviewed_at"),
    )
    return R.queue_update(queue, updates).select("id", "status", "reviewer_root_cause", "reviewed_at")


cte("from_review", "SELECT id, 'review_queue' AS source, 3 AS precedence, error_snippet, coalesce(reviewer_root_cause, ai_root_cause) AS root_cause, coalesce(reviewer_fix, ai_fix) AS fix, ai_category AS category, 1.0 AS confidence FROM review_queue WHERE status = 'approved'")
cte("from_feedback", "SELECT id, 'feedback' AS source, 1 AS precedence, error_snippet, confirmed_root_cause AS root_cause, coalesce(confirmed_fix, '') AS fix, error_category AS category, CASE WHEN was_correct THEN 0.95 ELSE 0.85 END AS confidence FROM feedback WHERE coalesce(error_snippet, '') <> '' AND coalesce(confirmed_root_cause, '') <> ''")


def _pick(items, i):
    return f"({O.values(items)})[CAST({i} AS INTEGER) + 1]"


_NAME = _pick(T.TOOL_NAMES, f"s_suppkey % {len(T.TOOL_NAMES)}")
cte(
    "tool_definitions",
    f"""SELECT s_suppkey AS id, {_NAME} AS name, ['build','deploy','test','infra'][s_suppkey % 4 + 1] AS category, 'written by ' || s_name || repeat('!', CAST(s_suppkey % 5 AS INTEGER)) AS description,
  CASE WHEN s_suppkey % 3 = 0 THEN 'https://docs/' || {_NAME} || '/' || s_suppkey END AS docs_url, s_name || '.md' AS source_file, (s_suppkey % 10) / 10.0 AS confidence,
  {_NAME} || ' ' || ['install','deploy','run'][s_suppkey % 3 + 1] AS command, CASE WHEN s_suppkey % 2 = 0 THEN 'regex:' || {_NAME} || '\\s+ERR' ELSE '[' || {_NAME} || ']' END AS signature,
  CASE WHEN s_suppkey % 5 = 0 THEN {_NAME} || '-cli' END AS alias FROM supplier""",
)
_RULE = f"p_partkey % {len(T.ERROR_RULES)}"
cte(
    "tool_errors",
    f"""SELECT p_partkey AS id, {_pick(T.TOOL_NAMES, f"p_partkey % {len(T.TOOL_NAMES)}")} AS tool, {_pick([r[0] for r in T.ERROR_RULES], _RULE)} AS code, {_pick([r[1] for r in T.ERROR_RULES], _RULE)} AS pattern,
  {_pick([r[2] for r in T.ERROR_RULES], _RULE)} AS is_regex, ['NETWORK','CREDENTIAL','BUILD'][p_partkey % 3 + 1] AS category, p_name AS description, CASE WHEN p_size % 4 > 0 THEN p_type ELSE '' END AS fix, p_size % 2 = 0 AS retriable, 0.5 + (p_partkey % 5) / 10.0 AS confidence FROM part""",
)
cte("tools", "SELECT name, arg_max(description, (length(description), -id)) AS description, arg_min(docs_url, id) FILTER (docs_url IS NOT NULL) AS docs_url, arg_max(source_file, id) AS source_file, arg_min(category, id) AS category, max(confidence) AS confidence, count(*) AS merged, list_sort(list(DISTINCT command)) AS commands, list_sort(list(DISTINCT signature)) AS signatures, coalesce(list_sort(list(DISTINCT alias) FILTER (alias IS NOT NULL)), []) AS aliases FROM tool_definitions GROUP BY 1")
cte("known_errors", "SELECT * FROM tool_errors QUALIFY row_number() OVER (PARTITION BY tool, code ORDER BY id) = 1")
cte("from_knowledge", "SELECT id, 'knowledge' AS source, 2 AS precedence, code || ': ' || description AS error_snippet, 'Tool ''' || tool || ''' error: ' || description AS root_cause, CASE WHEN fix <> '' THEN fix ELSE 'Check ' || tool || ' documentation' END AS fix, category, 0.9 AS confidence FROM tool_errors WHERE description <> ''")
cte("all_training", "SELECT * FROM from_feedback UNION ALL SELECT * FROM from_knowledge UNION ALL SELECT * FROM from_review")


def all_training(spark, d):
    return R.union_training(T.feedback(spark, d), T.tool_errors(spark, d), T.review_queue(spark, d))


@query("h06_approve_to_example", "SELECT id, error_snippet, root_cause, fix, category, confidence FROM from_review")
def h06(spark, d):
    return R.from_review(T.review_queue(spark, d)).drop("source", "precedence")


@query("h03_union_training", "SELECT id, source, error_snippet, root_cause, fix, category, CAST(confidence AS DOUBLE) AS confidence FROM all_training")
def h03(spark, d):
    return all_training(spark, d).drop("precedence")


_HASH = "md5(coalesce(error_snippet, '') || '|' || coalesce(root_cause, '') || '|' || coalesce(fix, ''))"


@query("h01_content_hash", f"SELECT id, {_HASH} AS content_hash FROM examples")
def h01(spark, d):
    return T.examples(spark, d).select("id", R.content_hash().alias("content_hash"))


@query("h02_dedupe_examples", f"SELECT {_HASH} AS content_hash, min(source) FILTER (precedence = 3) IS NOT NULL AS has_review, count(*) - 1 AS skipped, arg_min(source, precedence * 100000000000 + id) AS source, arg_min(id, precedence * 100000000000 + id) AS id FROM all_training GROUP BY 1")
def h02(spark, d):
    hashed = all_training(spark, d).withColumn("content_hash", R.content_hash())
    kept = R.dedupe_examples(hashed).select("content_hash", "skipped", "source", "id")
    reviewed = hashed.groupBy("content_hash").agg(F.max(F.col("precedence") == 3).alias("has_review"))
    return kept.join(reviewed, "content_hash")


_ISS = f"""list_filter([CASE WHEN length(error_snippet) < 10 THEN 'error_snippet too short or missing' END, CASE WHEN length(root_cause) < 10 THEN 'root_cause too short or missing' END,
  CASE WHEN length(error_snippet) > 5000 THEN 'error_snippet too long (>5000 chars)' END, CASE WHEN length(root_cause) > 2000 THEN 'root_cause too long (>2000 chars)' END,
  CASE WHEN category <> '' AND NOT list_contains({O.values(R.VALID_CATEGORIES)}, category) THEN 'invalid category: ' || category END,
  CASE WHEN NOT (confidence BETWEEN 0 AND 1) THEN 'invalid confidence: ' || CAST(confidence AS DOUBLE) END], lambda x: x IS NOT NULL)"""
cte("checked", f"SELECT *, array_to_string(iss, '; ') AS notes, len(iss) = 0 AS is_validated, CASE WHEN len(iss) = 0 THEN 1.0 ELSE 0.5 END AS quality FROM (SELECT *, {_ISS} AS iss, {_HASH} AS content_hash FROM examples)")


@query("i01_validate_example", "SELECT notes, count(*) AS n FROM checked GROUP BY 1")
def i01(spark, d):
    return T.examples(spark, d).select(F.array_join(R.issues(), "; ").alias("notes")).groupBy("notes").agg(F.count("*").alias("n"))


@query("i02_quality_columns", "SELECT id, is_validated, notes, CAST(quality AS DOUBLE) AS quality, content_hash, left(error_snippet, 5000) AS error_snippet, left(root_cause, 2000) AS root_cause, left(fix, 1000) AS fix FROM checked")
def i02(spark, d):
    return R.quality_columns(T.examples(spark, d)).select("id", "is_validated", "notes", "quality", "content_hash", "error_snippet", "root_cause", "fix")


_STAT = "count(*) AS n, count(*) FILTER (is_validated) AS valid, round(avg(CAST(quality AS DOUBLE)), 6) AS avg_quality FROM checked GROUP BY ALL"


@query("f06_training_stats", f"SELECT 'all' AS dim, '' AS value, {_STAT} UNION ALL SELECT 'source', source, {_STAT} UNION ALL SELECT 'category', category, {_STAT}")
def f06(spark, d):
    return R.training_stats(R.quality_columns(T.examples(spark, d)))


@query("f15_job_prepare_summary", "SELECT count(*) AS total, count(*) FILTER (quality >= 0.8) AS valid FROM checked")
def f15(spark, d):
    return R.job_prepare_summary(R.quality_columns(T.examples(spark, d)), 0.8)


@query("g02_examples_filter", "SELECT id, source, CAST(quality AS DOUBLE) AS quality FROM checked WHERE source = 'feedback' AND quality >= 0.5 AND is_validated ORDER BY id DESC LIMIT 100")
def g02(spark, d):
    kept = R.quality_columns(T.examples(spark, d)).filter("source = 'feedback' and quality >= 0.5 and is_validated")
    return kept.orderBy(F.col("id").desc()).limit(100).select("id", "source", "quality")


@query("g03_examples_page", "SELECT id, source FROM examples ORDER BY id DESC LIMIT 25 OFFSET 50")
def g03(spark, d):
    return R.examples_page(T.examples(spark, d), 3, 25).select("id", "source")


@query(
    "h07_patch_examples",
    f"""SELECT p.id, new_hash, new_hash <> old_hash AND EXISTS (SELECT 1 FROM (SELECT {_HASH} AS h FROM examples) e WHERE e.h = new_hash) AS refused, length(error_snippet) >= 10 AND length(root_cause) BETWEEN 10 AND 2000 AND length(error_snippet) <= 5000
    AND (category = '' OR list_contains({O.values(R.VALID_CATEGORIES)}, category)) AND confidence BETWEEN 0 AND 1 AS is_validated
  FROM (SELECT id, {_HASH} AS old_hash, md5(error_snippet || '|' || coalesce(root2, root_cause) || '|' || fix) AS new_hash, error_snippet, coalesce(root2, root_cause) AS root_cause, coalesce(cat2, category) AS category, confidence
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'patched ' || source || ' cause' END AS root2, CASE WHEN id % 3 = 0 THEN 'BUILD' END AS cat2 FROM examples)) p""",
)
def h07(spark, d):
    stored = T.examples(spark, d)
    patches = stored.filter("id % 3 = 0").select("id", F.concat(F.lit("patched "), "source", F.lit(" cause")).alias("root_cause"), F.lit("BUILD").alias("category"))
    return R.patch_examples(stored, patches)


@query(
    "h08_delete_tools",
    "SELECT 'errors' AS kind, count(*) AS n FROM known_errors WHERE tool NOT IN (SELECT name FROM tools WHERE confidence < 0.6) UNION ALL SELECT 'tools', count(*) FROM tools WHERE NOT confidence < 0.6 "
    "UNION ALL SELECT 'unlinked docs', count(*) FROM documents WHERE ['npm','a2l','kubectl','mvn','curl','docker','helm','pytest','printenv','that','der','que','make','go','terraform','vault'][doc_id % 16 + 1] IN (SELECT name FROM tools WHERE confidence < 0.6)",
)
def h08(spark, d):
    tools, errors = K.merge_tools(T.tool_definitions(spark, d)), K.merge_errors(T.tool_errors(spark, d))
    gone = tools.filter("confidence < 0.6").select("name")
    docs = T.documents(spark, d).withColumn("tool", T._pick(T.TOOL_NAMES, F.col("doc_id") % len(T.TOOL_NAMES)))
    linked = docs.join(gone.withColumnRenamed("name", "tool").withColumn("gone", F.lit(True)), "tool", "left")
    n = lambda df, kind: df.select(F.lit(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return (
        n(errors.join(gone.withColumnRenamed("name", "tool"), "tool", "left_anti"), "errors")
        .unionByName(n(tools.join(gone, "name", "left_anti"), "tools"))
        .unionByName(linked.agg(F.lit("unlinked docs").alias("kind"), F.count_if("gone").alias("n")))
    )


@query("h09_link_doc_to_tool", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN t.name END AS tool FROM documents d LEFT JOIN tools t ON t.name = ['npm','a2l','kubectl','mvn','curl','docker','helm','pytest','printenv','that','der','que','make','go','terraform','vault'][doc_id % 16 + 1]")
def h09(spark, d):
    docs = T.documents(spark, d).select("doc_id", F.lit(None).cast("string").alias("tool"))
    links = T.documents(spark, d).filter("doc_id % 4 = 0").select("doc_id", T._pick(T.TOOL_NAMES, F.col("doc_id") % len(T.TOOL_NAMES)).alias("name"))
    valid = links.join(K.merge_tools(T.tool_definitions(spark, d)).select("name"), "name").select("doc_id", F.col("name").alias("new"))
    return docs.join(valid, "doc_id", "left").select("doc_id", F.coalesce("new", "tool").alias("tool"))


@query(
    "h10_was_correct",
    "SELECT id, CASE WHEN coalesce(a,'') = '' OR coalesce(b,'') = '' THEN true ELSE contains(a, left(b, 50)) OR contains(b, left(a, 50)) END AS was_correct FROM (SELECT id, lower(original_root_cause) AS a, lower(confirmed_root_cause) AS b FROM feedback)",
)
def h10(spark, d):
    return T.feedback(spark, d).select("id", R.was_correct("original_root_cause", "confirmed_root_cause").alias("was_correct"))


@query("h11_quality_gate", "SELECT CASE WHEN status <> 'pending' THEN 'done' WHEN ai_confidence >= 0.85 THEN 'auto_approve' ELSE 'review' END AS gate, count(*) AS n, round(avg(ai_confidence), 6) AS avg_confidence FROM review_queue GROUP BY 1")
def h11(spark, d):
    return R.quality_gate(T.review_queue(spark, d))


# ---- knowledge --------------------------------------------------------------------------------


@query("f05_kb_stats", "SELECT 'tools' AS kind, category, count(*) AS n FROM tools GROUP BY ALL UNION ALL SELECT 'errors', category, count(*) FROM known_errors GROUP BY ALL UNION ALL SELECT 'docs', source, count(*) FROM documents GROUP BY ALL")
def f05(spark, d):
    return K.kb_stats(K.merge_tools(T.tool_definitions(spark, d)), K.merge_errors(T.tool_errors(spark, d)), T.documents(spark, d))


@query("f10_tools_with_error_count", "SELECT t.name, t.category, count(e.tool) AS errors FROM tools t LEFT JOIN known_errors e ON e.tool = t.name GROUP BY ALL")
def f10(spark, d):
    return K.tools_with_error_count(K.merge_tools(T.tool_definitions(spark, d)), K.merge_errors(T.tool_errors(spark, d)))


@query("f11_merge_tools", "SELECT name, description, docs_url, source_file, category, CAST(confidence AS DOUBLE) AS confidence, merged, array_to_string(commands, '|') AS commands, array_to_string(signatures, '|') AS signatures, array_to_string(aliases, '|') AS aliases FROM tools")
def f11(spark, d):
    t = K.merge_tools(T.tool_definitions(spark, d))
    return t.withColumns({c: F.array_join(c, "|") for c in ("commands", "signatures", "aliases")})


@query("f11_merge_errors", "SELECT tool, code, id, category, fix, retriable FROM known_errors")
def f11b(spark, d):
    return K.merge_errors(T.tool_errors(spark, d)).select("tool", "code", "id", "category", "fix", "retriable")


_NAMED = lambda col, arr: f"len(list_filter({arr}, lambda p: CASE WHEN starts_with(p, 'regex:') THEN regexp_matches({col}, '(?i)' || substring(p, 7)) ELSE contains(lower({col}), lower(p)) END)) > 0"


def score_sql(col: str) -> str:
    low = f"lower({col})"
    return (
        f"CASE WHEN length(name) >= 3 AND contains({low}, name) AND regexp_matches({low}, '(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(name) || '(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 0.95 "
        f"WHEN contains({low}, name) OR len(list_filter(aliases, lambda a: contains({low}, lower(a)))) > 0 OR {_NAMED(col, 'commands')} THEN 0.9 WHEN {_NAMED(col, 'signatures')} THEN 0.8 END"
    )


cte("command_texts", f"SELECT text, count(*) AS n FROM (SELECT {strip('coalesce(' + ', '.join(extract('line', p) for p in C.COMMANDS_RUN) + ')')} AS text FROM log_lines) WHERE length(text) > 5 GROUP BY 1")
cte("error_texts", "SELECT line AS text, count(*) AS n FROM error_hits GROUP BY 1")


def error_texts(spark, d):
    """Distinct texts of error lines: equal lines are matched once."""
    return E.match_errors(T.log_lines(spark, d)).groupBy(F.col("line").alias("text")).agg(F.count("*").alias("n"))


@query("e05_identify_tool", f"SELECT name AS tool, CAST(score AS DOUBLE) AS score, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT n, name, {score_sql('text')} AS score FROM command_texts CROSS JOIN tools) WHERE score IS NOT NULL GROUP BY ALL")
def e05(spark, d):
    commands = C.commands_executed(T.log_lines(spark, d)).groupBy(F.col("command").alias("text")).agg(F.count("*").alias("n"))
    found = K.identify_tools(commands, K.merge_tools(T.tool_definitions(spark, d)))
    return found.groupBy("tool", "score").agg(F.sum("n").alias("lines"))


@query("e06_identify_tool_long", f"SELECT doc_id, name AS tool, CAST(max(score) AS DOUBLE) AS score FROM (SELECT doc_id, name, {score_sql('text')} AS score FROM documents CROSS JOIN tools) WHERE score IS NOT NULL GROUP BY ALL")
def e06(spark, d):
    return K.identify_tools_long(T.documents(spark, d), K.merge_tools(T.tool_definitions(spark, d)), "doc_id")


def match_sql(texts: str, col: str) -> str:
    return f"""SELECT t.*, e.tool, e.code, e.category, e.fix, e.retriable, round(least(e.confidence + CASE WHEN contains(lower({col}), lower(e.code)) THEN 0.1 ELSE 0 END, 1.0), 6) AS confidence FROM {texts} t JOIN known_errors e
  ON CASE WHEN is_regex THEN regexp_matches({col}, '(?i)' || CASE WHEN is_regex THEN pattern ELSE '' END) ELSE contains(lower({col}), lower(pattern)) END"""


cte("matched_errors", match_sql("error_texts", "text"))


@query("e07_match_error", "SELECT tool, code, CAST(confidence AS DOUBLE) AS confidence, count(*) AS texts, CAST(sum(n) AS BIGINT) AS lines FROM matched_errors GROUP BY ALL")
def e07(spark, d):
    found = K.match_errors(error_texts(spark, d), K.merge_errors(T.tool_errors(spark, d)))
    return found.groupBy("tool", "code", "confidence").agg(F.count("*").alias("texts"), F.sum("n").alias("lines"))


cte("build_text", "SELECT build_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM tail_rows GROUP BY 1")
cte("clip_tools", f"SELECT build_id, name, max(score) AS score FROM (SELECT build_id, name, {score_sql('text')} AS score FROM build_text CROSS JOIN tools) WHERE score IS NOT NULL GROUP BY ALL")
cte("clip_errors", match_sql("build_text", "t.text"))


@query(
    "e08_knowledge_for_log",
    """SELECT build_id, 'tool' AS kind, row_number() OVER (PARTITION BY build_id ORDER BY score DESC, name) AS rn, name, CAST(score AS DOUBLE) AS confidence FROM clip_tools QUALIFY rn <= 3
  UNION ALL SELECT build_id, 'error', row_number() OVER (PARTITION BY build_id ORDER BY confidence DESC, tool, code) AS rn, tool || '/' || code, CAST(confidence AS DOUBLE) FROM clip_errors QUALIFY rn <= 3""",
)
def e08(spark, d):
    lines = T.stored_lines(spark, d)
    keys = whole_keys(lines)
    text = S.tail_lines(lines).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    return K.knowledge_for_logs(dealt(text, keys, keys), K.merge_tools(T.tool_definitions(spark, d)), K.merge_errors(T.tool_errors(spark, d)), "build_id", at=keys)


_KW = lambda c: O.keywords(c, K.STOP_WORDS)
cte("fb_tokens", f"SELECT id, token, count(*) AS n FROM (SELECT id, unnest({_KW('error_snippet')}) AS token FROM feedback) GROUP BY ALL")
cte("doc_queries", "SELECT doc_id AS query_id, text, upper(lang) AS category, source AS stage, 'm' || (doc_id % 5) AS method FROM documents")
cte("q_tokens", f"SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest({_KW('text')}) AS token FROM doc_queries) GROUP BY ALL")


@query(
    "e09_find_similar",
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rn, id, score FROM (
    SELECT o.query_id, o.id, round(2.0 * common / (qs + cs) + CASE WHEN q.category = c.error_category THEN 0.3 ELSE 0 END + CASE WHEN q.stage = c.failed_stage THEN 0.2 ELSE 0 END + CASE WHEN q.method = c.failed_method THEN 0.2 ELSE 0 END, 6) AS score
    FROM (SELECT query_id, f.id, sum(least(q.n, f.n)) AS common FROM q_tokens q JOIN fb_tokens f ON f.token = q.token GROUP BY ALL) o
    JOIN doc_queries q ON q.query_id = o.query_id JOIN feedback c ON c.id = o.id
    JOIN (SELECT query_id, sum(n) AS qs FROM q_tokens GROUP BY 1) x ON x.query_id = o.query_id JOIN (SELECT id, sum(n) AS cs FROM fb_tokens GROUP BY 1) y ON y.id = o.id) QUALIFY rn <= 3""",
)
def e09(spark, d):
    queries = T.documents(spark, d).select(
        F.col("doc_id").alias("query_id"), "text", F.upper("lang").alias("category"),
        F.col("source").alias("stage"), F.concat(F.lit("m"), F.col("doc_id") % 5).alias("method"),
    )
    return K.find_similar(queries, T.feedback(spark, d))


@query("e10_keywords", f"SELECT token, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM fb_tokens GROUP BY 1")
def e10(spark, d):
    tokens = K.token_counts(T.feedback(spark, d), "id", "error_snippet")
    return tokens.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


# ---- export and restore -----------------------------------------------------------------------


def _json_sql(fields: str) -> str:
    return f"json_extract_string(value, '{fields}')"


def exported(spark, d):
    return R.full_examples(T.examples(spark, d).withColumn("job_name", F.concat(F.lit("job-"), F.col("id") % 7)))


_HEAD = f"{q(R.ASK)} || 'Job: job-' || (id % 7) || chr(10) || 'Error: ' || error_snippet"


@query("a06_openai_records", f"SELECT id, 3 AS messages, {q(R.SYSTEM_PROMPT)} AS system, {_HEAD} AS user, root_cause, CAST(confidence AS DOUBLE) AS confidence FROM examples")
def a06(spark, d):
    rec = exported(spark, d).select("id", F.from_json(R.openai_record(), R.MESSAGES).alias("r"))
    text = lambda i: F.get("r.messages", F.lit(i))["content"]
    v = F.from_json(text(2), R.VERDICT)
    return rec.select(
        "id", F.size("r.messages").alias("messages"), text(0).alias("system"), text(1).alias("user"),
        v["root_cause"].alias("root_cause"), v["confidence"].cast("double").alias("confidence"),
    )


@query("a07_anthropic_records", f"SELECT id, 'Human: ' || {_HEAD} || chr(10) || chr(10) || 'Provide root cause analysis in JSON format.' || chr(10) || chr(10) || 'Assistant: ' AS head, root_cause FROM examples")
def a07(spark, d):
    text = F.from_json(R.anthropic_record(), "struct<prompt:string>")["prompt"]
    cut = F.instr(text, "\n\nAssistant: ") + 12
    return exported(spark, d).select(
        "id", F.left(text, cut).alias("head"), F.from_json(F.substr(text, cut + 1), R.VERDICT)["root_cause"].alias("root_cause")
    )


@query("a08_csv_rows", "SELECT id, source, 'job-' || (id % 7) AS job_name, left(error_snippet, 500) AS error_snippet, left(root_cause, 500) AS root_cause, left(fix, 200) AS fix, category FROM examples")
def a08(spark, d):
    return R.csv_rows(exported(spark, d)).select("id", "source", "job_name", "error_snippet", "root_cause", "fix", "category")


@query("a10_export_feedback", f"SELECT id, {q(R.ASK)} || 'Job: ' || job_name || chr(10) || 'Stage: ' || failed_stage || chr(10) || 'Error: ' || error_snippet AS user, confirmed_root_cause AS root_cause FROM feedback WHERE was_correct AND error_snippet <> '' AND confirmed_root_cause <> ''")
def a10(spark, d):
    right = T.feedback(spark, d).filter("was_correct and error_snippet <> '' and confirmed_root_cause <> ''")
    ready = right.select("id", "job_name", "failed_stage", "error_snippet", F.col("confirmed_root_cause").alias("root_cause"), F.col("confirmed_fix").alias("fix"), F.col("error_category").alias("category"), F.lit(0.9).alias("confidence"))
    rec = R.full_examples(ready).select("id", F.from_json(R.openai_record(), R.MESSAGES).alias("r"))
    text = lambda i: F.get("r.messages", F.lit(i))["content"]
    return rec.select("id", text(1).alias("user"), F.from_json(text(2), R.VERDICT)["root_cause"].alias("root_cause"))


@query("i04_restore_examples", f"SELECT id AS line_id, CASE WHEN trim(error_snippet) = '' THEN 'no error text' WHEN id % 5 = 0 THEN 'prompt records are not supported' END AS error, CASE WHEN id % 5 <> 0 THEN 'job-' || (id % 7) ELSE '' END AS job_name, CASE WHEN id % 5 <> 0 THEN trim(error_snippet) END AS error_snippet, CASE WHEN id % 5 <> 0 THEN trim(root_cause) END AS root_cause, CASE WHEN id % 5 <> 0 THEN CAST(confidence AS DOUBLE) ELSE 0.9 END AS confidence FROM examples")
def i04(spark, d):
    ex = exported(spark, d)
    value = F.when(F.col("id") % 5 == 0, R.anthropic_record()).otherwise(R.openai_record())
    return R.restore_examples(ex.select(F.col("id").alias("line_id"), value.alias("value"))).select(
        "line_id", "error", "job_name", "error_snippet", "root_cause", "confidence"
    )


@query("a04_import_report", "SELECT id AS line_id, 'prompt records are not supported' AS error FROM examples WHERE id % 5 = 0")
def a04(spark, d):
    ex = exported(spark, d)
    value = F.when(F.col("id") % 5 == 0, R.anthropic_record()).otherwise(R.openai_record())
    return R.import_report(R.restore_examples(ex.select(F.col("id").alias("line_id"), value.alias("value"))))
