"""Queries over the table of log lines: scans, profiles, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.scan import has_long
from faultline.operators import blame as BL, classify as C, errors as E, lines as L
from faultline.plans import oracle as O
from faultline.plans.oracle import any_hit, cte, extract, first_match, first_number, hit, q, severity, strip, tool_name
from faultline.plans.registry import query
from faultline.rules import errors as RE, shell
from faultline.session import checkpointed
from faultline.sources import tables as T

PREFIX = "flow"

# ---- shared SQL -------------------------------------------------------------------------------

_T = strip("line")
_REST = strip(f"substring({_T}, 11)")
cte(
    "marked",
    f"""SELECT *, CASE WHEN starts_with(t, '[Pipeline]') THEN CASE
    WHEN starts_with(rest, 'stage') OR starts_with(rest, '{{ (') THEN 'pipeline_stage'
    WHEN rest = 'echo' THEN 'pipeline_echo' WHEN rest = 'sh' THEN 'pipeline_sh'
    WHEN starts_with(rest, '//') AND list_contains({O.values(shell.WRAPPER_BLOCKS)}, {strip("substring(rest, 3)")}) THEN 'block_end'
    WHEN list_contains({O.values(shell.WRAPPER_BLOCKS)}, rest) THEN 'block_start' ELSE 'pipeline_step' END END AS marker
  FROM (SELECT build_id, line_no, line, {_T} AS t, {_REST} AS rest FROM log_lines)""",
)


def typed_sql(marked: str) -> str:
    return f"""SELECT build_id, line_no, line, in_sh, CASE WHEN marker IS NOT NULL THEN marker
    WHEN before = 'pipeline_echo' THEN 'echo_output'
    WHEN in_sh THEN CASE WHEN {hit("t", shell.TRACED_COMMAND)} THEN 'shell_command' ELSE 'shell_output' END
    WHEN {hit("t", shell.DOLLAR_COMMAND)} THEN 'shell_command' ELSE 'other' END AS line_type
  FROM (SELECT *, coalesce(last_value(CASE marker WHEN 'pipeline_sh' THEN true WHEN 'pipeline_step' THEN false
      WHEN 'pipeline_stage' THEN false WHEN 'pipeline_echo' THEN false END IGNORE NULLS) OVER w, false) AS in_sh,
      lag(coalesce(marker, '')) OVER (PARTITION BY build_id ORDER BY line_no) AS before
    FROM {marked} WINDOW w AS (PARTITION BY build_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


cte("typed", typed_sql("marked"))
_CONT = extract(_T, shell.CONTINUATION)
_CONT_OK = f"list_contains({O.values(shell.KNOWN_COMMANDS)}, lower(string_split(regexp_extract({_CONT}, '^(\\S+)', 1), '/')[-1]))"
SHELL_CMD = extract(_T, shell.TRACED_COMMAND)
CONT_CMD = f"CASE WHEN {_CONT_OK} THEN {_CONT} END"
cte(
    "owned",
    f"""SELECT *, last_value(CASE WHEN command IS NOT NULL THEN line_no WHEN line_type IN ('pipeline_step','pipeline_stage','pipeline_echo') THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY build_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner
  FROM (SELECT *, CASE WHEN line_type = 'shell_command' THEN {SHELL_CMD} WHEN line_type = 'other' THEN coalesce({SHELL_CMD}, {CONT_CMD}) END AS command FROM typed)""",
)
cte(
    "outputs",
    f"""SELECT build_id, owner AS cmd_line, line_no, {_T} AS output, row_number() OVER (PARTITION BY build_id, owner ORDER BY line_no) AS out_no
  FROM owned WHERE line_type = 'shell_output' AND owner > 0""",
)
_SIGNS = " OR ".join(f"contains(lower(output), {q(s)})" for s in shell.BLAME_SIGNALS)
_FINAL = " OR ".join(f"contains(output, {q(s)})" for s in shell.FINAL_EXIT_SIGNALS)
cte(
    "out_facts",
    f"""SELECT build_id, cmd_line, count(*) AS n_out, arg_min(code, out_no) FILTER (code IS NOT NULL) AS exit_code, count(*) FILTER (sign) AS signals,
    max(out_no) FILTER (exit_line) AS exit_line_at, bool_or(failed) AS output_failed, bool_or(final_sign) AS final_sign
  FROM (SELECT *, {first_number("output", tuple(reversed(shell.EXIT_CODES)))} AS code, ({_SIGNS}) AS sign, {hit("output", shell.EXIT_LINE)} AS exit_line,
    {any_hit("output", shell.OUTPUT_FAILURE)} AS failed, ({_FINAL}) AS final_sign FROM outputs) GROUP BY ALL""",
)
_TOOL_CMD = strip("coalesce(" + ", ".join(extract("line", "(?i)" + p) for _, p in shell.TOOL_LINES) + ")")
cte("tool_heads", f"SELECT build_id, line_no AS cmd_line, {_TOOL_CMD} AS command, {first_match('line', [(p, t) for t, p in shell.TOOL_LINES], True)} AS tool FROM owned WHERE line_type = 'other' AND command IS NULL")
cte(
    "tool_rows",
    f"""SELECT h.build_id, cmd_line, h.command, tool, arg_min(code, l.line_no) AS exit_code FROM tool_heads h
  LEFT JOIN (SELECT build_id, line_no, {first_number("line", shell.EXIT_CODES)} AS code FROM log_lines) l
    ON l.build_id = h.build_id AND l.line_no BETWEEN cmd_line + 1 AND cmd_line + 10 AND code IS NOT NULL
  WHERE tool IS NOT NULL GROUP BY ALL""",
)
cte(
    "invocations",
    f"""SELECT o.build_id, o.line_no AS cmd_line, command, {tool_name("command")} AS tool, exit_code, coalesce(n_out, 0) AS n_out, coalesce(signals, 0) AS signals,
    exit_line_at, coalesce(output_failed, false) AS output_failed, coalesce(final_sign, false) AS final_sign, 'shell' AS form
  FROM owned o LEFT JOIN out_facts f ON f.build_id = o.build_id AND f.cmd_line = o.line_no WHERE command IS NOT NULL
  UNION ALL SELECT build_id, cmd_line, command, tool, exit_code, 0, 0, NULL, false, false, 'tool' FROM tool_rows""",
)
_UPTO = "OVER (PARTITION BY build_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
cte(
    "placed",
    f"""SELECT build_id, line_no, line, coalesce(last_value({extract("line", C.STAGE_LABEL)} IGNORE NULLS) {_UPTO},
    last_value({extract("line", C.STAGE_CALL)} IGNORE NULLS) {_UPTO}) AS stage,
    coalesce({", ".join(f"last_value({extract('line', p)} IGNORE NULLS) {_UPTO}" for p in C.NODE_FORMS)}) AS node FROM log_lines""",
)


def label_sql(fragment: str) -> str:
    t = strip(fragment)
    inner = strip(f"regexp_extract({t}, '\\((.*)\\)', 1)")
    return (
        f"CASE WHEN contains({t}, '{{') AND regexp_matches({t}, '\\(.*\\)') AND {inner} <> '' THEN {inner} "
        f"WHEN starts_with({t}, '(') AND ends_with({t}, ')') AND length({t}) >= 2 THEN {strip(f'''regexp_extract({t}, '^\\((.*)\\)$', 1)''')} ELSE {t} END"
    )


_LEG = f"regexp_extract({strip('tail')}, {q(C.LEGACY_STAGE)}, 1)"
_PREST = strip(f"regexp_extract({strip('tail')}, '(?i)^\\[Pipeline\\]\\s*(.*)$', 1)")
cte(
    "pipeline_marks",
    f"""SELECT build_id, line_no, tail, {hit("tail", C.STAGE_HEADER)} AS is_header, {hit("tail", C.STAGE_END)} AS is_end,
    CASE WHEN {_PREST} <> '' AND NOT starts_with({_PREST}, '//') AND NOT list_contains({O.values(C.NOT_A_LABEL)}, lower(regexp_extract({_PREST}, '^(\\S+)', 1)))
      THEN nullif(CASE WHEN {hit(strip("tail"), C.LEGACY_STAGE)} THEN {label_sql(_LEG)} ELSE {label_sql(_PREST)} END, '') END AS label,
    CASE WHEN {hit(strip("tail"), C.LEGACY_STAGE)} THEN nullif({label_sql(_LEG)}, '') END AS legacy
  FROM (SELECT build_id, line_no, rtrim(substring(line, instr(line, '[Pipeline]'))) AS tail FROM log_lines WHERE contains(line, '[Pipeline]'))""",
)
cte(
    "stage_marks",
    """SELECT build_id, line_no, arg_min(label, pt) AS stage, 'declared' AS form FROM (
    SELECT h.build_id, h.line_no, n.line_no AS pt, n.label FROM pipeline_marks h JOIN pipeline_marks n
      ON n.build_id = h.build_id AND n.line_no BETWEEN h.line_no + 1 AND h.line_no + 7
    WHERE h.is_header AND n.label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pipeline_marks b WHERE b.build_id = h.build_id
      AND b.line_no > h.line_no AND b.line_no <= n.line_no AND (b.is_header OR b.is_end))) GROUP BY build_id, line_no
  UNION ALL SELECT build_id, line_no, legacy, 'legacy' FROM (
    SELECT *, coalesce(lag(is_header) OVER (PARTITION BY build_id ORDER BY line_no), false) AS after_header FROM pipeline_marks)
    WHERE legacy IS NOT NULL AND NOT is_header AND NOT after_header""",
)
cte("stage_last", "SELECT build_id, arg_max(stage, line_no) AS last_stage, max(line_no) AS last_stage_line FROM stage_marks GROUP BY 1")
cte(
    "focus_facts",
    "SELECT n.build_id, n_lines, last_stage, coalesce(last_stage_line, greatest(n_lines - 499, 1)) AS focus_from, coalesce(last_stage_line, greatest(n_lines - 199, 1)) AS focus200 "
    "FROM (SELECT build_id, max(line_no) AS n_lines FROM log_lines GROUP BY 1) n LEFT JOIN stage_last s ON s.build_id = n.build_id",
)

# ---- scans ------------------------------------------------------------------------------------


@query(
    "a01_explode_lines",
    """SELECT doc_id, CAST(i AS BIGINT) AS line_no, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""",
)
def a01(spark, d):
    return L.explode_lines(T.documents(spark, d), "doc_id")


@query("a02_clip_tail", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN right(text, 2000) ELSE text END AS text FROM documents")
def a02(spark, d):
    return L.clip_tail(T.documents(spark, d).select("doc_id", "text"), limit=2000)


# ---- profiles ---------------------------------------------------------------------------------


@query("b01_severity_profile", f"SELECT build_id, stage, {severity('line')} AS severity, count(*) AS n FROM placed GROUP BY ALL")
def b01(spark, d):
    return L.severity_profile(T.stored_lines(spark, d))


_NOISE = f"({any_hit('line', shell.NOISE_LINES)} OR {hit('line', '^WARN')})"


@query(
    "b02_noise_report",
    f"SELECT build_id, count(*) FILTER (NOT {_NOISE}) AS kept, count(*) FILTER ({_NOISE}) AS dropped, "
    f"round(count(*) FILTER ({_NOISE}) / count(*), 6) AS ratio FROM log_lines GROUP BY 1",
)
def b02(spark, d):
    return L.noise_report(T.log_lines(spark, d), "^WARN")


_STAMP = "coalesce(" + ", ".join(extract("line", p) for p in L.CLOCK_FORMS) + ")"
_PART = lambda i: f"CAST(regexp_extract({_STAMP}, '(\\d+):(\\d{{2}}):(\\d{{2}})$', {i}) AS BIGINT)"


@query(
    "b03_silent_gaps",
    f"""SELECT build_id, sec - before_sec AS gap, before_line, line_no, row_number() OVER (PARTITION BY build_id ORDER BY sec - before_sec DESC, line_no) AS rn
  FROM (SELECT *, lag(sec) OVER w AS before_sec, lag(line_no) OVER w AS before_line FROM (
    SELECT build_id, line_no, {_PART(1)} * 3600 + {_PART(2)} * 60 + {_PART(3)} AS sec FROM log_lines WHERE {_STAMP} IS NOT NULL)
    WINDOW w AS (PARTITION BY build_id ORDER BY line_no)) WHERE before_line IS NOT NULL QUALIFY rn <= 3""",
)
def b03(spark, d):
    return L.silent_gaps(T.stored_lines(spark, d))


@query(
    "b04_command_usage",
    f"SELECT tool, count(DISTINCT build_id) AS builds, count(*) AS runs FROM (SELECT build_id, {tool_name('c')} AS tool FROM "
    f"(SELECT build_id, coalesce({SHELL_CMD}, {CONT_CMD}) AS c FROM log_lines)) WHERE tool IS NOT NULL GROUP BY 1",
)
def b04(spark, d):
    return L.command_usage(T.log_lines(spark, d))


@query("b05_exit_code_profile", "SELECT tool, exit_code, count(*) AS n FROM invocations WHERE exit_code IS NOT NULL GROUP BY ALL")
def b05(spark, d):
    return L.exit_code_profile(C.invocations(T.stored_lines(spark, d), cut=checkpointed))


@query("b06_output_failure_rate", "SELECT tool, count(*) AS runs, round(avg(CAST(output_failed AS DOUBLE)), 6) AS rate FROM invocations GROUP BY 1")
def b06(spark, d):
    return L.output_failure_rate(C.invocations(T.stored_lines(spark, d), cut=checkpointed))


cte(
    "api_answers",
    f"""SELECT build_id, line_no, kind, value FROM (SELECT build_id, line_no, {first_match("line", L.API_FORMS)} AS kind,
    coalesce({", ".join(extract("line", p) for p, _ in L.API_FORMS)}) AS value FROM log_lines) WHERE kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY line_no) <= 5""",
)
API_BAD = "(kind IN ('json_error','api_error') OR (kind IN ('http_status','json_status') AND try_cast(value AS INTEGER) >= 400))"


@query(
    "b07_api_failures",
    f"""SELECT a.build_id, a.line_no, kind, value, left(string_agg(line, chr(10) ORDER BY l.line_no), 500) AS context FROM (
    SELECT * FROM api_answers WHERE {API_BAD} QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY line_no DESC) <= 3) a
  JOIN log_lines l ON l.build_id = a.build_id AND l.line_no BETWEEN a.line_no - 3 AND a.line_no + 2 GROUP BY ALL""",
)
def b07(spark, d):
    return L.api_failures(T.log_lines(spark, d))


@query("b07_api_answers_by_value", "SELECT kind, value, count(*) AS n FROM api_answers GROUP BY ALL")
def b07_counts(spark, d):
    return L.api_answers(T.log_lines(spark, d)).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query(
    "b10_exception_profile",
    f"""SELECT exception, count(*) AS n, min(message) AS sample FROM (SELECT {extract("line", r"(\w+Exception|\w+Error):")} AS exception,
    {strip("regexp_replace(" + strip(r"regexp_extract(line, '(?:\w+Exception|\w+Error):(.*)$', 1)") + ", '^:+', '')")} AS message FROM log_lines) WHERE exception IS NOT NULL GROUP BY 1""",
)
def b10(spark, d):
    return L.exception_profile(T.log_lines(spark, d))


_FIN = extract(_T, C.METHOD_FINISH)


@query(
    "b11_method_durations",
    f"""SELECT method, count(*) AS runs, round(avg(s), 6) AS avg_s, round(quantile_cont(s, 0.95), 6) AS p95_s, max(CASE WHEN contains(method, ':') OR contains(method, '.') THEN regexp_extract(method, '^([^:.]*)', 1) ELSE method END) AS file
  FROM (SELECT {O.method_key(_FIN)} AS method, CAST(regexp_extract(line, ':time-elapsed-seconds:(\\d+)', 1) AS BIGINT) AS s FROM log_lines WHERE {_FIN} IS NOT NULL) GROUP BY 1""",
)
def b11(spark, d):
    return L.method_durations(T.log_lines(spark, d))


_JOB = "array_to_string(list_filter(string_split(src, '/'), lambda x: x <> '' AND x <> 'job' AND x <> 'console' AND NOT regexp_matches(x, '^\\d+$')), '/')"


@query("b12_job_failures", f"SELECT {_JOB} AS job, count(*) AS failures FROM failure_events WHERE contains(raw, 'Finished: FAILURE') GROUP BY 1")
def b12(spark, d):
    return L.job_failures(T.failure_events(spark, d))


@query(
    "b13_clip_corpus",
    "SELECT source, count(*) AS docs, count(*) FILTER (length(text) > 3000) AS cut, CAST(sum(length(CASE WHEN length(text) > 3000 THEN "
    "left(text, 1500) || chr(10) || '...' || chr(10) || right(text, 1500) ELSE text END)) AS BIGINT) AS chars FROM documents GROUP BY 1",
)
def b13(spark, d):
    return L.clip_corpus(T.documents(spark, d), 3000)


_KNOWN = " UNION ALL ".join(
    "SELECT build_id, line_no, {} AS variable, {} AS value FROM log_lines".format(q(v), extract("line", rf"\b{v}[=:]\s*['\"]?([^'\"\s\n]+)"))
    for v in L.KNOWN_VARIABLES
)
cte("env_start", "SELECT build_id, min(line_no) FILTER (contains(line, 'printenv')) AS printed FROM log_lines GROUP BY 1")
cte("env_after", "SELECT l.build_id, l.line_no, line, regexp_matches(line, '^[\\w]+=') AS is_env FROM log_lines l JOIN env_start s ON s.build_id = l.build_id AND l.line_no > printed")
cte("env_stop", "SELECT build_id, min(line_no) FILTER (NOT is_env) AS stop FROM env_after GROUP BY 1")
cte(
    "env_all",
    f"""SELECT a.build_id, a.line_no, 0 AS tier, {strip("regexp_extract(line, '^(\\w+)=', 1)")} AS variable, left({strip("regexp_extract(line, '^\\w+=(.*)$', 1)")}, 100) AS value
  FROM env_after a JOIN env_stop e ON e.build_id = a.build_id WHERE stop IS NULL OR a.line_no < stop
  UNION ALL SELECT build_id, min(line_no), 1, variable, arg_min(value, line_no) FROM ({_KNOWN}) WHERE value IS NOT NULL GROUP BY build_id, variable""",
)
cte(
    "env_settings",
    f"SELECT build_id, variable, CASE WHEN regexp_matches(lower(variable), {q(L.SECRET_NAMES)}) THEN '[REDACTED]' ELSE arg_max(value, tier * 1000000 + line_no) END AS value FROM env_all GROUP BY build_id, variable",
)


@query("b14_env_settings", "SELECT build_id, variable, value FROM env_settings")
def b14(spark, d):
    return L.env_settings(T.log_lines(spark, d))


@query("b14_env_inventory", "SELECT variable, count(*) AS builds, count(*) FILTER (value = '[REDACTED]') AS masked FROM env_settings GROUP BY 1")
def b14b(spark, d):
    return L.env_inventory(T.log_lines(spark, d))


@query(
    "b15_grep_context",
    """SELECT h.build_id, h.line_no, string_agg(CASE WHEN l.line_no = h.line_no THEN '>>> [' ELSE '    [' END || l.line_no || '] ' || l.line, chr(10) ORDER BY l.line_no) AS snippet
  FROM (SELECT build_id, line_no FROM log_lines WHERE regexp_matches(line, '(?i)timed out|refused') QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY line_no) <= 10) h
  JOIN log_lines l ON l.build_id = h.build_id AND l.line_no BETWEEN h.line_no - 3 AND h.line_no + 3 GROUP BY ALL""",
)
def b15(spark, d):
    return L.grep_context(T.log_lines(spark, d), "timed out|refused")


@query(
    "b16_sample_lines",
    "SELECT build_id, line_no, line FROM sized WHERE line_no > n_lines - 5",
)
def b16(spark, d):
    return C.sample_lines(T.log_lines(spark, d), 5, from_end=True)


cte("wanted", "SELECT o_orderkey AS build_id, unnest(['connection refused', 'step' || (o_orderkey % 50), 'LABEL_' || (o_orderkey % 50), 'no such thing']) AS target FROM orders")


def wanted(spark, d):
    """What a model asked to see more of, per build."""
    key = F.col("o_orderkey")
    names = F.array(
        F.lit("connection refused"), F.concat(F.lit("step"), key % 50), F.concat(F.lit("LABEL_"), key % 50), F.lit("no such thing")
    )
    return T.read(spark, d, "orders").select(key.alias("build_id"), F.explode(names).alias("target"))


@query(
    "b17_around_targets",
    """SELECT f.build_id, target, pt AS "at", l.line_no, line AS near_line FROM (
    SELECT w.build_id, target, min(line_no) AS pt FROM wanted w JOIN log_lines l ON l.build_id = w.build_id AND contains(lower(line), lower(target)) GROUP BY ALL) f
  JOIN log_lines l ON l.build_id = f.build_id AND l.line_no BETWEEN pt - 10 AND pt + 9""",
)
def b17(spark, d):
    return L.around_targets(wanted(spark, d), T.log_lines(spark, d))


@query(
    "b18_setter_lines",
    """SELECT w.build_id, target, line_no, line FROM wanted w JOIN log_lines l ON l.build_id = w.build_id AND contains(lower(line), lower(target))
  AND regexp_matches(line, '(?i)(?:' || regexp_escape(target) || '\\s*=|--' || regexp_escape(target) || '|-D' || regexp_escape(target) || '|export\\s+' || regexp_escape(target) || ')')""",
)
def b18(spark, d):
    return L.setter_lines(wanted(spark, d), T.log_lines(spark, d))


# ---- classification ---------------------------------------------------------------------------


@query("c01_classify_markers", "SELECT build_id, coalesce(marker, 'none') AS marker, count(*) AS n FROM marked GROUP BY ALL")
def c01(spark, d):
    marked = C.classify_markers(T.log_lines(spark, d))
    return marked.groupBy("build_id", F.coalesce("marker", F.lit("none")).alias("marker")).agg(F.count("*").alias("n"))


@query("c02_in_sh_block", "SELECT build_id, line_no FROM typed WHERE in_sh")
def c02(spark, d):
    return C.typed_lines(T.stored_lines(spark, d)).filter("in_sh").select("build_id", "line_no")


@query("c03_classify_stateful", "SELECT build_id, line_no, line_type FROM typed")
def c03(spark, d):
    return C.typed_lines(T.stored_lines(spark, d)).select("build_id", "line_no", "line_type")


@query("c04_stage_markers", "SELECT build_id, line_no, stage, form FROM stage_marks")
def c04(spark, d):
    return C.stage_markers(T.stored_lines(spark, d))


@query(
    "c05_stage_label",
    f"SELECT label, count(*) AS n FROM pipeline_marks WHERE label IS NOT NULL GROUP BY 1",
)
def c05(spark, d):
    tail = F.rtrim(F.substr(F.col("line"), F.instr("line", "[Pipeline]")))
    marks = T.log_lines(spark, d).filter(F.col("line").contains("[Pipeline]"))
    return C.with_label(marks.select(tail.alias("tail"))).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query(
    "c06_stage_sequence",
    """SELECT build_id, row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS ord, stage, line_no FROM (
    SELECT *, lag(stage) OVER (PARTITION BY build_id ORDER BY line_no) AS prev FROM stage_marks) WHERE form = 'declared' OR prev IS NULL OR prev <> stage""",
)
def c06(spark, d):
    lines = T.stored_lines(spark, d)
    return C.stage_sequence(C.stage_markers(lines), has_long(lines))


@query("c07_stage_of_line", "SELECT build_id, line_no, stage FROM placed")
def c07(spark, d):
    return C.place_lines(T.stored_lines(spark, d)).select("build_id", "line_no", "stage")


@query("c08_node_of_line", "SELECT build_id, line_no, node FROM placed WHERE node IS NOT NULL")
def c08(spark, d):
    return C.place_lines(T.stored_lines(spark, d)).filter("node is not null").select("build_id", "line_no", "node")


_CALLED = (
    r"coalesce(CASE WHEN starts_with(regexp_extract(line, '\d{2}:\d{2}:\d{2}\s+\w+:\s*(.*)$', 1), regexp_extract(line, '\d{2}:\d{2}:\d{2}\s+(\w+):', 1)) "
    r"THEN nullif(regexp_extract(line, '\d{2}:\d{2}:\d{2}\s+(\w+):', 1), '') END, nullif(regexp_extract(line, '\[(\w+)\]\s*Starting', 1), ''))"
)
cte(
    "spans",
    f"""SELECT build_id, start_line, max(stage) AS stage, max(line_no) AS end_line, count(method) AS methods, arg_max(method, line_no) FILTER (method IS NOT NULL) AS last_method
  FROM (SELECT *, CASE WHEN stage IS NULL THEN {_CALLED} END AS method, max(CASE WHEN stage IS NOT NULL THEN line_no END) {_UPTO} AS start_line
    FROM (SELECT *, {extract("line", C.STAGE_LABEL)} AS stage FROM log_lines)) WHERE start_line IS NOT NULL GROUP BY build_id, start_line""",
)


@query("c09_stage_spans", "SELECT build_id, start_line, stage, end_line, methods, last_method FROM spans")
def c09(spark, d):
    return C.stage_spans(T.stored_lines(spark, d))


@query(
    "c10_failed_stage",
    """SELECT s.build_id, arg_max(stage, o) AS failed_stage, arg_max(start_line, o) AS start_line, arg_max(m, o) FILTER (o >= 1e9) AS failed_method, bool_or(inside) AS contains_error
  FROM (SELECT s.*, coalesce(error_line BETWEEN start_line AND end_line, false) AS inside, start_line + CASE WHEN error_line BETWEEN start_line AND end_line THEN 1000000000 ELSE 0 END AS o, last_method AS m
    FROM spans s LEFT JOIN (SELECT build_id, max(line_no) AS error_line FROM log_lines WHERE regexp_matches(lower(line), 'error|exception|failed|failure')
      AND NOT contains(lower(line), 'error=') AND NOT contains(lower(line), 'onerror') GROUP BY 1) e ON e.build_id = s.build_id) s GROUP BY 1""",
)
def c10(spark, d):
    return C.failed_stage(T.stored_lines(spark, d))


@query(
    "c11_failed_stage_by_form",
    "SELECT build_id, coalesce(" + ", ".join(f"arg_max(f{i}, line_no) FILTER (f{i} IS NOT NULL)" for i in range(4)) + ") AS stage FROM (SELECT build_id, line_no, "
    + ", ".join(f"{extract('line', p)} AS f{i}" for i, p in enumerate(C.FAILED_STAGE_FORMS)) + " FROM log_lines) GROUP BY 1 HAVING stage IS NOT NULL",
)
def c11(spark, d):
    return C.failed_stage_by_form(T.log_lines(spark, d))


@query("c12_focus_section", "SELECT l.build_id, line_no, line FROM log_lines l JOIN focus_facts f ON f.build_id = l.build_id WHERE line_no >= focus_from")
def c12(spark, d):
    return C.focus_section(T.stored_lines(spark, d)).select("build_id", "line_no", "line")


_REP = r"^\d{2}:\d{2}:\d{2}\s+(\S[^:]*?):\s*(.*?)\s*$"
_START = f"CASE WHEN regexp_extract({_T}, {q(_REP)}, 1) = regexp_extract({_T}, {q(_REP)}, 2) THEN nullif({strip(f'regexp_extract({_T}, {q(_REP)}, 1)')}, '') END"


def events_sql(started: str) -> str:
    return f"""SELECT build_id, line_no, CASE WHEN started IS NOT NULL THEN 'start' ELSE 'finish' END AS event, coalesce(started, finished) AS method,
    {O.method_key("coalesce(started, finished)")} AS method_key FROM (SELECT build_id, line_no, {started} AS started, {strip(_FIN)} AS finished FROM log_lines)
  WHERE started IS NOT NULL OR finished IS NOT NULL"""


cte("method_events", events_sql(_START))
_PSTART = strip(extract(_T, rf"(?i){PREFIX}:\s*(.+)$"))
cte("flow_events", events_sql(f"CASE WHEN NOT starts_with({_PSTART}, 'Finished') THEN {_PSTART} END"))


@query("c13_method_events", "SELECT build_id, line_no, event, method, method_key FROM method_events")
def c13(spark, d):
    return C.method_events(T.log_lines(spark, d))


def states_sql(events: str) -> str:
    return f"SELECT *, EXISTS (SELECT 1 FROM {events} f WHERE f.event = 'finish' AND f.build_id = s.build_id AND f.method_key = s.method_key) AS finished FROM {events} s WHERE event = 'start'"


cte("method_states", states_sql("method_events"))
cte("flow_states", states_sql("flow_events"))


@query("c14_active_methods", "SELECT build_id, line_no, method FROM flow_states WHERE NOT finished")
def c14a(spark, d):
    return C.method_states(C.method_events(T.log_lines(spark, d), PREFIX)).filter("not finished").select("build_id", "line_no", "method")


def failed_sql(states: str) -> str:
    return f"SELECT build_id, arg_max(method, line_no + CASE WHEN finished THEN 0 ELSE 1000000000 END) AS failed_method, count(*) FILTER (NOT finished) AS active, count(*) AS started FROM {states} GROUP BY 1"


@query("c14_failed_method", failed_sql("method_states"))
def c14b(spark, d):
    return C.failed_method(C.method_events(T.log_lines(spark, d)))


@query("c15_invocations", "SELECT build_id, cmd_line, command, tool, exit_code, n_out, output_failed FROM invocations WHERE form = 'shell'")
def c15(spark, d):
    return C.invocations(T.stored_lines(spark, d), cut=checkpointed).filter("form = 'shell'").select(
        "build_id", "cmd_line", "command", "tool", "exit_code", "n_out", "output_failed"
    )


@query("c16_known_tool_lines", "SELECT build_id, cmd_line, command, tool, exit_code FROM tool_rows")
def c16(spark, d):
    return C.known_tool_lines(C.command_lines(T.stored_lines(spark, d))).select("build_id", "cmd_line", "command", "tool", "exit_code")


cte("flow_failed", failed_sql("flow_states"))
cte(
    "flow_stop",
    f"SELECT l.build_id, failed_method, min(line_no) FILTER (contains(line, '{PREFIX}: Finished ' || failed_method) AND NOT (contains(line, '{PREFIX}: ' || failed_method) AND NOT contains(line, 'Finished'))) AS stop, max(line_no) AS n_lines FROM log_lines l JOIN flow_failed f ON f.build_id = l.build_id GROUP BY ALL",
)
cte(
    "flow_span",
    f"SELECT l.build_id, s.failed_method, max(line_no) AS start_line, coalesce(any_value(stop), any_value(n_lines)) AS end_line FROM log_lines l JOIN flow_stop s ON s.build_id = l.build_id AND (stop IS NULL OR line_no < stop) "
    f"WHERE contains(line, '{PREFIX}: ' || failed_method) AND NOT contains(line, 'Finished') GROUP BY ALL",
)
cte(
    "flow_marked",
    f"SELECT m.build_id, m.line_no, line, t, CASE WHEN contains(line, '{PREFIX}') THEN 'method_tag' ELSE marker END AS marker, failed_method FROM marked m JOIN flow_span f ON f.build_id = m.build_id AND m.line_no BETWEEN start_line AND end_line",
)
cte("flow_typed", typed_sql("flow_marked"))
cte(
    "flow_owned",
    f"""SELECT *, last_value(CASE WHEN line_type = 'shell_command' THEN line_no WHEN line_type IN ('pipeline_step','pipeline_stage') THEN 0 END IGNORE NULLS) {_UPTO} AS owner FROM flow_typed""",
)
cte(
    "flow_out",
    f"""SELECT build_id, owner AS cmd_line, arg_min(code, line_no) FILTER (code IS NOT NULL) AS exit_code, bool_or(failed) AS failed FROM (
    SELECT build_id, owner, line_no, {first_number(_T, shell.EXIT_CODES)} AS code, {any_hit(_T, shell.OUTPUT_FAILURE)} AS failed FROM flow_owned
    WHERE line_type = 'shell_output' AND owner > 0 QUALIFY row_number() OVER (PARTITION BY build_id, owner ORDER BY line_no) <= 30) GROUP BY ALL""",
)
cte(
    "flow_steps",
    f"""SELECT o.build_id, f.failed_method, o.line_no AS cmd_line, {SHELL_CMD} AS command, {tool_name(SHELL_CMD)} AS tool, exit_code,
    CASE WHEN exit_code = 0 THEN 'success' WHEN exit_code IS NOT NULL OR coalesce(failed, false) THEN 'failed' ELSE 'unknown' END AS status
  FROM flow_owned o JOIN flow_span f ON f.build_id = o.build_id LEFT JOIN flow_out x ON x.build_id = o.build_id AND x.cmd_line = o.line_no WHERE line_type = 'shell_command'""",
)


@query(
    "c17_method_trace",
    "SELECT *, CASE WHEN min(cmd_line) FILTER (status = 'failed') OVER (PARTITION BY build_id) IS NOT NULL THEN cmd_line = min(cmd_line) FILTER (status = 'failed') OVER (PARTITION BY build_id) END AS is_failure_point FROM flow_steps",
)
def c17(spark, d):
    return C.method_trace(T.stored_lines(spark, d), PREFIX)


_CTX_CMD = "coalesce(" + ", ".join(extract("line", p) for p in C.CONTEXT_COMMANDS) + ")"
cte("ctx_lines", f"SELECT build_id, line_no, line, {_CTX_CMD} AS command, ({any_hit('line', C.CONTEXT_COMMANDS[:12])} OR starts_with(line, '[Pipeline]')) AS stop, {_T} = '' AS blank FROM log_lines")
cte(
    "ctx_ends",
    """SELECT c.build_id, c.line_no, c.command, min(n.line_no) FILTER (NOT n.blank) AS text_at, min(n.line_no) FILTER (n.stop) AS stop_at,
    list(n.line_no) FILTER (n.blank) AS blanks FROM ctx_lines c JOIN ctx_lines n ON n.build_id = c.build_id AND n.line_no BETWEEN c.line_no + 1 AND c.line_no + 29
    WHERE c.command IS NOT NULL GROUP BY ALL""",
)
cte(
    "ctx_cands",
    """SELECT build_id, line_no, command, least(line_no + 30, coalesce(stop_at, line_no + 30), coalesce(list_min(list_filter(blanks, lambda b: b > text_at)), line_no + 30)) AS fin
  FROM ctx_ends WHERE text_at IS NOT NULL""",
)
cte(
    "ctx_chain",
    """SELECT build_id, line_no, fin, 1 AS n FROM (SELECT build_id, min(line_no) AS line_no, arg_min(fin, line_no) AS fin FROM ctx_cands WHERE fin > line_no + 1 AND EXISTS (SELECT 1 FROM ctx_ends e WHERE e.build_id = ctx_cands.build_id AND e.line_no = ctx_cands.line_no AND e.text_at < fin) GROUP BY 1)
  UNION ALL SELECT x.build_id, x.line_no, x.fin, n + 1 FROM (SELECT c.build_id, min(d.line_no) AS line_no, arg_min(d.fin, d.line_no) AS fin, any_value(n) AS n FROM ctx_chain c JOIN ctx_cands d
    ON d.build_id = c.build_id AND d.line_no >= c.fin JOIN ctx_ends e ON e.build_id = d.build_id AND e.line_no = d.line_no AND e.text_at < d.fin WHERE n < 10 GROUP BY c.build_id) x""",
)


@query(
    "c18_command_context",
    f"""SELECT build_id, line_no, left(command, 200) AS command, left(txt, 1000) AS output, {any_hit("txt", C.CONTEXT_ERRORS)} AS is_error FROM (
    SELECT c.build_id, c.line_no, d.command, string_agg(l.line, chr(10) ORDER BY l.line_no) AS txt FROM ctx_chain c JOIN ctx_cands d ON d.build_id = c.build_id AND d.line_no = c.line_no
    JOIN (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS r FROM ctx_lines WHERE NOT blank) l ON l.build_id = c.build_id AND l.line_no BETWEEN c.line_no + 1 AND c.fin - 1
    JOIN (SELECT build_id, line_no, row_number() OVER (PARTITION BY build_id ORDER BY line_no) AS r FROM ctx_lines WHERE NOT blank) h ON h.build_id = c.build_id AND h.line_no = c.line_no AND l.r - h.r <= 20 GROUP BY ALL)""",
)
def c18(spark, d):
    return BL.command_context(T.stored_lines(spark, d))


@query("c19_commands_executed", f"SELECT build_id, line_no, command FROM (SELECT build_id, line_no, {strip('coalesce(' + ', '.join(extract('line', p) for p in C.COMMANDS_RUN) + ')')} AS command FROM log_lines) WHERE length(command) > 5")
def c19(spark, d):
    return C.commands_executed(T.log_lines(spark, d))


@query("c27_stage_log", "SELECT build_id, line_no, line FROM placed WHERE stage = 'Deploy'")
def c27(spark, d):
    return C.place_lines(T.stored_lines(spark, d)).filter("stage = 'Deploy'").select("build_id", "line_no", "line")
