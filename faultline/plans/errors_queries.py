"""Queries on error lines, the primary line, blame and stack traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.scan import attach_facts
from faultline.operators import blame as BL, classify as C, errors as E, lines as L, traces as TR
from faultline.plans import lines_queries, oracle as O
from faultline.plans.oracle import any_hit, best_weight, cte, extract, first_match, hit, q, severity, strip
from faultline.plans.registry import query
from faultline.rules import errors as R, shell
from faultline.session import checkpointed
from faultline.sources import tables as T

_T = strip("line")

_HITS = "[" + ", ".join(
    f"CASE WHEN {any_hit('line', ps)} THEN {{'o': {i}, 'c': {q(c)}, 'p': {first_match('line', [(p, p) for p in ps])}}} END"
    for i, (c, ps) in enumerate(R.CATEGORY_PATTERNS.items())
) + "]"
cte("clean", f"SELECT * FROM log_lines WHERE NOT {any_hit('line', shell.NOISE_LINES)}")
cte(
    "error_hits",
    f"SELECT build_id, line_no, line, CAST(h.o AS BIGINT) AS cat_ord, h.c AS category, h.p AS pattern FROM (SELECT *, unnest({_HITS}) AS h FROM clean) WHERE h IS NOT NULL",
)
cte(
    "focus_errors",
    f"""SELECT e.* FROM error_hits e JOIN focus_facts f ON f.build_id = e.build_id AND e.line_no >= focus_from
    QUALIFY row_number() OVER (PARTITION BY e.build_id, category, {_T} ORDER BY e.line_no DESC) = 1""",
)
cte(
    "whole_errors",
    f"""SELECT e.* FROM error_hits e ANTI JOIN (SELECT build_id, category, {_T} AS key FROM focus_errors) f
      ON f.build_id = e.build_id AND f.category = e.category AND f.key = {strip("e.line")}
    QUALIFY row_number() OVER (PARTITION BY build_id, category, {_T} ORDER BY line_no) = 1""",
)
cte(
    "errors",
    f"""SELECT build_id, line_no, line, cat_ord, category, pattern, 'focus' AS origin, {severity("line")} AS severity, -line_no AS ord FROM focus_errors
  UNION ALL SELECT build_id, line_no, line, cat_ord, category, pattern, 'whole', {severity("line")}, line_no FROM whole_errors""",
)


@query("d01_match_errors", "SELECT build_id, line_no, category, pattern FROM error_hits")
def d01(spark, d):
    hits = E.match_errors(T.log_lines(spark, d))
    return hits.select("build_id", "line_no", "category", E.pattern_of(F.col("line"), F.col("category")).alias("pattern"))


@query(
    "d02_dedupe_errors",
    f"SELECT build_id, category, max(line_no) AS line_no FROM error_hits GROUP BY build_id, category, {_T}",
)
def d02(spark, d):
    return E.dedupe_errors(E.match_errors(T.log_lines(spark, d))).select("build_id", "category", "line_no")


@query("d03_errors_from_end", "SELECT build_id, category, line_no, pattern FROM focus_errors")
def d03(spark, d):
    lines = T.stored_lines(spark, d)
    found = E.errors_from_end(C.focus_section(lines, rows=lines.filter(E.may_match(F.col("line")))))
    return found.select("build_id", "category", "line_no", E.pattern_of(F.col("line"), F.col("category")).alias("pattern"))


@query("d04_errors_full_scan", "SELECT build_id, category, line_no, origin, severity FROM errors")
def d04(spark, d):
    return E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed).select("build_id", "category", "line_no", "origin", "severity")


@query(
    "d05_error_context",
    """SELECT e.build_id, e.line_no, category, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (l.line_no < e.line_no) AS before,
    string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (l.line_no > e.line_no) AS after
  FROM errors e JOIN log_lines l ON l.build_id = e.build_id AND l.line_no BETWEEN e.line_no - 10 AND e.line_no + 10 GROUP BY ALL""",
)
def d05(spark, d):
    lines = T.stored_lines(spark, d)
    points = E.parsed_errors(lines, cut=checkpointed).select("build_id", F.col("line_no").alias("at"), "category")
    near = E.context(points, lines, 10, 10)
    side = lambda keep: F.array_join(F.transform(F.filter("c", keep), lambda x: x["near_line"]), "\n")
    before, after = (lambda x: x["line_no"] < F.col("at")), (lambda x: x["line_no"] > F.col("at"))
    return near.select(
        "build_id", F.col("at").alias("line_no"), "category",
        F.when(F.exists("c", before), side(before)).alias("before"), F.when(F.exists("c", after), side(after)).alias("after"),
    )


_PRIO = "CASE category " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(R.CATEGORY_PRIORITY)) + " ELSE 99 END"
cte(
    "primary_category",
    f"""SELECT build_id, category AS primary_category, CAST(total AS BIGINT) AS errors FROM (SELECT *, sum(n) OVER (PARTITION BY build_id) AS total FROM (SELECT build_id, category, count(*) AS n FROM errors GROUP BY build_id, category))
  QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY n DESC, {_PRIO}) = 1""",
)


@query("d06_primary_category", "SELECT build_id, primary_category, errors FROM primary_category")
def d06(spark, d):
    return E.primary_category(E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed))


_SCM = best_weight("line", R.SCM_WEIGHTS, True)
cte(
    "scored",
    f"""SELECT build_id, line_no, line, n_lines, CASE WHEN {_T} = '' THEN 0 ELSE w + CASE WHEN scm >= 7 AND n_lines > 20 THEN least(scm, 10)
    + CASE WHEN (line_no - 1) / greatest(n_lines - 1, 1) < 0.35 THEN 4 ELSE 0 END ELSE 0 END END AS score, scm
  FROM (SELECT *, {best_weight("line", R.LINE_WEIGHTS, True)} AS w, {_SCM} AS scm FROM sized)""",
)


@query("d08_score_lines", "SELECT score, count(*) AS n, count(DISTINCT build_id) AS builds FROM scored WHERE score > 0 GROUP BY 1")
def d08(spark, d):
    lines = T.stored_lines(spark, d)
    scored = E.score_lines(attach_facts(lines, C.line_count(lines))).filter("score > 0")
    per = scored.groupBy("score", "build_id").agg(F.count("*").alias("n"))
    return per.groupBy("score").agg(F.sum("n").alias("n"), F.count("*").alias("builds"))


@query("d09_scm_score", "SELECT build_id, line_no, scm AS score FROM scored WHERE scm > 0")
def d09(spark, d):
    return T.log_lines(spark, d).withColumn("score", E.scm_weight(F.col("line"))).filter("score > 0").drop("line")


cte(
    "finder",
    """SELECT s.build_id, any_value(s.n_lines) AS n_lines, any_value(last_stage) AS last_stage,
    arg_max(line_no, score * 1000000 + line_no) FILTER (score > 0 AND line_no >= focus200) AS best, max(score) FILTER (score > 0 AND line_no >= focus200) AS score,
    max(line_no) FILTER (trim(line, ' ' || chr(9)) <> '') AS last FROM scored s JOIN focus_facts f ON f.build_id = s.build_id GROUP BY 1""",
)
cte(
    "finder_line",
    """SELECT f.build_id, f.n_lines, last_stage, coalesce(best, last) AS finder_line, line AS finder_text, coalesce(f.score, 0) AS score, best IS NOT NULL AS scored
  FROM finder f LEFT JOIN log_lines l ON l.build_id = f.build_id AND l.line_no = coalesce(best, last)""",
)


@query("d10_primary_line", "SELECT build_id, n_lines, last_stage, finder_line, finder_text, score, scored FROM finder_line")
def d10(spark, d):
    return E.primary_line(T.stored_lines(spark, d))


cte("first_error", "SELECT build_id, line_no AS parser_line, line AS parser_text, category AS parser_category, count(*) OVER (PARTITION BY build_id) AS n_errors FROM errors QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY ord, cat_ord) = 1")
cte(
    "judged",
    f"""SELECT *, scored AND pl IS NOT NULL AND scm >= 9 AND pl - 1 < n_lines // 3 AND finder_line - 1 >= (2 * n_lines) // 3 AS early,
    scored AND pl IS NOT NULL AND scm >= 7 AND pl < finder_line AND finder_line - pl > greatest(25, n_lines // 10) AS ahead, scored AND pl IS NOT NULL AS usable
  FROM (SELECT f.*, e.parser_line AS pl, e.parser_text, e.parser_category, e.n_errors, {best_weight("e.parser_text", R.SCM_WEIGHTS, True)} AS scm FROM finder_line f LEFT JOIN first_error e ON e.build_id = f.build_id)""",
)
cte(
    "chosen",
    """SELECT build_id, n_lines, last_stage, finder_line, pl AS parser_line, parser_category, coalesce(n_errors, 0) AS n_errors, CASE WHEN early OR ahead THEN pl ELSE finder_line END AS chosen_line,
    CASE WHEN early OR ahead THEN parser_text ELSE finder_text END AS chosen_text,
    CASE WHEN early THEN 'parser_early_scm' WHEN ahead THEN 'parser_precedes_tail' WHEN usable AND abs(pl - finder_line) > 2 THEN 'finder_with_note' ELSE 'finder' END AS chosen_source,
    CASE WHEN usable THEN NOT ahead AND abs(pl - finder_line) <= 2 ELSE true END AS aligned FROM judged""",
)


@query("d11_reconcile_primary", "SELECT build_id, finder_line, parser_line, chosen_line, chosen_text, chosen_source, aligned FROM chosen")
def d11(spark, d):
    return E.chosen_lines(T.stored_lines(spark, d), checkpointed).select(
        "build_id", "finder_line", "parser_line", "chosen_line", "chosen_text", "chosen_source", "aligned"
    )


def error_type_sql(c: str) -> str:
    return "coalesce(" + first_match(f"lower({c})", [("|".join(f"(?:{p})" for p in ps), t) for t, ps in R.ERROR_TYPES.items()]) + ", 'unknown')"


@query("d12_error_type", f"SELECT category, {error_type_sql('line')} AS error_type, count(*) AS n FROM errors GROUP BY ALL")
def d12(spark, d):
    errs = E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed).withColumn("error_type", E.error_type(F.col("line")))
    return errs.groupBy("category", "error_type").agg(F.count("*").alias("n"))


def ids_sql(c: str) -> str:
    found = " || ".join(f"regexp_extract_all({c}, {q(p)}, 1)" for p in (R.ID_QUOTED, *R.ID_AFTER_WORD, R.ID_CAPS))
    return f"list_sort(list_distinct(list_filter({found}, lambda x: length(x) > 1 AND NOT list_contains({O.values(R.ID_NOISE)}, upper(x)))))"


def deep_ids_sql(c: str) -> str:
    found = " || ".join([f"regexp_extract_all({c}, {q(p)}, 1)" for p in R.DEEP_IDS] + [f"regexp_extract_all({c}, {q(R.DEEP_OPTION)}, {g})" for g in (1, 2)])
    return f"list_sort(list_distinct(list_filter({found}, lambda x: length(x) >= 3 AND NOT list_contains({O.values(R.DEEP_ID_NOISE)}, lower(x)) AND NOT regexp_matches(x, '^\\d+$'))))"


@query(
    "d13_related_lines",
    f"""SELECT c.build_id, chosen_line, l.line_no, l.line, row_number() OVER (PARTITION BY c.build_id ORDER BY abs(l.line_no - chosen_line), l.line_no) AS rn
  FROM (SELECT *, {ids_sql("chosen_text")} AS ids FROM chosen) c JOIN log_lines l ON l.build_id = c.build_id AND l.line_no <> chosen_line
    AND len(list_filter(ids, lambda i: contains(l.line, i) OR contains(lower(l.line), lower(i)))) > 0 QUALIFY rn <= 10""",
)
def d13(spark, d):
    lines = T.stored_lines(spark, d)
    return E.related_lines(lines, E.chosen_lines(lines, checkpointed))


@query(
    "d14_focus_context",
    "SELECT c.build_id, c.chosen_line, l.line_no, l.line AS near_line FROM chosen c JOIN log_lines l ON l.build_id = c.build_id AND l.line_no BETWEEN chosen_line - 30 AND chosen_line + 15",
)
def d14(spark, d):
    lines = T.stored_lines(spark, d)
    points = E.chosen_lines(lines, checkpointed).select("build_id", F.col("chosen_line").alias("at"))
    return E.around_point(points, lines, 30, 15).withColumnRenamed("at", "chosen_line")


_LOW = "lower(line)"
DEEP = (
    f"greatest(0, CASE WHEN contains({_LOW}, 'exception') THEN 50 ELSE 0 END + CASE WHEN contains({_LOW}, 'error') AND NOT contains({_LOW}, 'error=') THEN 30 ELSE 0 END"
    f" + CASE WHEN contains({_LOW}, 'failed') THEN 25 ELSE 0 END + CASE WHEN contains({_LOW}, 'failure') THEN 25 ELSE 0 END"
    f" + CASE WHEN {hit('line', r'^\s*(Caused by|Exception|Error):')} THEN 40 ELSE 0 END + CASE WHEN {hit('line', r'\w+Exception:')} THEN 45 ELSE 0 END"
    f" + CASE WHEN {hit('line', r'\w+Error:')} THEN 40 ELSE 0 END - CASE WHEN starts_with({_T}, '#') THEN 50 ELSE 0 END"
    f" - CASE WHEN contains(line, 'WARN') AND NOT contains(line, 'ERROR') THEN 20 ELSE 0 END - CASE WHEN length({_T}) < 10 THEN 30 ELSE 0 END"
    " - CASE WHEN contains(line, 'at ') AND contains(line, '(') AND contains(line, ')') THEN 20 ELSE 0 END)"
)


@query("d15_deep_score", f"SELECT score, count(*) AS n FROM (SELECT {DEEP} AS score FROM log_lines) GROUP BY 1")
def d15(spark, d):
    return T.log_lines(spark, d).select(E.deep_score(F.col("line")).alias("score")).groupBy("score").agg(F.count("*").alias("n"))


cte(
    "deep_line",
    f"SELECT build_id, line_no, line, score, n_lines FROM (SELECT *, {DEEP} AS score FROM sized WHERE line_no > greatest(n_lines - 200, 0) + 1) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY score DESC, line_no DESC) = 1",
)


@query("d16_deep_primary_line", "SELECT build_id, line_no, line, score FROM deep_line")
def d16(spark, d):
    return E.deep_primary_line(T.log_lines(spark, d)).drop("n_lines")


_CTX = ", ".join(f"bool_or({any_hit('l.line', ps, True)}) AS c{i}" for i, (_, _, ps) in enumerate(R.DEEP_TYPES))
_SCORES = "[" + ", ".join(
    f"CASE WHEN {any_hit('x.line', ps, True)} THEN {{'s': -{b}, 'r': {i}, 't': {q(t + ':line')}}} WHEN c{i} THEN {{'s': -{b - 20}, 'r': {100 + i}, 't': {q(t + ':context')}}} END"
    for i, (t, b, ps) in enumerate(R.DEEP_TYPES)
) + "]"


@query(
    "d17_deep_types",
    f"""SELECT build_id, line_no, coalesce(string_split(f[1].t, ':')[1], 'UNKNOWN') AS error_type, coalesce(-f[1].s, 0) AS score, array_to_string(list_transform(f, lambda e: e.t), ',') AS evidence
  FROM (SELECT build_id, line_no, list_sort(list_filter({_SCORES}, lambda e: e IS NOT NULL)) AS f FROM (
    SELECT p.build_id, p.line_no, p.line, {_CTX} FROM deep_line p JOIN log_lines l ON l.build_id = p.build_id AND l.line_no BETWEEN p.line_no - 10 AND p.line_no + 4 GROUP BY ALL) x)""",
)
def d17(spark, d):
    lines = T.stored_lines(spark, d)
    return E.deep_types(E.deep_primary_line(lines), lines)


@query(
    "d18_trace_identifiers",
    f"""SELECT i.build_id, ident, min(line_no) FILTER (def) AS defined_at, arg_min(trim(line, ' ' || chr(9)), line_no) FILTER (def) AS definition, count(*) - CASE WHEN bool_or(def) THEN 1 ELSE 0 END AS uses
  FROM (SELECT i.build_id, ident, line_no, line, regexp_matches(line, regexp_escape(ident) || '\\s*=') OR regexp_matches(line, '--' || regexp_escape(ident) || '[=\\s]')
      OR regexp_matches(line, 'export\\s+' || regexp_escape(ident)) OR regexp_matches(line, regexp_escape(ident) || ':\\s') AS def
    FROM (SELECT build_id, unnest({deep_ids_sql("line")}[1:5]) AS ident FROM deep_line) i JOIN log_lines l ON l.build_id = i.build_id AND contains(line, ident)) i GROUP BY ALL""",
)
def d18(spark, d):
    lines = T.stored_lines(spark, d)
    return E.trace_identifiers(lines, E.deep_primary_line(lines))


cte(
    "near_frames",
    f"""SELECT p.build_id, p.line_no AS pt, l.line_no, {strip("l.line")} AS t, ({hit(strip("l.line"), TR.FULL_FRAME)} OR {hit(strip("l.line"), TR.SHORT_FRAME)}) AS frame
  FROM (SELECT build_id, line_no FROM error_hits WHERE category = 'UNKNOWN') p JOIN log_lines l ON l.build_id = p.build_id AND l.line_no BETWEEN p.line_no + 1 AND p.line_no + 49""",
)
cte(
    "after_frames",
    f"""SELECT build_id, pt, line_no, CASE WHEN full_form THEN {O.extract("t", TR.FULL_FRAME, 1)} ELSE {O.extract("t", TR.SHORT_FRAME, 1)} END AS class_name,
    CASE WHEN full_form THEN {O.extract("t", TR.FULL_FRAME, 2)} ELSE {O.extract("t", TR.SHORT_FRAME, 2)} END AS method,
    CASE WHEN full_form THEN {O.extract("t", TR.FULL_FRAME, 3)} ELSE {O.extract("t", TR.SHORT_FRAME, 3)} END AS file,
    try_cast({O.extract("t", TR.FULL_FRAME, 4)} AS BIGINT) AS src_line, {hit("t", TR.LIBRARY_FILE)} AS is_library FROM (
    SELECT *, {hit("t", TR.FULL_FRAME)} AS full_form, min(line_no) FILTER (t <> '' AND NOT frame AND NOT starts_with(t, 'at ') AND NOT starts_with(t, '...') AND NOT contains(t, 'Caused by')) OVER (PARTITION BY build_id, pt) AS stop FROM near_frames)
  WHERE frame AND (stop IS NULL OR line_no < stop)""",
)


def unknown_errors(lines):
    """Lines of that category; whether a line is in one category does not depend on the others."""
    return E.match_errors(lines, {"UNKNOWN": R.CATEGORY_PATTERNS["UNKNOWN"]}).select("build_id", "line_no")


@query("c24_frames_after_error", 'SELECT build_id, pt AS "at", line_no, class_name, method, file, src_line, is_library FROM after_frames')
def c24(spark, d):
    lines = T.stored_lines(spark, d)
    return TR.frames_after(unknown_errors(lines), lines)


@query(
    "d19_map_to_source",
    """SELECT e.build_id, e.line_no, coalesce(arg_min(file, f.line_no) FILTER (is_library), any_value('vars/' || m.failed_method || '.groovy')) AS source_file
  FROM (SELECT DISTINCT build_id, line_no FROM error_hits WHERE category = 'UNKNOWN') e LEFT JOIN after_frames f ON f.build_id = e.build_id AND f.pt = e.line_no
  LEFT JOIN flow_failed m ON m.build_id = e.build_id GROUP BY ALL HAVING source_file IS NOT NULL""",
)
def d19(spark, d):
    lines = T.stored_lines(spark, d)
    points = checkpointed(unknown_errors(lines))
    lib = TR.frames_after(points, lines).filter("is_library").groupBy("build_id", F.col("at").alias("line_no")).agg(F.min_by("file", "line_no").alias("file"))
    method = C.failed_method(C.method_events(lines, lines_queries.PREFIX))
    return (
        points.distinct().join(lib, ["build_id", "line_no"], "left").join(method, "build_id", "left")
        .select("build_id", "line_no", F.coalesce("file", F.concat(F.lit("vars/"), "failed_method", F.lit(".groovy"))).alias("source_file"))
        .filter("source_file is not null")
    )


@query(
    "d20_pipeline_errors",
    f"SELECT category, count(*) AS n, count(*) FILTER ({any_hit('line', R.PIPELINE_ERRORS, True)}) AS pipeline, count(*) FILTER ({any_hit('line', R.ROUTER_ERRORS, True)}) AS routed FROM errors GROUP BY 1",
)
def d20(spark, d):
    line = F.col("line")
    return E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed).groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(E.is_pipeline_error(line)).alias("pipeline"),
        F.count_if(E.is_pipeline_error(line, R.ROUTER_ERRORS)).alias("routed"),
    )


_EXC = "coalesce(" + ", ".join(extract("line", p, 0) for _, p in E.EXCEPTION_FORMS) + ")"


@query(
    "d21_extract_exceptions",
    f"""SELECT h.build_id, h.line_no, kind, message, string_agg(l.line, chr(10) ORDER BY l.line_no) AS context FROM (
    SELECT build_id, line_no, {first_match("line", [(p, t) for t, p in E.EXCEPTION_FORMS])} AS kind, {_EXC} AS message FROM log_lines WHERE {any_hit("line", [p for _, p in E.EXCEPTION_FORMS])}
    QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY line_no) <= 20) h
  JOIN log_lines l ON l.build_id = h.build_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY ALL""",
)
def d21(spark, d):
    return E.extract_exceptions(T.log_lines(spark, d))


@query("b08_identifier_hotlist", f"SELECT identifier, count(DISTINCT build_id) AS builds, count(*) AS errors FROM (SELECT build_id, unnest(list_distinct({ids_sql('line')} || {deep_ids_sql('line')})) AS identifier FROM errors) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50")
def b08(spark, d):
    return L.identifier_hotlist(E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed))


_RES = " UNION ALL ".join(
    f"SELECT build_id, {q(k)} AS kind, unnest(regexp_extract_all(line, {q(p)}, 1)) AS value FROM errors"
    for k, p in (("path", R.PATHS), ("url", R.URLS), ("variable", R.VARIABLES[0]), ("variable", R.VARIABLES[1]))
)


@query("b09_resource_mentions", f"SELECT kind, value, count(DISTINCT build_id) AS builds FROM ({_RES}) GROUP BY ALL")
def b09(spark, d):
    return L.resource_mentions(E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed))


# ---- context labels, traces -------------------------------------------------------------------

cte("ctx_side", "SELECT c.build_id, CASE WHEN l.line_no < chosen_line THEN 'before' ELSE 'after' END AS side, l.line_no, line, trim(line, ' ' || chr(9)) AS t, trim(substring(trim(line, ' ' || chr(9)), 11), ' ' || chr(9)) AS rest FROM chosen c JOIN log_lines l ON l.build_id = c.build_id AND l.line_no BETWEEN chosen_line - 30 AND chosen_line + 15 AND l.line_no <> chosen_line")


@query(
    "c20_context_line_labels",
    """SELECT build_id, side, line_no, CASE WHEN mark IS NOT NULL THEN mark WHEN before = 'ECHO' THEN 'ECHO_OUT' WHEN inside THEN CASE WHEN regexp_matches(t, '^\\d{2}:\\d{2}:\\d{2}\\s+\\+\\s+(.+)') THEN 'SHELL_CMD' ELSE 'SHELL_OUT' END END AS label
  FROM (SELECT *, lag(coalesce(mark, '')) OVER (PARTITION BY build_id, side ORDER BY line_no) AS before,
    last_value(CASE WHEN mark IS NOT NULL THEN mark = 'SH' END IGNORE NULLS) OVER (PARTITION BY build_id, side ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside
    FROM (SELECT *, CASE WHEN starts_with(t, '[Pipeline]') THEN CASE WHEN starts_with(rest, 'stage') OR starts_with(rest, '{ (') THEN 'STAGE' WHEN rest = 'echo' THEN 'ECHO' WHEN rest = 'sh' THEN 'SH' ELSE 'STEP' END END AS mark FROM ctx_side))""",
)
def c20(spark, d):
    lines = T.stored_lines(spark, d)
    points = checkpointed(E.chosen_lines(lines, checkpointed).select("build_id", F.col("chosen_line").alias("at")))
    near = E.around_point(points, lines, 30, 15).filter("line_no <> at").select(
        "build_id", F.when(F.col("line_no") < F.col("at"), "before").otherwise("after").alias("side"), "line_no", F.col("near_line").alias("line")
    )
    return C.context_labels(near).select("build_id", "side", "line_no", "label")


cte("at_runs", f"SELECT *, {hit('line', TR.AT_FRAME)} AS is_at, max(CASE WHEN NOT {hit('line', TR.AT_FRAME)} THEN line_no END) OVER (PARTITION BY build_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head_line FROM log_lines")
cte("at_groups", "SELECT r.build_id, head_line, any_value(l.line) AS head, count(*) AS frames FROM at_runs r JOIN log_lines l ON l.build_id = r.build_id AND l.line_no = head_line WHERE is_at GROUP BY ALL")
_AT = " UNION ALL ".join(
    f"SELECT build_id, head_line AS line_no, {q(lang)} AS lang, regexp_extract(head, {q(p)}, 1) AS exception, {strip(f'regexp_extract(head, {q(p)}, 2)')} AS message, frames FROM at_groups WHERE {hit('head', p)}"
    for lang, p in TR.HEADS
)
cte("py_marks", f"SELECT *, max(CASE WHEN contains(line, {q(TR.PY_START)}) THEN line_no END) OVER (PARTITION BY build_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trace FROM log_lines")
cte("py_stop", "SELECT build_id, trace, min(line_no) AS stop FROM py_marks WHERE trace IS NOT NULL AND line_no > trace AND NOT regexp_matches(line, '^\\s+\\S') GROUP BY ALL")
cte(
    "traces",
    f"""{_AT} UNION ALL SELECT p.build_id, p.trace, 'python', regexp_extract(h.line, {q(TR.PY_HEAD)}, 1), {strip(f"regexp_extract(h.line, {q(TR.PY_HEAD)}, 2)")}, count(*) FILTER (regexp_matches(p.line, '^\\s+File ') AND p.line_no < stop)
  FROM py_marks p JOIN py_stop s ON s.build_id = p.build_id AND s.trace = p.trace JOIN log_lines h ON h.build_id = p.build_id AND h.line_no = stop AND {hit("h.line", TR.PY_HEAD)}
  GROUP BY p.build_id, p.trace, h.line HAVING count(*) FILTER (regexp_matches(p.line, '^\\s+File ') AND p.line_no < stop) > 0""",
)


@query("c22_stack_traces", "SELECT build_id, line_no, lang, exception, message, frames FROM traces")
def c22(spark, d):
    return TR.stack_traces(T.stored_lines(spark, d))


_JV, _JS, _PY = q(TR.JAVA_FRAME), q(TR.JS_FRAME), q(TR.PY_FRAME)


@query(
    "c23_parse_frames",
    f"""SELECT build_id, line_no, lang, CASE lang WHEN 'java' THEN regexp_extract(line, {_JV}, 1) WHEN 'python' THEN regexp_extract(line, {_PY}, 3) ELSE coalesce(nullif(regexp_extract(line, {_JS}, 1), ''), 'anonymous') END AS method,
    CASE lang WHEN 'java' THEN regexp_extract(line, {_JV}, 2) WHEN 'python' THEN regexp_extract(line, {_PY}, 1) || ':' || regexp_extract(line, {_PY}, 2) ELSE regexp_extract(line, {_JS}, 2) END AS location
  FROM (SELECT *, CASE WHEN regexp_matches(line, {_JV}) THEN 'java' WHEN regexp_matches(line, {_JS}) THEN 'javascript' WHEN regexp_matches(line, {_PY}) THEN 'python' END AS lang FROM log_lines) WHERE lang IS NOT NULL""",
)
def c23(spark, d):
    return TR.parse_frames(T.log_lines(spark, d))


cte(
    "cps_frames",
    f"""SELECT *, {any_hit("class_name", TR.MACHINERY)} AS machinery, {any_hit("class_name", TR.STEP_CLASSES)} AS is_step, contains(class_name, '.vars.') OR contains(class_name, 'WorkflowScript') AS is_library,
    CASE WHEN contains(class_name, '.vars.') OR contains(class_name, 'WorkflowScript') THEN {extract("class_name", r"([\w-]+)\.vars\.\w+")} END AS library
  FROM (SELECT build_id, line_no, regexp_extract(line, {q(TR.CPS_FRAME)}, 1) AS class_name, regexp_extract(line, {q(TR.CPS_FRAME)}, 2) AS method,
    coalesce(nullif(regexp_extract(regexp_extract(line, {q(TR.CPS_FRAME)}, 3), '^(\\S+):\\d+', 1), ''), '') AS file, try_cast(nullif(regexp_extract(regexp_extract(line, {q(TR.CPS_FRAME)}, 3), '^\\S+:(\\d+)', 1), '') AS BIGINT) AS src_line
    FROM log_lines WHERE {hit("line", TR.CPS_FRAME)})""",
)


@query("c25_decode_cps_frames", "SELECT * FROM cps_frames")
def c25(spark, d):
    return TR.decode_cps_frames(T.log_lines(spark, d))


_UF = q(r"at\s+([^\(]+)\(([^:]+):?(\d+)?\)")
_HID = any_hit("method", [s.replace(".", r"\.") for s in TR.HIDDEN_FRAMES])
_FOR = any_hit("method", [s.replace(".", r"\.") for s in TR.FOREIGN_PACKAGES])


@query(
    "c26_user_frames",
    f"SELECT *, NOT {_FOR} AS is_user_code FROM (SELECT build_id, line_no, regexp_extract(line, {_UF}, 1) AS method, regexp_extract(line, {_UF}, 2) AS file, try_cast(nullif(regexp_extract(line, {_UF}, 3), '') AS BIGINT) AS src_line FROM log_lines WHERE regexp_matches(line, {_UF})) WHERE NOT {_HID}",
)
def c26(spark, d):
    return TR.user_frames(T.log_lines(spark, d))


# ---- blame ------------------------------------------------------------------------------------

cte(
    "merits",
    f"""SELECT build_id, cmd_line, tool, command, exit_code, CASE WHEN exit_code IS NOT NULL AND exit_code <> 0 THEN 35000 WHEN exit_code = 0 THEN -8000 ELSE 0 END + signals * 4500
    + CASE WHEN exit_line_at > n_out - 8 THEN 12000 ELSE 0 END + CASE WHEN starts_with(command, './') OR contains(command, '&&') OR contains(command, '|') THEN 800 ELSE 0 END AS merit,
    CASE WHEN {hit("command", shell.LONG_RUNNING)} THEN 405 ELSE 125 END AS reach FROM invocations""",
)


def blame_sql(points: str) -> str:
    """All pairs, scored one by one: the plain form of what the running maxima compute."""
    return f"""SELECT build_id, line_no, cmd_line, tool, command, exit_code, score / 100.0 AS score FROM (
    SELECT p.build_id, p.line_no, cmd_line, tool, command, exit_code, merit - 15 * (p.line_no - cmd_line) + CASE WHEN p.line_no - cmd_line <= reach THEN 500000 - 2 * (p.line_no - cmd_line)
      WHEN p.line_no - cmd_line - reach > 2000 THEN -200000 ELSE 50000 - 100 * (p.line_no - cmd_line - reach) END AS score
    FROM (SELECT DISTINCT build_id, line_no FROM {points}) p JOIN merits m ON m.build_id = p.build_id AND m.cmd_line <= p.line_no)
  QUALIFY row_number() OVER (PARTITION BY build_id, line_no ORDER BY score DESC, cmd_line) = 1"""


cte("blamed", blame_sql("errors"))
cte("chosen_points", "SELECT build_id, chosen_line AS line_no FROM chosen")
cte("blamed_chosen", blame_sql("chosen_points"))


@query("e01_blame_command", "SELECT build_id, line_no, cmd_line, tool, exit_code, score FROM blamed")
def e01(spark, d):
    lines = T.stored_lines(spark, d)
    inv = checkpointed(C.invocations(lines, cut=checkpointed))
    blamed = BL.blame_command(E.parsed_errors(lines, cut=checkpointed).select("build_id", "line_no"), inv)
    return BL.with_command(blamed, inv).select("build_id", "line_no", "cmd_line", "tool", "exit_code", "score")


_TIDS = "list_distinct(" + " || ".join(f"regexp_extract_all(chosen_text, {q(p)}, 1)" for p in R.TOOL_IDS) + ")"


def by_id_sql(rules) -> str:
    return f"""SELECT c.build_id, max(cmd_line) AS cmd_line, arg_max(tool, cmd_line) AS tool, arg_max(command, cmd_line) AS command FROM (SELECT build_id, {_TIDS} AS ids FROM chosen WHERE {any_hit("chosen_text", rules, True)}) c
  JOIN invocations i ON i.build_id = c.build_id AND len(list_filter(ids, lambda x: contains(command, x))) > 0 GROUP BY 1"""


@query("e02_tool_by_identifier", by_id_sql(R.PIPELINE_ERRORS))
def e02(spark, d):
    lines = T.stored_lines(spark, d)
    return BL.tool_by_identifier(E.chosen_lines(lines, checkpointed), C.invocations(lines, cut=checkpointed))


@query(
    "e03_final_exit_code",
    f"""SELECT i.build_id, max(cmd_line) AS cmd_line, arg_max(tool, cmd_line) AS tool, any_value(code) AS final_code FROM invocations i JOIN (
    SELECT t.build_id, coalesce(e.code, t.code) AS code FROM (SELECT build_id, arg_max(code, line_no) FILTER (code IS NOT NULL) AS code FROM (SELECT build_id, line_no, try_cast({extract("line", R.FINAL_EXIT_TAIL)} AS BIGINT) AS code FROM sized WHERE line_no > n_lines - 20) GROUP BY 1) t
    LEFT JOIN (SELECT build_id, arg_min(code, ord * 100 + cat_ord) FILTER (code IS NOT NULL) AS code FROM (SELECT *, try_cast({extract("line", R.FINAL_EXIT)} AS BIGINT) AS code FROM errors) GROUP BY 1) e ON e.build_id = t.build_id) c
  ON c.build_id = i.build_id AND code <> 0 WHERE i.exit_code IS NULL AND final_sign GROUP BY 1""",
)
def e03(spark, d):
    lines = T.stored_lines(spark, d)
    return BL.final_exit_code(lines, E.parsed_errors(lines, cut=checkpointed), C.invocations(lines, cut=checkpointed))


cte("router_tool", by_id_sql(R.ROUTER_ERRORS))
cte(
    "failing_tool",
    """SELECT l.build_id, coalesce(r.tool, b.tool, l.tool) AS tool, coalesce(r.cmd_line, b.cmd_line, l.cmd_line) AS cmd_line, CASE WHEN r.tool IS NOT NULL THEN 'identifier' WHEN b.tool IS NOT NULL THEN 'span' ELSE 'last' END AS via
  FROM (SELECT build_id, max(cmd_line) AS cmd_line, arg_max(tool, cmd_line) AS tool FROM invocations GROUP BY 1) l LEFT JOIN router_tool r ON r.build_id = l.build_id LEFT JOIN blamed_chosen b ON b.build_id = l.build_id""",
)


@query("e04_failing_tool", "SELECT build_id, tool, cmd_line, via FROM failing_tool")
def e04(spark, d):
    lines = T.stored_lines(spark, d)
    return BL.failing_tool(lines, checkpointed(E.chosen_lines(lines, checkpointed)), checkpointed(C.invocations(lines, cut=checkpointed)))


@query("d23_evidence_bundle")
def d23(spark, d):
    return BL.evidence_bundle(T.stored_lines(spark, d), checkpointed)
