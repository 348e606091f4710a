"""Queries on configuration issues and pipeline code."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import classify as C, knowledge as K, mining as M, steps as SH
from faultline.plans import lines_queries, oracle as O
from faultline.plans.oracle import any_hit, cte, extract, first_match, hit, q, strip
from faultline.plans.registry import query
from faultline.rules import config as R
from faultline.session import checkpointed
from faultline.sources import code as S, tables as T


def hits_sql(rules) -> str:
    items, n = [], 0
    for family, kinds in rules.items():
        for issue, patterns in kinds.items():
            for p in patterns:
                groups = p.count("(") - p.count("(?") - p.count(r"\(")
                name = extract("line", "(?i)" + p, 1) if groups > 0 else "NULL"
                extra = extract("line", "(?i)" + p, 2) if groups > 1 else "NULL"
                items.append(f"CASE WHEN {hit('line', p, True)} THEN {{'ord': {n}, 'family': {q(family)}, 'issue': {q(issue)}, 'name': CAST({name} AS VARCHAR), 'extra': CAST({extra} AS VARCHAR)}} END")
                n += 1
    return "[" + ", ".join(items) + "]"


cte("config_issues", f"SELECT build_id, line_no, stage, node, h.ord AS ord, h.family AS family, h.issue AS issue, h.name AS name, h.extra AS extra FROM (SELECT *, unnest({hits_sql(R.CONFIG_ISSUES)}) AS h FROM placed) WHERE h IS NOT NULL")

_FAMILY_KEYS = (("k01_credential_issues", "credential"), ("k02_env_issues", "env"), ("k05_plugin_issues", "plugin"), ("k06_parameter_issues", "param"), ("k07_jcasc_issues", "jcasc"))


def _family_query(key: str, family: str) -> None:
    @query(key, f"SELECT family, issue, name, stage, count(DISTINCT build_id) AS builds, count(*) AS hits FROM config_issues WHERE family = {q(family)} GROUP BY ALL")
    def run(spark, d):
        return M.issue_rollup(M.config_issues(T.stored_lines(spark, d), (family,)))


for _key, _family in _FAMILY_KEYS:
    _family_query(_key, _family)


@query(
    "k03_agent_issues",
    f"""SELECT i.build_id, line_no, issue, name, labels FROM config_issues i LEFT JOIN (SELECT build_id, arg_min(l, line_no) AS labels FROM (SELECT build_id, line_no, {extract("line", r"Available (?:labels|nodes?):\s*\[([^\]]+)\]")} AS l FROM log_lines) WHERE l IS NOT NULL GROUP BY 1) a ON a.build_id = i.build_id WHERE family = 'agent'""",
)
def k03(spark, d):
    lines = T.log_lines(spark, d)
    issues = M.config_issues(lines, ("agent",))
    return issues.join(M.available_labels(lines), "build_id", "left").select("build_id", "line_no", "issue", "name", "labels")


@query("k04_tool_issues", "SELECT build_id, line_no, issue, name, extra AS version, node FROM config_issues WHERE family = 'tool'")
def k04(spark, d):
    return M.config_issues(T.stored_lines(spark, d), ("tool",)).select("build_id", "line_no", "issue", "name", F.col("extra").alias("version"), "node")


_PRIM = "CASE family " + " ".join(
    f"WHEN {q(f)} THEN " + (("CASE issue " + " ".join(f"WHEN {q(i)} THEN {q(n)}" for i, n in names.items() if i) + f" ELSE {q(names[''])} END") if len(names) > 1 else q(names[""]))
    for f, names in R.PRIMARY_ISSUE.items()
) + " END"


@query("k08_primary_config_issue", f"SELECT build_id, {_PRIM} AS primary_issue FROM config_issues QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY ord, line_no) = 1")
def k08(spark, d):
    return M.primary_config_issue(M.config_issues(T.stored_lines(spark, d)))


@query("k09_tool_issues_by_type", f"SELECT coalesce({first_match('lower(name)', R.TOOL_FAMILIES)}, 'unknown') AS tool_type, issue, count(*) AS n FROM config_issues WHERE family = 'tool' GROUP BY ALL")
def k09(spark, d):
    issues = M.config_issues(T.stored_lines(spark, d), ("tool",))
    return issues.groupBy(M.tool_family(F.col("name")).alias("tool_type"), "issue").agg(F.count("*").alias("n"))


_VERS = ", ".join(f"arg_min(v{i}, line_no) FILTER (v{i} IS NOT NULL)" for i in range(3))


@query(
    "k11_version_inventory",
    f"SELECT version, count(*) AS builds, round(avg(CASE WHEN status = 'FAILURE' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM (SELECT build_id, coalesce({_VERS}) AS version FROM (SELECT build_id, line_no, " + ", ".join(f"{extract('line', p)} AS v{i}" for i, p in enumerate(R.VERSION_FORMS)) + " FROM log_lines) GROUP BY 1) v JOIN builds b ON b.build_id = v.build_id WHERE version IS NOT NULL GROUP BY 1",
)
def k11(spark, d):
    return M.version_inventory(T.log_lines(spark, d), T.builds(spark, d))


_SIG = r"No signature of method:\s+(\S+)\.(\w+)\("
cte("groovy_hits", f"SELECT build_id, line_no, line, h.ord AS ord, h.family AS kind FROM (SELECT *, unnest({hits_sql(M.GROOVY_RULES)}) AS h FROM log_lines) WHERE h IS NOT NULL")


@query(
    "k12_groovy_errors",
    f"SELECT build_id, line_no, ord, kind, CASE kind WHEN 'missing_method' THEN {extract('line', _SIG, 1)} END AS target_class, CASE kind WHEN 'missing_method' THEN {extract('line', _SIG, 2)} END AS member FROM groovy_hits",
)
def k12(spark, d):
    return M.groovy_errors(T.log_lines(spark, d))


@query("k13_groovy_failure_type", "SELECT build_id, arg_min(kind, ord) AS kind FROM groovy_hits GROUP BY 1")
def k13(spark, d):
    return M.groovy_failure_type(M.groovy_errors(T.log_lines(spark, d)))


@query(
    "k14_library_refs_in_log",
    f"SELECT build_id, library, arg_min(version, line_no) AS version FROM (SELECT build_id, line_no, coalesce({', '.join(extract('line', p, 1) for p in M.LOG_LIBRARY)}) AS library, coalesce({', '.join(extract('line', p, 2) for p in M.LOG_LIBRARY)}) AS version FROM log_lines) WHERE library IS NOT NULL GROUP BY ALL",
)
def k14b(spark, d):
    return M.library_refs_in_log(T.log_lines(spark, d))


# ---- source files -----------------------------------------------------------------------------

_FIRST = f"(p_partkey // {S.REPO_SIZE}) * {S.REPO_SIZE}"
_FILL = lambda c: f"replace(replace(replace({c}, '{{k}}', CAST(k AS VARCHAR)), '{{a}}', CAST(a AS VARCHAR)), '{{b}}', CAST(b AS VARCHAR))"
cte(
    "sources",
    f"""SELECT repo, k AS file_id, {_FILL("p")} AS path, {_FILL("c")} AS content FROM (SELECT p_partkey // {S.REPO_SIZE} AS repo, p_partkey AS k, {_FIRST} + (p_partkey * 3 + 1) % {S.REPO_SIZE} AS a, {_FIRST} + (p_partkey * 7 + 2) % {S.REPO_SIZE} AS b,
    ({O.values([p for p, _ in S.SOURCES])})[p_partkey % {len(S.SOURCES)} + 1] AS p, ({O.values([c for _, c in S.SOURCES])})[p_partkey % {len(S.SOURCES)} + 1] AS c FROM part)""",
)
_ONE = r"(['\"][^'\"]+['\"])"
cte(
    "lib_texts",
    f"""SELECT DISTINCT repo, path, file_id, unnest(regexp_extract_all(content, {q(r"@Library\s*\(\s*" + _ONE + r"\s*\)")}, 1) || flatten(list_transform(regexp_extract_all(content, {q(r"@Library\s*\(\s*\[([^\]]+)\]\s*\)")}, 1), lambda t: regexp_extract_all(t, {q(_ONE)}, 1)))
    || regexp_extract_all(content, {q(r"library\s+(?:identifier:\s*)?" + _ONE)}, 1)) AS t FROM sources""",
)


@query("k14_library_refs", f"SELECT repo, path, file_id, {extract('t', M.NAME_AT_VERSION, 1)} AS library, coalesce({extract('t', M.NAME_AT_VERSION, 2)}, 'master') AS version FROM lib_texts")
def k14(spark, d):
    return M.library_refs(S.sources(spark, d))


cte(
    "call_edges",
    f"SELECT DISTINCT repo, file_id, path, callee FROM (SELECT repo, file_id, path, unnest({' || '.join(f'regexp_extract_all(content, {q(p)}, 1)' for p in M.CALL_FORMS)}) AS callee FROM sources) WHERE NOT list_contains({O.values(R.BUILTIN_CALLS)}, callee)",
)


@query("k18_call_edges", "SELECT repo, file_id, callee FROM call_edges")
def k18(spark, d):
    return M.call_edges(S.sources(spark, d)).select("repo", "file_id", "callee")


_USED = " || ".join(f"regexp_extract_all(content, {q(p)}, 1)" for p in R.CREDENTIAL_USES)
cte("credential_usage", f"SELECT credential, count(*) AS files FROM (SELECT file_id, unnest(list_distinct({_USED})) AS credential FROM sources) GROUP BY 1")


@query(
    "k20_credential_usage",
    "SELECT u.credential, files, builds FROM credential_usage u JOIN (SELECT name, count(DISTINCT build_id) AS builds FROM config_issues WHERE family = 'credential' AND issue = 'not_found' GROUP BY 1) i ON i.name = u.credential",
)
def k20(spark, d):
    issues = M.config_issues(T.stored_lines(spark, d), ("credential",))
    return M.missing_credentials(M.credential_usage(S.sources(spark, d)), issues)


# a fold over the characters counts the open brackets, commas outside of them cut
_FOLD = """lambda acc, e: {{'d': acc.d + CASE WHEN e.o IN ('(', '[', '<') THEN 1 WHEN e.o IN (')', ']', '>') THEN -1 ELSE 0 END, 'o': acc.o || CASE WHEN e.o = ',' AND acc.d = 0 THEN chr(1) ELSE e.o END}}""".replace("{{", "{").replace("}}", "}")
_ARGS = lambda c: f"""list_filter(list_transform(string_split((list_reduce(list_prepend({{'d': 0, 'o': ''}}, list_transform(string_split(regexp_replace(trim({c}), '\\s+', ' ', 'g'), ''), lambda ch: {{'d': 0, 'o': ch}})), {_FOLD})).o, chr(1)), lambda p: trim(p)), lambda p: p <> '')"""
_ALL = lambda col, p, g: f"unnest(regexp_extract_all({col}, {q(p)}, {g}))"
cte(
    "def_rows",
    f"""SELECT repo, file_id, path, CASE WHEN name = 'call' THEN coalesce({extract("path", M.GLOBAL_FILE)}, name) ELSE name END AS name, {_ARGS("raw")} AS params FROM (
    SELECT repo, file_id, path, {_ALL("content", M.DEFINITION, 1)} AS name, {_ALL("content", M.DEFINITION, 2)} AS raw FROM sources)""",
)
cte("code_lines", "SELECT repo, file_id, path, line, line_no FROM (SELECT repo, file_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM sources) WHERE NOT contains(line, 'def ')")
cte(
    "site_rows",
    f"""SELECT repo, file_id, path, line_no, name, {_ARGS("raw")} AS args FROM (
    SELECT repo, file_id, path, line_no, {_ALL("line", M.SITE_BRACKETS, 1)} AS name, {_ALL("line", M.SITE_BRACKETS, 2)} AS raw FROM code_lines
    UNION ALL SELECT repo, file_id, path, line_no, {_ALL("line", M.SITE_PLAIN, 1)}, {_ALL("line", M.SITE_PLAIN, 2)} FROM code_lines
    UNION ALL SELECT repo, file_id, path, line_no, {_ALL("line", M.SITE_CLOSURE, 1)}, '' FROM code_lines) WHERE NOT list_contains({O.values(R.BUILTIN_CALLS)}, name)""",
)


@query("k22_signature_index", "SELECT repo, file_id, name, len(params) AS params, array_to_string(params, '|') AS text FROM def_rows")
def k22(spark, d):
    return M.definitions(S.sources(spark, d)).select("repo", "file_id", "name", F.size("params").alias("params"), F.array_join("params", "|").alias("text"))


@query(
    "e19_signature_mismatch",
    f"""SELECT repo, name, path, line_no, def_path, given, defined, kind FROM (
    SELECT s.repo, s.name, s.path, s.line_no, f.path AS def_path, len(args) AS given, len(params) AS defined, CASE WHEN len(args) <> len(params) THEN 'argument_count' WHEN m.name IS NOT NULL THEN 'missing_method' END AS kind
    FROM site_rows s JOIN def_rows f ON f.repo = s.repo AND f.name = s.name LEFT JOIN (SELECT DISTINCT {extract("line", M.NO_SIGNATURE)} AS name FROM log_lines) m ON m.name = s.name) WHERE kind IS NOT NULL""",
)
def e19(spark, d):
    src = S.sources(spark, d)
    return M.signature_mismatch(M.call_sites(src), M.definitions(src), M.missing_methods(T.log_lines(spark, d)))


_NAMES = lambda c: f"list_transform({c}, lambda p: regexp_extract(string_split(p, '=')[1], '(\\w+)\\s*$', 1))"
_NAMED = "list_transform(list_filter(args, lambda a: regexp_matches(a, '^\\w+\\s*:')), lambda a: regexp_extract(a, '^(\\w+)', 1))"


@query(
    "e20_compare_parameters",
    f"""SELECT repo, name, path, line_no, coalesce(array_to_string(list_sort(list_distinct(list_filter(req, lambda x: NOT list_contains(named, x)))), ','), '') AS missing, coalesce(array_to_string(list_sort(list_distinct(list_filter(named, lambda x: NOT list_contains(names, x)))), ','), '') AS extra
  FROM (SELECT s.repo, s.name, s.path, s.line_no, {_NAMED} AS named, {_NAMES("params")} AS names, {_NAMES("list_filter(params, lambda p: NOT contains(p, '='))")} AS req FROM site_rows s JOIN def_rows f ON f.repo = s.repo AND f.name = s.name) WHERE len(named) > 0""",
)
def e20(spark, d):
    src = S.sources(spark, d)
    return M.compare_parameters(M.call_sites(src), M.definitions(src))


cte("call_graph", "SELECT DISTINCT d.repo, d.name AS src, c.callee AS dst FROM def_rows d JOIN call_edges c ON c.repo = d.repo AND c.file_id = d.file_id WHERE d.name <> c.callee AND EXISTS (SELECT 1 FROM def_rows x WHERE x.repo = d.repo AND x.name = c.callee)")
cte(
    "call_reach",
    "SELECT DISTINCT repo, name AS start, name AS node, 0 AS depth FROM def_rows UNION SELECT r.repo, r.start, g.dst, r.depth + 1 FROM call_reach r JOIN call_graph g ON g.repo = r.repo AND g.src = r.node WHERE r.depth < 10",
)


@query("e17_call_chain", 'SELECT r.repo, start AS "start", node, min(depth) AS depth, any_value(f.path) AS path FROM call_reach r JOIN (SELECT repo, name, min(path) AS path FROM def_rows GROUP BY ALL) f ON f.repo = r.repo AND f.name = r.node GROUP BY r.repo, start, node')
def e17(spark, d):
    src = S.sources(spark, d)
    defs = checkpointed(M.definitions(src).groupBy("repo", "name").agg(F.min("path").alias("path")))
    found = M.reach(checkpointed(M.call_graph(src)), defs.select("repo", F.col("name").alias("start")), 10, checkpointed)
    return found.join(defs.withColumnRenamed("name", "node"), ["repo", "node"])


_PKG = extract("content", r"(?m)^package\s+([\w.]+);")
cte("java_classes", f"SELECT repo, content, {_PKG} AS package, {_PKG} || '.' || regexp_extract(path, '(\\w+)\\.java$', 1) AS cls, file_id FROM sources WHERE ends_with(path, '.java')")
cte("import_graph", "SELECT DISTINCT i.repo, i.cls AS src, i.dst FROM (SELECT repo, cls, package, unnest(regexp_extract_all(content, '(?m)^import\\s+([\\w.]+);', 1)) AS dst FROM java_classes) i JOIN java_classes j ON j.repo = i.repo AND j.cls = i.dst WHERE starts_with(dst, array_to_string(string_split(i.package, '.')[1:2], '.'))")
cte("import_reach", "SELECT DISTINCT repo, cls AS start, cls AS node, 0 AS depth FROM java_classes UNION SELECT r.repo, r.start, g.dst, r.depth + 1 FROM import_reach r JOIN import_graph g ON g.repo = r.repo AND g.src = r.node WHERE r.depth < 3")


@query("e18_import_walk", 'SELECT repo, start AS "start", node, min(depth) AS depth FROM import_reach GROUP BY ALL')
def e18(spark, d):
    src = S.sources(spark, d)
    classes = src.filter(F.col("path").endswith(".java")).select(
        "repo", F.concat_ws(".", F.regexp_extract("content", r"(?m)^package\s+([\w.]+);", 1), F.regexp_extract("path", r"(\w+)\.java$", 1)).alias("start")
    )
    return M.reach(checkpointed(M.import_graph(src)), classes.distinct(), 3, checkpointed)


_FILE = "PARTITION BY repo, file_id ORDER BY i"
_NL = "length(t) - length(replace(t, chr(10), ''))"
# tokens with running sums; a step lies in the last method before it, unless a bracket between them closes that method
cte("code_tokens", f"""SELECT *, CAST(1 + coalesce(sum({_NL}) OVER ({_FILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS src_line,
    sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER ({_FILE}) AS depth
  FROM (SELECT repo, file_id, path, unnest(regexp_extract_all(content, {q(SH.TOKEN)})) AS t, unnest(range(1, len(regexp_extract_all(content, {q(SH.TOKEN)})) + 1)) AS i FROM sources)""")
cte("step_tokens", f"""SELECT * FROM (SELECT *, last_value(CASE WHEN regexp_full_match(t, {q(SH.METHOD)}) THEN {{'i': i, 'depth': depth, 'name': regexp_extract(t, 'def\\s+(\\w+)', 1)}} END IGNORE NULLS) OVER ({_FILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM code_tokens)
  WHERE regexp_full_match(t, {q(SH.STEP)})""")
_QUOTED = f"regexp_replace(t, {q('^' + SH.STEP_HEAD)}, '')"
cte("shell_steps", f"""SELECT repo, file_id, path, src_line, CASE WHEN d IS NULL OR EXISTS (SELECT 1 FROM code_tokens z WHERE z.repo = s.repo AND z.file_id = s.file_id AND z.t = '}}' AND z.i > d.i AND z.i < s.i AND z.depth <= d.depth) THEN NULL
    WHEN d.name = 'call' AND regexp_matches(path, {q(SH.GLOBAL_FILE)}) THEN regexp_extract(path, {q(SH.GLOBAL_FILE)}, 1) ELSE d.name END AS method,
    CASE WHEN regexp_matches(t, {q(SH.STEP_HEAD + "['" + chr(34) + "]{3}[^'" + chr(34) + "]")}) THEN substr({_QUOTED}, 4, length({_QUOTED}) - 6) ELSE substr({_QUOTED}, 2, length({_QUOTED}) - 2) END AS body FROM step_tokens s""")
_INSIDE = lambda c: f"flatten(list_transform({c}, lambda x: list_transform(regexp_extract_all(x, {q(SH.INSERTED)}), lambda y: CASE WHEN starts_with(y, '`') THEN substr(y, 2, length(y) - 2) ELSE substr(y, 3, length(y) - 3) END)))"
_SHELL_TOKENS = f"regexp_extract_all(regexp_replace(regexp_replace(text, {q(SH.GOES_ON)}, ' ', 'g'), {q(SH.COMMENT)}, '', 'g'), {q(SH.SHELL_TOKEN)})"
_CUT = f"array_to_string(list_transform({_SHELL_TOKENS}, lambda x: CASE WHEN list_contains({O.values(SH.ENDS)}, x) OR x = chr(10) THEN chr(10) ELSE replace(x, chr(10), ' ') END), '')"
cte("source_commands", f"""SELECT *, lower({O.tool_name("command")}) AS tool FROM (
    SELECT repo, file_id, path, src_line, method, variables, unnest(list_filter(list_transform(string_split({_CUT}, chr(10)), lambda x: {strip("x")}), lambda x: x <> '')) AS command FROM (
      SELECT *, list_sort(list_distinct(regexp_extract_all(body, {q(SH.VARIABLE)}, 1))) AS variables, unnest([body] || l1 || l2 || {_INSIDE("l2")}) AS text FROM (
        SELECT *, {_INSIDE("l1")} AS l2 FROM (SELECT *, {_INSIDE("[body]")} AS l1 FROM shell_steps))))
  WHERE list_contains({O.values(SH.SHELL_TOOLS)}, lower({O.tool_name("command")}))""")


@query("k17_source_tool_usage", "SELECT repo, file_id, src_line, method, command, tool, array_to_string(variables, ',') AS variables FROM source_commands")
def k17(spark, d):
    return SH.source_tool_usage(S.sources(spark, d)).withColumn("variables", F.array_join("variables", ",")).drop("path")


_BAG = lambda c: f"list_distinct(list_filter(string_split_regex(lower(trim({c})), '\\s+'), lambda w: w <> ''))"


@query(
    "e11_trace_to_source",
    f"""SELECT i.build_id, i.cmd_line, i.tool, path, score FROM (SELECT build_id, cmd_line, tool, command FROM invocations WHERE form = 'shell' AND build_id % 5 >= 0) i JOIN (
    SELECT c.tool, c.command, s.path, s.src_line, s.command AS sc, round(len(list_intersect({_BAG("c.command")}, list_filter({_BAG("s.command")}, lambda w: NOT starts_with(w, '$')))) / len(list_distinct({_BAG("c.command")} || list_filter({_BAG("s.command")}, lambda w: NOT starts_with(w, '$')))), 6) AS score
    FROM (SELECT DISTINCT tool, command FROM invocations WHERE form = 'shell') c JOIN (SELECT DISTINCT tool, path, src_line, command FROM source_commands) s ON s.tool = c.tool WHERE score > 0.3
    QUALIFY row_number() OVER (PARTITION BY c.tool, c.command ORDER BY score DESC, s.path, s.src_line, s.command) = 1) b ON b.tool = i.tool AND b.command = i.command""".replace(" AND build_id % 5 >= 0", ""),
)
def e11(spark, d):
    steps = checkpointed(C.invocations(T.stored_lines(spark, d), cut=checkpointed).filter("form = 'shell'").select("build_id", "cmd_line", "tool", "command"))
    src = SH.source_tool_usage(S.sources(spark, d)).select("tool", "path", "src_line", "command").distinct()
    return K.trace_to_source(steps, src).select("build_id", "cmd_line", "tool", "path", "score")


cte("lib_defs", f"SELECT name, arg_min(path, (path, repo, file_id)) AS path, arg_min(array_to_string(params, '|'), (path, repo, file_id)) AS params FROM def_rows WHERE regexp_matches(path, {q(M.GLOBAL_FILE)}) GROUP BY name")


@query(
    "k16_root_cause_function",
    "SELECT build_id, name, path, params, line_no, method, file, src_line FROM cps_frames JOIN lib_defs ON list_contains(string_split_regex(class_name, '\\W+') || [method], name) WHERE is_library AND NOT machinery QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY line_no, name) = 1",
)
def k16(spark, d):
    return M.root_cause_function(T.log_lines(spark, d), M.global_functions(S.sources(spark, d)))


@query(
    "k15_library_functions",
    f"""SELECT build_id, w.name, coalesce(path, 'unknown') AS path, coalesce(params, '') AS params FROM (
    SELECT x.build_id, x.name FROM (SELECT build_id, unnest(list_distinct(regexp_extract_all(line, '(\\w+)', 1))) AS name FROM log_lines) x SEMI JOIN lib_defs d ON d.name = x.name
    UNION SELECT build_id, {extract("line", M.SCRIPT_FRAME)} FROM log_lines WHERE {hit("line", M.SCRIPT_FRAME)}) w LEFT JOIN lib_defs d ON d.name = w.name""",
)
def k15(spark, d):
    """Which library functions a log names, and where they are defined."""
    return M.library_functions(M.global_functions(S.sources(spark, d)), T.log_lines(spark, d))


@query("f09_tools_used", "SELECT build_id, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools FROM invocations GROUP BY 1")
def f09(spark, d):
    used = C.invocations(T.stored_lines(spark, d), cut=checkpointed).select("build_id", "tool").distinct()
    return used.groupBy("build_id").agg(F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("tools"))
