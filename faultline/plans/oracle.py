"""The derived tables again, as DuckDB text, for checking results."""

from __future__ import annotations

import re

from faultline.rules import shell, templates

BLANK = "' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return "[" + ", ".join(q(i) if isinstance(i, str) else str(i) for i in items) + "]"


def strip(c: str) -> str:
    return f"trim({c}, {BLANK})"


def hit(c: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({c}, {q(('(?i)' if ignore_case else '') + pattern)})"


def extract(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {q(pattern)}, {group}), '')"


def first_match(c: str, rules, ignore_case: bool = False) -> str:
    return "CASE " + " ".join(
        f"WHEN {hit(c, p, ignore_case)} THEN {q(v) if isinstance(v, str) else v}" for p, v in rules
    ) + " END"


def best_weight(c: str, rules, ignore_case: bool = False) -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN {hit(c, p, ignore_case)} THEN {w} ELSE 0 END" for p, w in rules) + ")"


def any_hit(c: str, patterns, ignore_case: bool = False) -> str:
    return "(" + " OR ".join(hit(c, p, ignore_case) for p in patterns) + ")"


def first_number(c: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"try_cast({extract(c, '(?i)' + p)} AS BIGINT)" for p in patterns) + ")"


def severity(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({c}), 'fatal|critical|panic') THEN 'CRITICAL' "
        f"WHEN regexp_matches(lower({c}), 'error|exception|failed') THEN 'ERROR' "
        f"WHEN contains(lower({c}), 'warn') THEN 'WARNING' ELSE 'ERROR' END"
    )


def tool_name(c: str) -> str:
    s = strip(c)
    inner = (
        f"CASE WHEN regexp_matches({s}, '^\"[^\"]*\"') THEN regexp_extract({s}, '^\"([^\"]*)\"', 1) "
        f"WHEN regexp_matches({s}, '^''[^'']*''') THEN regexp_extract({s}, '^''([^'']*)''', 1) ELSE {s} END"
    )
    parts = f"list_filter(string_split_regex({strip(inner)}, '\\s+'), lambda x: x <> '')"
    real = f"list_filter({parts}, lambda x: NOT (contains(x, '=') AND NOT starts_with(x, '-')))[1]"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN len({parts}) = 0 THEN 'shell' ELSE "
        f"coalesce(trim(string_split({real}, '/')[-1], '''\"'), string_split({parts}[1], '=')[1]) END"
    )


def method_key(c: str) -> str:
    return f"regexp_replace({strip(f'''regexp_replace(lower({c}), '\\s+', ' ', 'g')''')}, '\\(\\)$', '')"


def keywords(c: str, stop_words) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({c}), '(\\w+)', 1), "
        f"lambda x: length(x) > 2 AND NOT list_contains({values(stop_words)}, x))"
    )


_N = len(templates.FRAGMENTS)
_K = f"CAST((l_orderkey*{templates.SPREAD_ORDER} + l_linenumber*{templates.SPREAD_LINE}) % {_N} AS INTEGER)"

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> str:
    CTES[name] = sql
    return name


cte("frag", f"SELECT unnest(range({_N})) AS k, unnest({values(templates.FRAGMENTS)}) AS frag")
cte(
    "log_rows",
    f"""SELECT l_orderkey AS build_id, frag, l_partkey AS p, CAST(l_quantity AS BIGINT) AS qty,
  coalesce(sum(len(string_split(frag, chr(10)))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM lineitem JOIN frag ON frag.k = {_K}""",
)
cte(
    "log_lines",
    """SELECT build_id, CAST(start + step AS BIGINT) AS line_no, parts[step] AS line FROM (
  SELECT build_id, start, parts, unnest(range(1, len(parts) + 1)) AS step FROM (
    SELECT build_id, start, string_split(replace(replace(frag, '{p}', CAST(p AS VARCHAR)), '{q}', CAST(qty AS VARCHAR)), chr(10)) AS parts
    FROM log_rows))""",
)
cte("sized", "SELECT *, max(line_no) OVER (PARTITION BY build_id) AS n_lines FROM log_lines")
cte(
    "builds",
    """SELECT o_orderkey AS build_id, 'job-' || o_custkey AS job, o_orderkey AS number,
  CASE WHEN o_orderstatus = 'F' THEN 'FAILURE' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'ABORTED' ELSE 'SUCCESS' END
    WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'UNSTABLE' END AS status,
  o_orderkey % 11 = 0 AS building, o_orderdate AS ts, CAST(floor(o_totalprice * 1000) AS BIGINT) AS duration_ms FROM orders""",
)
cte(
    "failure_events",
    """SELECT event_id, 'h' || (user_id % 5) AS host, 'job/team/job/p' || user_id || '/' || (event_id % 50) || '/console' AS src, ts,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'Finished: FAILURE' ELSE 'Finished: FAILURE, script returned exit code ' || (event_id % 7) END WHEN 'view' THEN 'ERROR: step failed for ' || user_id
    WHEN 'purchase' THEN '[INFO] Downloading artifact' WHEN 'signup' THEN 'Exception: code ' || CAST(floor(value) AS BIGINT)
    ELSE 'Finished: ' || CASE WHEN event_id % 2 = 0 THEN 'SUCCESS' ELSE 'UNSTABLE' END END AS raw FROM events""",
)
cte(
    "feedback",
    """SELECT d.doc_id AS id, text AS error_snippet, upper(lang) AS error_category, source AS failed_stage,
  CASE WHEN d.doc_id % 3 = 0 THEN 'm' || (d.doc_id % 5) END AS failed_method, substring(text, 11) AS original_root_cause,
  (d.doc_id % 10) / 10.0 AS original_confidence, quality = 1 AS was_correct,
  CASE WHEN quality = 1 THEN substring(text, 11) ELSE substring(text, 31) END AS confirmed_root_cause,
  CASE WHEN toxic = 0 THEN substring(text, 101) END AS confirmed_fix, 'job-' || (d.doc_id % 20) AS job_name
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
cte(
    "examples",
    """SELECT u.conv_id * 100 + u.turn AS id, ['feedback','knowledge','review'][u.conv_id % 3 + 1] AS source, u.text AS error_snippet,
  a.text AS root_cause, CASE WHEN u.turn % 4 = 0 THEN a.text ELSE '' END AS fix,
  ['NETWORK','TIMEOUT','BUILD','WEIRD','UNKNOWN'][u.conv_id % 5 + 1] AS category, (u.conv_id % 13) / 10.0 AS confidence
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
)
cte(
    "review_queue",
    """SELECT o_orderkey AS id, 'h' || (o_custkey % 5) AS host, 'job/p' || o_custkey AS src, o_orderkey AS job_id,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  'ERROR: order ' || o_orderkey || ' failed with ' || o_orderpriority AS error_snippet,
  'cause ' || o_orderpriority AS ai_root_cause, 'fix ' || o_orderpriority AS ai_fix, o_orderpriority AS ai_category,
  (o_orderkey % 101) / 100.0 AS ai_confidence,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'real cause ' || o_custkey END AS reviewer_root_cause,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 8 = 0 THEN 'real fix ' || o_custkey END AS reviewer_fix, o_orderdate AS created_at FROM orders""",
)
cte(
    "commits",
    """SELECT o_orderkey AS sha, o_custkey AS repo, 'dev' || (o_orderkey % 9) AS author, o_orderdate AS ts,
  ['fix login','upgrade database','refactor auth','docs only','config update','merge branch'][o_orderkey % 6 + 1] AS message FROM orders""",
)
cte(
    "commit_files",
    """SELECT l_orderkey AS sha, ['src/main/','config/','vars/','docs/','Jenkinsfile.d/','docker/'][p_partkey % 6 + 1] || 'f' || p_partkey ||
  ['.java','.groovy','.yml','.py','.properties'][p_size % 5 + 1] AS path, CAST(l_quantity AS BIGINT) AS insertions,
  CAST(floor(l_discount * 100) AS BIGINT) AS deletions FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
_BODY = r"""regexp_replace(text, '["\\\n\r\t]', ' ', 'g')"""
cte(
    "responses",
    f"""SELECT conv_id AS build_id, CAST(turn // 2 + 1 AS BIGINT) AS iteration, turn, CASE (conv_id + turn) % 6
  WHEN 0 THEN '```json' || chr(10) || '{{"root_cause": "' || {_BODY} || '", "confidence": "' || ((conv_id*7 + turn*13) % 100) || '%", "is_retriable": "yes", "category": "NETWORK", "fix": "restart agent"}}' || chr(10) || '```'
  WHEN 1 THEN 'Sure: {{"root_cause": "' || {_BODY} || '", "confidence": 0.' || ((conv_id*7 + turn*13) % 100) || ', "is_retriable": false, "category": "TIMEOUT"}}'
  WHEN 2 THEN 'Root cause: connection refused by ' || {_BODY} || chr(10) || 'Fix: check the network' || chr(10) || 'I am fairly confident'
  WHEN 3 THEN '- timeout while waiting' || chr(10) || '- ' || {_BODY} || chr(10) || 'Recommended: increase the timeout'
  WHEN 4 THEN {_BODY} || chr(10) || chr(10) || 'not retriable, credential missing, permission denied'
  ELSE {_BODY} END AS raw_text FROM conversations WHERE role = 'assistant'""",
)


def sql(body: str) -> str:
    """Prefix the body with the derived tables it names, in dependency order."""
    names, seen = [], set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in seen and re.search(rf"(?i)\b(?:from|join)\s+{name}\b|,\s*{name}\b(?=\s+\w+\s*(?:where|on|$))", text):
                seen.add(name)
                need(CTES[name])
                names.append(name)

    need(body)
    if not names:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {head},\n{body[5:]}"
    return f"WITH RECURSIVE {head}\n{body}"
