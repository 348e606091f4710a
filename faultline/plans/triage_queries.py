"""Queries on triage, model answers, commit risk and the finding per build."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import blame as BL, classify as C, commits as G, errors as E, knowledge as K, search as S, traces as TR, triage as TG
from faultline.plans import errors_queries, lines_queries, oracle as O, records_queries
from faultline.plans.oracle import any_hit, cte, extract, first_match, hit, q, strip
from faultline.plans.registry import query
from faultline.rules import errors as RE, triage as R
from faultline.session import checkpointed
from faultline.sources import tables as T


def canonical_sql(c: str) -> str:
    return f"CASE upper({c}) " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in R.CATEGORY_ALIASES.items()) + f" ELSE upper({c}) END"


def tier_sql(c: str) -> str:
    return f"CASE {canonical_sql(c)} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in R.TIERS.items()) + " ELSE 'unknown' END"


# ---- gates ------------------------------------------------------------------------------------

_GATE = "CASE WHEN building THEN 'in progress' WHEN status = 'SUCCESS' THEN 'succeeded' WHEN status = 'ABORTED' THEN 'aborted' WHEN status = 'UNSTABLE' THEN 'unstable' WHEN status IS NOT NULL AND status <> 'FAILURE' THEN 'unexpected status: ' || status END"


@query("j01_status_gate", f"SELECT {_GATE} AS skip, count(*) AS n FROM builds GROUP BY 1")
def j01(spark, d):
    return T.builds(spark, d).groupBy(TG.status_gate().alias("skip")).agg(F.count("*").alias("n"))


_LOWT = strip("lower(line)")
ACT = f"(length({_LOWT}) >= 5 AND NOT {any_hit(_LOWT, R.NOT_ACTIONABLE)})"


@query("j02_filter_noise", f"SELECT build_id, line_no, category FROM errors WHERE {ACT}")
def j02(spark, d):
    return E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed).filter(TG.actionable(F.col("line"))).select("build_id", "line_no", "category")


@query(
    "j03_actionable_gate",
    f"""SELECT b.build_id, coalesce(actionable, 0) AS actionable, coalesce(n, 0) AS traces, last_stage, coalesce(actionable, 0) = 0 AND coalesce(n, 0) = 0 AND last_stage IS NULL AS skip FROM builds b
  LEFT JOIN (SELECT build_id, count(*) FILTER ({ACT}) AS actionable FROM errors GROUP BY 1) e ON e.build_id = b.build_id
  LEFT JOIN (SELECT build_id, count(*) AS n FROM traces GROUP BY 1) t ON t.build_id = b.build_id LEFT JOIN stage_last s ON s.build_id = b.build_id""",
)
def j03(spark, d):
    lines = T.stored_lines(spark, d)
    facts = checkpointed(C.build_facts(lines))
    stages = facts.filter("last_stage is not null").select("build_id", "last_stage")
    return TG.actionable_gate(E.parsed_errors(lines, cut=checkpointed, facts=facts), TR.stack_traces(lines), stages, T.builds(spark, d))


_DEEP = f"(list_contains({O.values(R.DEEP_CATEGORIES)}, category) OR " + " OR ".join(f"contains(lower(line), {q(t)})" for t in R.DEEP_TEXTS) + ")"


@query("j04_needs_deep", f"SELECT build_id, bool_or({_DEEP}) AS needs_deep FROM errors GROUP BY 1")
def j04(spark, d):
    errs = E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed)
    return errs.groupBy("build_id").agg(F.max(TG.needs_deep(F.col("category"), F.col("line"))).alias("needs_deep"))


@query("j05_tier", f"SELECT {tier_sql('category')} AS tier, category, count(*) AS n FROM errors GROUP BY ALL")
def j05(spark, d):
    errs = E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed)
    return errs.groupBy(TG.tier(F.col("category")).alias("tier"), "category").agg(F.count("*").alias("n"))


_PR = "coalesce(nullif(list_position(" + O.values(RE.CATEGORY_PRIORITY) + ", category), 0), 99)"


@query("e16_category_dimension", f"SELECT category, {tier_sql('category')} AS tier, CAST({_PR} AS BIGINT) AS priority, count(*) AS n FROM error_hits GROUP BY ALL")
def e16(spark, d):
    """Errors with the attributes of their category, by a broadcast join with the fixed dimension."""
    dim = spark.createDataFrame([(c, R.TIERS.get(c, "unknown"), i + 1) for i, c in enumerate(RE.CATEGORY_PRIORITY)], "category string, tier string, priority bigint")
    hits = E.match_errors(T.log_lines(spark, d)).groupBy("category").agg(F.count("*").alias("n"))
    return hits.join(F.broadcast(dim), "category", "left").select(
        "category", F.coalesce("tier", F.lit("unknown")).alias("tier"), F.coalesce("priority", F.lit(99).cast("bigint")).alias("priority"), "n"
    )


# ---- known failures ---------------------------------------------------------------------------

_RULES = [(p, i) for i, (p, *_) in enumerate(R.KNOWN_FAILURES)]


def known_ord_sql(c: str) -> str:
    return first_match(f"lower({c})", _RULES, True)


cte("known_dim", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(t)}, {q(s)}, {c}, {q(g)}, {str(r).lower()})" for i, (_, t, s, c, g, r) in enumerate(R.KNOWN_FAILURES)) + ") v(rule, tool, symptom, confidence, category, retriable)")


@query("d24_known_failure", f"SELECT tool, symptom, k.category, retriable, count(*) AS lines FROM (SELECT {known_ord_sql('line')} AS rule FROM log_lines) l JOIN known_dim k ON k.rule = l.rule GROUP BY ALL")
def d24(spark, d):
    k = TG.known_failure(TG.known_failure_ord(F.col("line")))
    lines = T.log_lines(spark, d).withColumn("k", k).filter("k is not null")
    return lines.groupBy(F.col("k.tool").alias("tool"), F.col("k.symptom").alias("symptom"), F.col("k.category").alias("category"), F.col("k.retriable").alias("retriable")).agg(F.count("*").alias("lines"))


cte("last5", "SELECT *, min(age) FILTER (exit_code <> 0) OVER (PARTITION BY build_id) AS bad_age FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY cmd_line DESC) AS age FROM invocations QUALIFY age <= 5)")
cte(
    "evidence",
    f"""SELECT build_id, 'line' AS kind, chosen_text AS text FROM chosen
  UNION ALL SELECT build_id, 'error', line FROM errors QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY ord, cat_ord) <= 5
  UNION ALL SELECT l.build_id, 'output', output FROM last5 l JOIN outputs o ON o.build_id = l.build_id AND o.cmd_line = l.cmd_line WHERE (bad_age IS NULL OR age <= bad_age) AND CASE WHEN age = bad_age THEN out_no <= 10 ELSE out_no <= 5 AND {hit("lower(output)", R.EVIDENCE_WORDS)} END
  UNION ALL SELECT build_id, 'command', command FROM last5 WHERE age = bad_age""",
)
cte("known", f"SELECT e.build_id, k.* FROM (SELECT build_id, min({known_ord_sql('text')}) AS rule FROM evidence GROUP BY 1) e JOIN known_dim k ON k.rule = e.rule")


def evidence(lines, errors=None, facts=None):
    """`facts` and `errors` are the `build_facts` and `parsed_errors` of the lines, if the caller has them."""
    commands = checkpointed(C.command_lines(lines))
    facts = checkpointed(C.build_facts(lines)) if facts is None else facts
    errors = E.parsed_errors(lines, cut=checkpointed, facts=facts) if errors is None else errors
    chosen = E.reconcile(E.primary_line(lines, facts), E.first_error(errors))
    return TG.failure_evidence(chosen, errors, checkpointed(C.invocations_of(commands)), C.command_output(commands))


@query("d25_failure_evidence", "SELECT build_id, rule, tool, symptom FROM known")
def d25(spark, d):
    known = TG.known_failures(evidence(T.stored_lines(spark, d)))
    return known.select("build_id", "rule", F.col("k.tool").alias("tool"), F.col("k.symptom").alias("symptom"))


# ---- model answers ----------------------------------------------------------------------------


def clean_sql(c: str) -> str:
    for pattern, keep in R.MARKDOWN:
        c = f"regexp_replace({c}, {q(pattern)}, '{'\\1' if keep else ''}', 'g')"
    return strip(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def says_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(raw_text), {q(w)})" for w in words) + ")"


_ANS = ", ".join(
    f"{{'s': -round((" + " + ".join(f"CASE WHEN contains(lower(raw_text), {q(w)}) THEN 1 ELSE 0 END" for w in ws) + f") * {wt}, 6), 'i': {i}, 'n': {q(n)}}}"
    for i, (n, wt, ws) in enumerate(R.ANSWER_CATEGORIES)
)
CAT_SQL = f"CASE WHEN list_min([{_ANS}]).s < 0 THEN list_min([{_ANS}]).n ELSE 'UNKNOWN' END"
CONF_SQL = f"CASE WHEN {says_sql(R.SURE)} THEN 0.80 WHEN {says_sql(R.UNSURE)} THEN 0.55 WHEN {says_sql(R.FAIRLY_SURE)} THEN 0.70 ELSE 0.65 END"
RETRY_SQL = f"({says_sql(R.RETRY)} AND NOT {says_sql(R.NO_RETRY)})"


@query("j11_response_profile", f"SELECT {CAT_SQL} AS category, {RETRY_SQL} AS retriable, count(*) AS n, round(avg({CONF_SQL}), 6) AS avg_confidence FROM responses GROUP BY ALL")
def j11(spark, d):
    return TG.response_profile(T.responses(spark, d))


_RT = strip("raw_text")
_SECT = ", ".join(f"nullif({clean_sql(extract(_RT, p))}, '')" for p in R.CAUSE_SECTIONS)
_STMT = ", ".join(f"CASE WHEN length({clean_sql(extract(_RT, p))}) > 20 THEN {clean_sql(extract(_RT, p))} END" for p in R.CAUSE_STATEMENTS)
_BODY = f"regexp_replace(regexp_replace({_RT}, {q(r"(?i)^(Here'?s?\s+(the|my)\s+)?(root cause\s+)?analysis[:\s]*\n*")}, ''), {q(r"(?i)^(Based on|Looking at|After analyzing|I've analyzed)[^.]+\.\s*")}, '')"
_PARA = f"list_filter(list_transform(string_split_regex({_BODY}, '\\n\\s*\\n'), lambda p: {strip('p')}), lambda p: length(p) > 30 AND NOT starts_with(p, '#'))[1]"
_CAUSE = strip(f"left(coalesce({_SECT}, {_STMT}, {clean_sql(_PARA)}, left({clean_sql(_RT)}, 500)), 600)")
_FIX = "left(coalesce(" + ", ".join(clean_sql(extract(_RT, p)) for p in R.FIX_FORMS) + ", ''), 400)"
_BARE = f"regexp_replace(regexp_replace({_RT}, '^```\\w*\\n?', ''), '\\n?```$', '')"
cte("answer_json", f"SELECT *, try_cast(coalesce({extract(_BARE, R.ANSWER_JSON, 0)}, {_BARE}) AS JSON) AS j FROM responses")
_NUM = "try_cast(regexp_extract(json_extract_string(j, 'confidence'), '([0-9]*\\.?[0-9]+)', 1) AS DOUBLE)"
cte(
    "answers",
    f"""SELECT build_id, iteration, is_json, CASE WHEN is_json THEN json_extract_string(j, 'root_cause') ELSE {_CAUSE} END AS root_cause,
    round(CASE WHEN is_json THEN greatest(0.0, least(1.0, coalesce(CASE WHEN contains(json_extract_string(j, 'confidence'), '%') OR {_NUM} > 1 THEN {_NUM} / 100 ELSE {_NUM} END, 0.0))) ELSE {CONF_SQL} END, 6) AS confidence,
    CASE WHEN is_json THEN coalesce(json_extract_string(j, 'category'), 'UNKNOWN') ELSE {CAT_SQL} END AS category, CASE WHEN is_json THEN lower(coalesce(json_extract_string(j, 'is_retriable'), '')) IN ('true', 'yes', '1') ELSE {RETRY_SQL} END AS is_retriable,
    CASE WHEN is_json THEN coalesce(json_extract_string(j, 'fix'), '') ELSE {_FIX} END AS fix FROM (SELECT *, j IS NOT NULL AND json_extract_string(j, 'root_cause') IS NOT NULL AS is_json FROM answer_json)""",
)


@query("j09_normalize_responses", "SELECT build_id, iteration, is_json, root_cause, confidence, category, is_retriable, fix FROM answers")
def j09(spark, d):
    return TG.normalize_responses(T.responses(spark, d))


cte(
    "best_answer",
    """SELECT build_id, iteration, is_json, root_cause, confidence, category, is_retriable, fix, count(*) OVER (PARTITION BY build_id) AS used FROM (
    SELECT *, min(iteration) FILTER (confidence >= 0.7) OVER (PARTITION BY build_id) AS stop FROM answers WHERE iteration <= 3) WHERE stop IS NULL OR iteration <= stop
  QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY confidence DESC, iteration) = 1""",
)


@query("j08_best_iteration", "SELECT build_id, iteration, root_cause, confidence, category, used FROM best_answer")
def j08(spark, d):
    best = TG.best_iteration(TG.normalize_responses(T.responses(spark, d)))
    return best.select("build_id", "iteration", "root_cause", "confidence", "category", "used")


def kb_of_builds(spark, d, errs):
    """Best known error of each build's error lines; equal texts are matched once."""
    texts = errs.select(F.col("line").alias("text")).distinct()
    m = K.match_errors(texts, K.merge_errors(T.tool_errors(spark, d)))
    order = F.struct("confidence", F.col("tool"), F.col("code"))
    best = m.groupBy("text").agg(F.max(F.struct("confidence", "tool", "code", "category", "fix", "retriable")).alias("m"))
    per = errs.select("build_id", F.col("line").alias("text")).distinct().join(best, "text")
    return per.groupBy("build_id").agg(F.max("m").alias("m")).select(
        "build_id", F.col("m.confidence").alias("kb_conf"), F.col("m.category").alias("kb_cat"), F.nullif("m.fix", F.lit("")).alias("kb_fix"), F.col("m.retriable").alias("kb_retry")
    )


cte("err_text", "SELECT DISTINCT build_id, line AS text FROM errors")
cte("kb_match", records_queries.match_sql("err_text", "text"))
cte("kb_build", "SELECT build_id, m.confidence AS kb_conf, m.category AS kb_cat, nullif(m.fix, '') AS kb_fix, m.retriable AS kb_retry FROM (SELECT build_id, max({'confidence': CAST(confidence AS DOUBLE), 'tool': tool, 'code': code, 'category': category, 'fix': fix, 'retriable': retriable}) AS m FROM kb_match GROUP BY 1)")
_BOOST = """SELECT a.build_id, a.iteration, a.root_cause, greatest(a.confidence, coalesce(k.confidence, 0.0), coalesce(kb_conf, 0.0)) AS confidence,
  CASE WHEN c1 = 'UNKNOWN' AND kb_cat IS NOT NULL THEN kb_cat ELSE c1 END AS category, CASE WHEN fix = '' AND kb_fix IS NOT NULL THEN kb_fix ELSE fix END AS fix,
  CASE WHEN kb_retry IS NULL THEN is_retriable OR coalesce(k.retriable, false) WHEN kb_conf >= 0.75 THEN kb_retry ELSE (is_retriable OR coalesce(k.retriable, false)) AND kb_retry END AS retriable,
  CASE WHEN kb_retry IS NULL THEN 'model_only' WHEN kb_conf >= 0.75 THEN 'kb_high_trust' ELSE 'conservative_and' END AS policy
  FROM (SELECT a.*, CASE WHEN a.category = 'UNKNOWN' AND k.confidence > a.confidence THEN k.category ELSE a.category END AS c1 FROM best_answer a LEFT JOIN known k ON k.build_id = a.build_id) a
  LEFT JOIN known k ON k.build_id = a.build_id LEFT JOIN kb_build b ON b.build_id = a.build_id"""
cte("boosted", _BOOST)


def boosted(spark, d):
    lines = T.stored_lines(spark, d)
    facts = checkpointed(C.build_facts(lines))
    errors = E.parsed_errors(lines, cut=checkpointed, facts=facts)
    answers = TG.best_iteration(TG.normalize_responses(T.responses(spark, d)))
    return TG.boost(answers, TG.known_failures(evidence(lines, errors, facts)), kb_of_builds(spark, d, errors))


@query("j06_merge_retriable", "SELECT policy, retriable, count(*) AS n FROM boosted GROUP BY ALL")
def j06(spark, d):
    return boosted(spark, d).groupBy("policy", "retriable").agg(F.count("*").alias("n"))


@query("j07_boost_confidence", "SELECT build_id, confidence, category, fix FROM boosted")
def j07(spark, d):
    return boosted(spark, d).select("build_id", "confidence", "category", "fix")


_SUGG = f"CASE WHEN length(line) > 10 THEN coalesce({first_match('lower(line)', R.SUGGESTIONS)}, 'fix the reported error') ELSE 'see the error details' END"


@query("j15_recommendation", f"SELECT category, {_SUGG} AS suggestion, count(*) AS n FROM errors GROUP BY ALL")
def j15(spark, d):
    errs = E.parsed_errors(T.stored_lines(spark, d), cut=checkpointed)
    return errs.groupBy("category", TG.suggestion(F.col("line")).alias("suggestion")).agg(F.count("*").alias("n"))


cte("log_signs", f"SELECT l.build_id, bool_or({hit('l.line', R.STRONG_SCM)}) AS strong, bool_or({any_hit('l.line', S.SIGNALS, True)}) AS candidates, any_value(t.noise) AS noise FROM log_lines l JOIN (SELECT build_id, bool_or(noise) AS noise FROM tail_rows GROUP BY 1) t ON t.build_id = l.build_id GROUP BY 1")


@query(
    "j16_calibrate_confidence",
    "SELECT id, round(CASE WHEN noise AND NOT candidates THEN least(c, 0.62) ELSE c END, 6) AS confidence FROM (SELECT id, noise, candidates, CASE WHEN strong THEN greatest(ai_confidence, 0.78) WHEN candidates THEN greatest(ai_confidence, 0.55) ELSE ai_confidence * 0.92 END AS c FROM review_queue r JOIN log_signs s ON s.build_id = r.id)",
)
def j16(spark, d):
    joined = T.review_queue(spark, d).join(TG.log_signs(T.log_lines(spark, d)), F.col("id") == F.col("build_id"))
    c = TG.calibrate(F.col("ai_confidence"), F.col("strong"), F.col("candidates"), F.col("noise"))
    return joined.select("id", F.round(c, 6).alias("confidence"))


@query(
    "j17_fallback_result",
    f"""SELECT b.build_id, coalesce(primary_category, 'UNKNOWN') AS category, {tier_sql("coalesce(primary_category, 'UNKNOWN')")} AS tier, last_stage AS stage, coalesce(left(parser_text, 500), trace) AS primary_error, 0.6 AS confidence, {tier_sql("coalesce(primary_category, 'UNKNOWN')")} = 'external_system' AS retriable
  FROM (SELECT coalesce(f.build_id, t.build_id) AS build_id, parser_text, trace FROM first_error f FULL JOIN (SELECT build_id, arg_min(exception || ': ' || message, (line_no, lang)) AS trace FROM traces GROUP BY 1) t ON t.build_id = f.build_id) b
  LEFT JOIN primary_category c ON c.build_id = b.build_id LEFT JOIN stage_last s ON s.build_id = b.build_id""",
)
def j17(spark, d):
    lines = T.stored_lines(spark, d)
    facts = checkpointed(C.build_facts(lines))
    errs = E.parsed_errors(lines, cut=checkpointed, facts=facts)
    category = E.primary_category(errs).drop("errors")
    stages = facts.filter("last_stage is not null").select("build_id", "last_stage")
    return TG.fallback_result(E.first_error(errs), TR.stack_traces(lines), category, stages)


# ---- the finding per build --------------------------------------------------------------------

_CT = "lower(chosen_text)"
_FOUND = "CASE WHEN coalesce(primary_category, 'UNKNOWN') = 'UNKNOWN' THEN coalesce(k.category, 'UNKNOWN') ELSE primary_category END"


@query(
    "j18_findings",
    f"""SELECT build_id, job, number, status, category, {tier_sql("category")} AS tier, stage, line_no, left(chosen_text, 500) AS primary_error, chosen_source, {errors_queries.error_type_sql("chosen_text")} AS error_type, failing_tool, via, symptom,
    CAST(coalesce(kconf, 0.6) AS DOUBLE) AS confidence, coalesce(kretry, {tier_sql("category")} = 'external_system') AS retriable,
    list_contains({O.values(R.DEEP_CATEGORIES)}, category) OR {" OR ".join(f"contains({_CT}, {q(t)})" for t in R.DEEP_TEXTS)} AS needs_deep,
    CASE WHEN length(chosen_text) > 10 THEN coalesce({first_match(_CT, R.SUGGESTIONS)}, 'fix the reported error') ELSE 'see the error details' END AS fix, strftime(ts, '%Y-%m-%d') AS day
  FROM (SELECT b.build_id, job, number, status, ts, {_FOUND} AS category, c.last_stage AS stage, chosen_line AS line_no, chosen_text, chosen_source, t.tool AS failing_tool, via, symptom, k.confidence AS kconf, k.retriable AS kretry
    FROM builds b JOIN chosen c ON c.build_id = b.build_id LEFT JOIN primary_category p ON p.build_id = b.build_id LEFT JOIN failing_tool t ON t.build_id = b.build_id LEFT JOIN known k ON k.build_id = b.build_id WHERE {_GATE} IS NULL)""",
)
def j18(spark, d):
    return TG.findings(T.stored_lines(spark, d), T.builds(spark, d), checkpointed)


# ---- commits ----------------------------------------------------------------------------------

cte("error_files", "SELECT c_custkey AS repo, CASE WHEN c_custkey % 2 = 0 THEN 'app/f' || ((c_custkey * 7) % 200 + 1) || '.java' ELSE ((c_custkey * 3) % 100) || '.py' END AS path FROM customer")


def error_files(spark, d):
    c = T.read(spark, d, "customer")
    k = F.col("c_custkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("app/f"), (k * 7) % 200 + 1, F.lit(".java"))).otherwise(F.concat((k * 3) % 100, F.lit(".py")))
    return c.select(k.alias("repo"), path.alias("path"))


_HR, _CR = any_hit("path", G.HIGH_RISK), any_hit("path", G.CRITICAL)
cte(
    "commit_window",
    f"""SELECT c.*, coalesce(files, 0) AS files, CAST(coalesce(insertions, 0) AS BIGINT) AS insertions, CAST(coalesce(deletions, 0) AS BIGINT) AS deletions, coalesce(risky_files, 0) AS risky_files, coalesce(critical, false) AS critical FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha DESC) AS age FROM commits QUALIFY age <= 10) c
  LEFT JOIN (SELECT sha, count(*) AS files, sum(insertions) AS insertions, sum(deletions) AS deletions, count(*) FILTER ({_HR}) AS risky_files, bool_or({_CR}) AS critical FROM commit_files GROUP BY 1) f ON f.sha = c.sha""",
)


@query("f14_commit_window", "SELECT repo, age, sha, files, insertions, deletions FROM commit_window")
def f14(spark, d):
    return G.commit_window(T.commits(spark, d), T.commit_files(spark, d)).select("repo", "age", "sha", "files", "insertions", "deletions")


cte(
    "file_hits",
    "SELECT w.repo, w.sha, f.path, e.path AS error_file FROM commit_window w JOIN commit_files f ON f.sha = w.sha JOIN error_files e ON e.repo = w.repo WHERE lower(f.path) = lower(e.path) OR ends_with(lower(f.path), lower(e.path)) OR string_split(lower(f.path), '/')[-1] = string_split(lower(e.path), '/')[-1]",
)


@query("e15_files_match", "SELECT repo, sha, path, error_file FROM file_hits")
def e15(spark, d):
    window = G.newest_commits(T.commits(spark, d)).select("sha", "repo")
    changed = checkpointed(T.commit_files(spark, d).select("sha", "path").join(window, "sha"))
    return G.files_match(changed, error_files(spark, d)).select("repo", "sha", "path", "error_file")


_WORDS = " + ".join(f"CASE WHEN contains(lower(message), {q(w)}) THEN 3 ELSE 0 END" for w in G.RISKY_WORDS)
cte(
    "suspicion",
    f"SELECT w.*, coalesce(hits, 0) * 10 + {_WORDS} + risky_files * 2 + CASE WHEN insertions + deletions > 500 THEN 5 WHEN insertions + deletions > 100 THEN 2 ELSE 0 END AS score FROM commit_window w LEFT JOIN (SELECT sha, count(*) AS hits FROM file_hits GROUP BY 1) h ON h.sha = w.sha",
)


def scored_commits(spark, d):
    files = T.commit_files(spark, d)
    return G.suspicion(G.commit_window(T.commits(spark, d), files), files, error_files(spark, d))


@query("f13_suspicion", "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY age) AS rn, sha, score FROM suspicion WHERE score >= 5 QUALIFY rn <= 5")
def f13(spark, d):
    return G.suspicious(scored_commits(spark, d))


@query(
    "f12_risk_score",
    """SELECT repo, suspicious, changes, round(least(CASE WHEN suspicious > 0 THEN least(suspicious * 0.15, 0.4) ELSE 0 END + CASE WHEN changes > 1000 THEN 0.2 WHEN changes > 500 THEN 0.1 ELSE 0 END + CASE WHEN critical THEN 0.15 ELSE 0 END + CASE WHEN authors > 3 THEN 0.1 ELSE 0 END + CASE WHEN commits >= 5 AND spread < 3600 THEN 0.15 ELSE 0 END, 1.0), 6) AS risk,
  array_to_string(list_filter([CASE WHEN suspicious > 0 THEN 'suspicious commits' END, CASE WHEN changes > 1000 THEN 'large changes' END, CASE WHEN changes BETWEEN 501 AND 1000 THEN 'moderate changes' END, CASE WHEN critical THEN 'critical files' END, CASE WHEN authors > 3 THEN 'many authors' END, CASE WHEN commits >= 5 AND spread < 3600 THEN 'rapid succession' END], lambda x: x IS NOT NULL), ',') AS factors
  FROM (SELECT repo, least(count(*) FILTER (score >= 5), 5) AS suspicious, CAST(sum(insertions + deletions) AS BIGINT) AS changes, bool_or(critical) AS critical, count(DISTINCT author) AS authors, count(*) AS commits, epoch(max(ts)) - epoch(min(ts)) AS spread FROM suspicion GROUP BY 1)""",
)
def f12(spark, d):
    return G.risk_score(scored_commits(spark, d))
