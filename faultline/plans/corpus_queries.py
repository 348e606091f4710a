"""Queries on documentation pages and Java sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import corpus as L
from faultline.plans import mining_queries, oracle as O
from faultline.plans.oracle import any_hit, cte, extract, hit, q, strip
from faultline.plans.registry import query
from faultline.sources import code as S, tables as T

_NOTAG = lambda c: f"regexp_replace({c}, '(?s)<[^>]+>', '', 'g')"
_VIS = "html"
for _t in L.DROPPED:
    _VIS = f"regexp_replace({_VIS}, '(?is)<{_t}\\b[^>]*>.*?</{_t}>', '', 'g')"
_VIS = f"regexp_replace({_VIS}, '(?s)<!--.*?-->', '', 'g')"


@query("a11_read_pages", "SELECT page_id, length(html) AS chars FROM pages")
def a11(spark, d):
    return T.pages(spark, d).select("page_id", F.length("html").cast("bigint").alias("chars"))


_LOW = f"lower(left({_NOTAG('html')}, 2000))"
_AUTH = f"({hit('title', L.LOGIN_TITLE)} OR {hit('html', L.LOGIN_INPUT)} OR {hit('html', L.LOGIN_FORM)} OR " + " OR ".join(f"contains({_LOW}, {q(p)})" for p in L.LOGIN_PHRASES) + ")"
_BODY = f"regexp_replace({_NOTAG(_VIS)}, '\\s+', ' ', 'g')"


@query(
    "l01_page_status",
    f"""SELECT page_id, CASE WHEN {_AUTH} THEN 'auth' WHEN {any_hit(f"title || ' ' || left({_NOTAG('html')}, 3000)", L.ERROR_PAGE, True)} THEN 'error'
    WHEN NOT (length({_BODY}) >= 100 AND ({hit("html", r"(?i)<(?:code|pre)\b")} OR {hit(_BODY, L.DOC_SIGNS)} OR length({_BODY}) > 500)) THEN 'empty' ELSE 'valid' END AS status
  FROM (SELECT *, coalesce({extract("html", L.TITLE)}, '') AS title FROM pages)""",
)
def l01(spark, d):
    return L.page_status(T.pages(spark, d))


@query("l02_html_to_text")
def l02(spark, d):
    return T.pages(spark, d).select("page_id", L.html_to_text(F.col("html")).alias("text"))


_SLUG = "regexp_replace(regexp_replace(string_split(regexp_replace(regexp_replace(url, '^\\w+://[^/]*', ''), '[?#].*$|/+$', '', 'g'), '/')[-1], '\\.[^.]+$', ''), '[-_]', ' ', 'g')"


@query("l03_page_title", f"SELECT page_id, coalesce({extract('html', L.TITLE)}, {strip(_NOTAG(extract('html', L.H1)))}, {_SLUG}) AS title FROM pages")
def l03(spark, d):
    return T.pages(spark, d).select("page_id", L.page_title(F.col("html"), F.col("url")).alias("title"))


@query("l04_page_type")
def l04(spark, d):
    return L.page_type(T.pages(spark, d))


cte(
    "doc_pages",
    f"SELECT doc_id, source AS site, replace({q(S.DOC_FRAME[0])}, '{{k}}', CAST(doc_id % 50 AS VARCHAR)) || regexp_replace(text, '\\s+', ' ', 'g') || replace({q(S.DOC_FRAME[1])}, '{{k}}', CAST(doc_id % 50 AS VARCHAR)) AS content FROM documents",
)


@query("l05_doc_description")
def l05(spark, d):
    return S.doc_pages(spark, d).select("doc_id", L.doc_description(F.col("content")).alias("description"))


@query("l06_doc_commands")
def l06(spark, d):
    return L.doc_commands(S.doc_pages(spark, d))


def pairs_sql(section: str, forms, keep: str, k: int, extra: str = "") -> str:
    text = f"coalesce({extract('content', section)}, content)"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS form, unnest(range(len(regexp_extract_all(t, {q(p)}, 1)))) AS pos, {strip(f'unnest(regexp_extract_all(t, {q(p)}, 1))')} AS name, {strip(f'unnest(regexp_extract_all(t, {q(p)}, 2))')} AS about FROM (SELECT doc_id, {text} AS t FROM doc_pages)"
        for n, p in enumerate(forms)
    )
    return (
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY form, pos) AS rn, name, left(about, 200) AS about{extra} FROM (SELECT * FROM ({parts}) WHERE {keep} "
        f"QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY form, pos) = 1) QUALIFY rn <= {k}"
    )


_CAT = "CASE WHEN regexp_matches(lower(name), 'auth|credential|token|login|permission') THEN 'CREDENTIAL' WHEN regexp_matches(lower(name), 'connect|network|timeout|host|dns') THEN 'NETWORK' WHEN regexp_matches(lower(name), 'config|invalid|missing|notfound') THEN 'CONFIGURATION' WHEN regexp_matches(lower(name), 'build|compile') THEN 'BUILD' WHEN regexp_matches(lower(name), 'test|assert') THEN 'TEST' ELSE 'TOOL_ERROR' END"


@query("l07_doc_errors", pairs_sql(L.ERROR_SECTION, L.ERROR_FORMS, "regexp_matches(name, '^[A-Z][A-Z0-9_]+$')", 30, f", {_CAT} AS category"))
def l07(spark, d):
    return L.doc_errors(S.doc_pages(spark, d))


@query("l08_doc_env_vars", pairs_sql(L.ENV_SECTION, L.ENV_FORMS, f"regexp_matches(name, '^[A-Z][A-Z0-9_]+$') AND NOT list_contains({O.values(L.SYSTEM_VARIABLES)}, name)", 20))
def l08(spark, d):
    return L.doc_env_vars(S.doc_pages(spark, d))


@query("l09_doc_arguments", pairs_sql(L.ARG_SECTION, L.ARG_FORMS, "starts_with(name, '-')", 30, ", regexp_matches(about, '(?i)required|mandatory') AS required"))
def l09(spark, d):
    return L.doc_arguments(S.doc_pages(spark, d))


@query(
    "l10_doc_examples",
    f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, example FROM (SELECT doc_id, unnest(range(len(x))) AS pos, {strip('unnest(x)')} AS example FROM (SELECT doc_id, regexp_extract_all(content, {q(L.ANY_FENCE)}, 1) AS x FROM doc_pages)) WHERE example <> '' AND length(example) < 500 QUALIFY rn <= 10",
)
def l10(spark, d):
    return L.doc_examples(S.doc_pages(spark, d))


@query("l14_docs_to_tools")
def l14(spark, d):
    docs = S.doc_pages(spark, d)
    return L.docs_to_tools(docs, L.doc_facts(docs))


@query("l15_search_docs", "SELECT doc_id FROM documents WHERE contains(lower(text), 'que')")
def l15(spark, d):
    return L.search_docs(T.documents(spark, d), "que", ("text",)).select("doc_id")


@query(
    "l16_java_entry_points",
    f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn, path, framework FROM (SELECT repo, path, CASE WHEN contains(content, '@ShellComponent') THEN 'spring_shell' WHEN contains(content, '@Command') AND contains(lower(content), 'picocli') THEN 'picocli' WHEN contains(content, 'public static void main') AND regexp_matches(lower(content), {q(L.CLI_WORDS)}) THEN 'main' END AS framework FROM sources WHERE ends_with(path, '.java')) WHERE framework IS NOT NULL QUALIFY rn <= 10",
)
def l16(spark, d):
    return L.java_entry_points(S.sources(spark, d))


@query("l17_java_commands")
def l17(spark, d):
    return L.java_commands(S.sources(spark, d))


@query(
    "l18_java_errors",
    f"SELECT repo, code, arg_min(file_id, file_id) AS file_id, arg_min(cls, file_id) AS exception, arg_min(msg, file_id) AS message FROM (SELECT repo, file_id, cls, msg, coalesce({extract('msg', L.CODE)}, upper(cls)) AS code FROM (SELECT repo, file_id, unnest(regexp_extract_all(content, {q(L.THROW)}, 1)) AS cls, unnest(regexp_extract_all(content, {q(L.THROW)}, 2)) AS msg FROM sources WHERE ends_with(path, '.java'))) GROUP BY ALL",
)
def l18(spark, d):
    return L.java_errors(S.sources(spark, d)).drop("category")


@query("l19_java_exit_codes")
def l19(spark, d):
    return L.java_exit_codes(S.sources(spark, d))


_MEN = " UNION ".join(
    f"SELECT repo, {q(k)} AS kind, unnest(regexp_extract_all(content, {q(p)}, {g})) AS value FROM sources WHERE ends_with(path, '.java')"
    for k, p, g in (
        ("log", r"(?:logger|log|LOG)\s*\.\s*(?:error|warn|info)\s*\(\s*[\"'](\[[^\]\"']+\])", 1),
        ("env", r"(?:System\.getenv|getenv|Environment\.get)\s*\(\s*[\"']([A-Z_][A-Z0-9_]+)[\"']", 1),
        ("env", r"\$\{([A-Z_][A-Z0-9_]+)(?::[^}]*)?\}", 1), ("constant", L.CONSTANT, 2),
    )
)


@query("l20_java_mentions", f"SELECT repo, kind, value FROM ({_MEN})")
def l20(spark, d):
    return L.java_mentions(S.sources(spark, d))


@query("l21_java_to_tool")
def l21(spark, d):
    return L.java_to_tool(S.sources(spark, d))
