"""Documentation pages and Java sources: what they say about tools, as long tables of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import text as X
from faultline.functions.scan import top_per
from faultline.operators.mining import every

# Signs of a login page and of an error page.
LOGIN_TITLE = r"(?i)sign\s*in|log\s*in|login|authenticate|authorization"
LOGIN_INPUT = r"(?i)<input[^>]*type=[\"']password[\"']"
LOGIN_FORM = r"(?i)<form[^>]*(?:login|signin|sign-in|auth|sso)"
LOGIN_PHRASES = (
    "enter your password", "enter your username", "sign in to continue", "log in to continue", "authenticate to access",
    "please sign in", "please log in",
)
ERROR_PAGE = (
    r"404\s*[-:]\s*(?:not\s+found|page\s+not\s+found)", r"403\s*[-:]\s*(?:forbidden|access\s+denied)", r"401\s*[-:]\s*unauthorized",
    r"page\s+(?:not\s+found|does\s+not\s+exist)", r"you\s+don'?t\s+have\s+(?:access|permission)",
)
DOC_SIGNS = r"(?im)```|^\s*[$>]|--[\w-]+|[A-Z][A-Z0-9_]{2,}|(?:usage|example|command|install|configure)"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
DROPPED = ("script", "style", "nav", "header", "footer")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]+>", "")


def visible_html(html: Column) -> Column:
    """HTML without scripts, styles and page furniture."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def html_to_text(html: Column) -> Column:
    """Main content as text with Markdown marks for headings, list items and code."""
    body = visible_html(html)
    main = F.coalesce(X.extract(body, r"(?is)<main\b[^>]*>(.*?)</main>"), X.extract(body, r"(?is)<article\b[^>]*>(.*)</article>"), body)
    for level in (1, 2, 3, 4):
        main = F.regexp_replace(main, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    main = F.regexp_replace(main, r"(?i)<li\b[^>]*>", "\n\n- ")
    main = F.regexp_replace(main, r"(?i)<(?:pre|code)\b[^>]*>", "\n\n```\n")
    main = F.regexp_replace(main, r"(?i)</(?:pre|code)>", "\n```\n\n")
    main = F.regexp_replace(main, r"(?i)<(?:p|td|th|br|/p|/h[1-4]|/li)\b[^>]*>", "\n\n")
    return X.strip(F.regexp_replace(without_tags(main), r"\s*\n\s*\n\s*", "\n\n"))


def page_status(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    text = without_tags(html)
    title = F.coalesce(X.extract(html, TITLE), F.lit(""))
    low = F.lower(F.left(text, F.lit(2000)))
    asks = F.exists(F.array(*[F.lit(p) for p in LOGIN_PHRASES]), lambda p: low.contains(p))
    auth = title.rlike(LOGIN_TITLE) | html.rlike(LOGIN_INPUT) | html.rlike(LOGIN_FORM) | asks
    error = F.concat(title, F.lit(" "), F.left(text, F.lit(3000))).rlike(X.any_of(ERROR_PAGE, True))
    body = F.regexp_replace(without_tags(visible_html(html)), r"\s+", " ")
    full = (F.length(body) >= 100) & (html.rlike(r"(?i)<(?:code|pre)\b") | body.rlike(DOC_SIGNS) | (F.length(body) > 500))
    status = F.when(auth, "auth").when(error, "error").when(~full, "empty").otherwise("valid")
    return pages.select("page_id", status.alias("status"))


def page_title(html: Column, url: Column) -> Column:
    slug = F.regexp_replace(F.substring_index(F.regexp_replace(F.regexp_replace(url, r"^\w+://[^/]*", ""), r"[?#].*$|/+$", ""), "/", -1), r"\.[^.]+$", "")
    md = X.strip(X.extract(html, r"(?m)^#\s+(.+)$"))
    front = X.strip(X.extract(X.extract(html, r"(?s)^---\n(.*?)\n---"), r"title:\s*[\"']?([^\"'\n]+)"))
    return F.coalesce(X.extract(html, TITLE), X.strip(without_tags(X.extract(html, H1))), md, front, F.regexp_replace(slug, "[-_]", " "))


def page_type(pages: DataFrame) -> DataFrame:
    """Main page of a tool, page of a subcommand, reference or tutorial, with a confidence."""
    html, url = F.col("html"), F.col("url")
    text = without_tags(html)
    path = F.regexp_replace(F.regexp_replace(url, r"^\w+://[^/]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    sections = F.regexp_count(text, F.lit(r"(?im)^#{1,3}\s+\w+\s+(?:command|subcommand)"))
    codes = F.regexp_count(html, F.lit(r"(?i)<(?:code|pre)\b"))
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"(?i)^(?:commands|subcommands|cli|reference)$")), True).cast("int")
    in_commands = at > 1
    sub = F.when(in_commands, F.get(parts, at)).otherwise(F.when(F.size(parts) >= 2, F.element_at(parts, -1)))
    sub = F.when(sub.rlike(r"(?i)^[a-z][a-z0-9_-]*$") & ~sub.isin("index", "readme", "overview", "docs"), sub)
    is_sub = url.rlike(r"(?i)/(?:commands?|subcommands?|plugins?)/[\w-]+/?$") | (in_commands & (F.size(parts) > at))
    tool = F.when(in_commands, F.get(parts, at - 2)).when(F.size(parts) >= 2, F.element_at(parts, -2))
    one = lambda cond, w: F.when(cond, w).otherwise(0)
    main_points = (
        one(sections >= 3, 2) + one(codes >= 5, 1) + one(text.rlike(r"(?i)(?:commands?|subcommands?)\s+available"), 2)
        + one(text.rlike(r"(?i)table\s+of\s+contents"), 1)
    )
    h1 = X.strip(without_tags(F.coalesce(X.extract(html, H1), F.lit(""))))
    sub_points = (
        one(is_sub, 2) + one(sub.isNotNull(), 1) + one(sections <= 1, 1) + one(h1.rlike(r"(?i)^(?:the\s+)?\w+\s+(?:command|subcommand)"), 2)
    )
    d = pages.select("page_id", tool.alias("tool"), main_points.alias("m"), sub_points.alias("s"), F.concat(F.coalesce(X.extract(html, TITLE), F.lit("")), F.left(text, F.lit(500))).alias("head"))
    m, s = F.col("m"), F.col("s")
    kind = (
        F.when((m > s) & (m >= 2), "main_tool").when((s > m) & (s >= 2), "subcommand")
        .when(F.col("head").rlike(r"(?i)(?:api|cli|command)\s+reference"), "reference")
        .when(F.col("head").rlike(r"(?i)(?:tutorial|guide|how\s+to|getting\s+started)"), "tutorial").otherwise("unknown")
    )
    conf = F.when(kind.isin("main_tool", "subcommand"), F.least(F.lit(0.9), 0.5 + F.greatest(m, s) * 0.1)).otherwise(0.5)
    return d.select("page_id", "tool", kind.alias("kind"), F.round(conf, 6).alias("confidence"))


# ---- facts of documentation texts -------------------------------------------------------------

FENCE = r"(?s)```(?:bash|sh|shell|console)?\n(.*?)```"
ANY_FENCE = r"(?s)```(?:\w+)?\n(.*?)```"
INLINE = r"`([a-z][\w-]*(?:\s+[^\s`]+)+)`"
PROMPT = r"(?m)^\s*[$>]\s*(.+)$"
# Shell words that are no tools, and variables of the system.
SHELL_WORDS = ("cd", "echo", "export", "set", "if", "then", "fi", "for", "do", "done")
SYSTEM_VARIABLES = ("PATH", "HOME", "USER", "PWD", "SHELL", "TERM")
ERROR_SECTION = r"(?is)(?:^|\n)(?:#+\s*)?(?:error|exit)\s*codes?[:\s]*\n(.+?)(?:\n#[^#]|\z)"
ENV_SECTION = r"(?is)(?:^|\n)(?:#+\s*)?(?:environment|configuration|config|settings)[:\s]*\n(.+?)(?:\n#[^#]|\z)"
ARG_SECTION = r"(?is)(?:^|\n)(?:#+\s*)?(?:arguments?|options?|flags?|parameters?)[:\s]*\n(.+?)(?:\n#[^#]|\z)"
ERROR_FORMS = (
    r"(?i)(?:error|code|exit)[\s:]+([A-Z][A-Z0-9_]+)[\s:-]+(.+?)(?:\n|$)", r"\|\s*([A-Z][A-Z0-9_]+)\s*\|\s*([^|]+)\s*\|",
    r"[-*]\s*`?([A-Z][A-Z0-9_]+)`?[\s:-]+(.+?)(?:\n|$)",
)
ENV_FORMS = (r"([A-Z][A-Z0-9_]+)[\s:=]+(.+?)(?:\n|$)", r"\|\s*`?([A-Z][A-Z0-9_]+)`?\s*\|\s*([^|]+)\s*\|", r"export\s+([A-Z][A-Z0-9_]+)=(.*)")
ARG_FORMS = (r"(--?[\w-]+)(?:\s*[,=]\s*)?(?:<[^>]+>|[\w]+)?\s*[:\s]+(.+?)(?:\n|$)", r"\|\s*`?(--?[\w-]+)`?\s*\|\s*([^|]+)\s*\|")
DESCRIPTION = r"(?is)(?:^|\n)(?:#+\s*)?(?:description|overview|about|introduction)[:\s]*\n+(.+?)(?:\n#|\n\n|$)"


def doc_description(content: Column) -> Column:
    plain = F.filter(
        F.slice(F.transform(F.split(content, r"\n\n+"), lambda p: X.strip(p)), 1, 3),
        lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("```") & ~p.startswith("-"),
    )
    return F.left(F.coalesce(X.strip(X.extract(content, DESCRIPTION)), F.get(plain, F.lit(0)), F.lit("")), F.lit(500))


def _pairs(docs: DataFrame, text: Column, forms) -> DataFrame:
    """(name, text) pairs of all forms with their order: form first, then position."""
    def of_form(n: int, p: str) -> Column:
        zipped = F.arrays_zip(every(text, p, 1).alias("name"), every(text, p, 2).alias("about"))
        return F.transform(
            zipped,
            lambda x, i: F.struct(F.lit(n).alias("form"), i.alias("pos"), X.strip(x["name"]).alias("name"), X.strip(x["about"]).alias("about")),
        )

    items = [of_form(n, p) for n, p in enumerate(forms)]
    return docs.select("doc_id", F.explode(F.concat(*items)).alias("f")).select("doc_id", "f.*")


def _first_names(pairs: DataFrame, k: int) -> DataFrame:
    one = pairs.groupBy("doc_id", "name").agg(F.min(F.struct("form", "pos", "about")).alias("f"))
    return top_per(one, k, [F.col("f.form"), F.col("f.pos")], ["doc_id"]).select("doc_id", "rn", "name", F.left("f.about", F.lit(200)).alias("about"))


def doc_commands(docs: DataFrame, k: int = 20) -> DataFrame:
    c = F.col("content")

    def of_form(n: int, p: str) -> Column:
        return F.transform(every(c, p, 1), lambda t, i: F.struct(F.lit(n).alias("form"), i.alias("pos"), t.alias("t")))

    items = [of_form(n, p) for n, p in enumerate((FENCE, INLINE, PROMPT))]
    blocks = docs.select("doc_id", F.explode(F.concat(*items)).alias("b"))
    lines = blocks.select("doc_id", "b.form", "b.pos", F.posexplode(F.split(X.strip(F.col("b.t")), "\n")).alias("sub", "line"))
    bare = F.regexp_replace(X.strip(F.col("line")), r"^[$>]\s*", "")
    kept = lines.withColumn("line", X.strip(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("example", bare)
    named = kept.withColumn("name", F.regexp_extract("example", r"^(\S+)", 1)).filter((F.col("name") != "") & ~F.col("name").isin(*SHELL_WORDS))
    one = named.groupBy("doc_id", "example").agg(F.min(F.struct("form", "pos", "sub", "name")).alias("f"))
    order = [F.col("f.form"), F.col("f.pos"), F.col("f.sub")]
    return top_per(one, k, order, ["doc_id"]).select("doc_id", "rn", F.col("f.name").alias("name"), F.col("example").alias("about"))


def code_category(code: Column) -> Column:
    low = F.lower(code)
    rules = (
        ("auth|credential|token|login|permission", "CREDENTIAL"), ("connect|network|timeout|host|dns", "NETWORK"),
        ("config|invalid|missing|notfound", "CONFIGURATION"), ("build|compile", "BUILD"), ("test|assert", "TEST"),
    )
    out = None
    for p, name in rules:
        out = F.when(low.rlike(p), name) if out is None else out.when(low.rlike(p), name)
    return out.otherwise("TOOL_ERROR")


def doc_errors(docs: DataFrame, k: int = 30) -> DataFrame:
    c = F.col("content")
    pairs = _pairs(docs, F.coalesce(X.extract(c, ERROR_SECTION), c), ERROR_FORMS).filter(F.col("name").rlike(r"^[A-Z][A-Z0-9_]+$"))
    return _first_names(pairs, k).withColumn("category", code_category(F.col("name")))


def doc_env_vars(docs: DataFrame, k: int = 20) -> DataFrame:
    c = F.col("content")
    pairs = _pairs(docs, F.coalesce(X.extract(c, ENV_SECTION), c), ENV_FORMS)
    return _first_names(pairs.filter(F.col("name").rlike(r"^[A-Z][A-Z0-9_]+$") & ~F.col("name").isin(*SYSTEM_VARIABLES)), k)


def doc_arguments(docs: DataFrame, k: int = 30) -> DataFrame:
    c = F.col("content")
    pairs = _pairs(docs, F.coalesce(X.extract(c, ARG_SECTION), c), ARG_FORMS).filter(F.col("name").startswith("-"))
    return _first_names(pairs, k).withColumn("required", F.col("about").rlike(r"(?i)required|mandatory"))


def doc_examples(docs: DataFrame, k: int = 10) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(every(F.col("content"), ANY_FENCE)).alias("pos", "t")).withColumn("example", X.strip(F.col("t")))
    kept = rows.filter((F.col("example") != "") & (F.length("example") < 500))
    return top_per(kept, k, [F.col("pos")], ["doc_id"]).select("doc_id", "rn", "example")


def doc_facts(docs: DataFrame) -> DataFrame:
    """All facts of a corpus in one long table."""
    part = lambda df, kind: df.select("doc_id", F.lit(kind).alias("kind"), "rn", "name", "about")
    return (
        part(doc_commands(docs), "command").unionByName(part(doc_errors(docs), "error"))
        .unionByName(part(doc_env_vars(docs), "env")).unionByName(part(doc_arguments(docs), "argument"))
    )


def command_pattern(example: Column, tool: Column) -> Column:
    """First two plain words of a command, if they name the tool."""
    parts = X.words(example)
    # a word is plain if neither it nor a word before it is an option, a path, an assignment or a variable
    stop = F.array_position(F.transform(parts, lambda w: w.startswith("-") | w.contains("/") | w.contains("=") | w.startswith("$")), True)
    plain = F.when(stop > 0, F.slice(parts, F.lit(1), F.least(F.lit(2), stop.cast("int") - 1))).otherwise(F.slice(parts, 1, 2))
    pattern = F.array_join(plain, " ")
    return F.when((pattern != "") & F.lower(pattern).contains(F.lower(tool)), pattern)


def docs_to_tools(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """A tool definition per page: name from its first command, patterns, and a confidence from what was found."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    per = facts.groupBy("doc_id").agg(
        F.min_by("name", F.when(F.col("kind") == "command", F.col("rn"))).alias("tool"),
        n("command").alias("commands"), n("error").alias("errors"), n("env").alias("env_vars"), n("argument").alias("arguments"),
    )
    head = docs.select("doc_id", F.coalesce(X.strip(X.extract(F.col("content"), r"(?m)^#\s+(.+)$")), F.lit("")).alias("title"), doc_description(F.col("content")).alias("description"))
    cap = lambda c, most: F.least(F.lit(most), F.col(c) * 0.05)
    score = (
        F.when(F.col("title") != "", 0.1).otherwise(0.0) + F.when(F.col("description") != "", 0.2).otherwise(0.0)
        + cap("commands", 0.2) + cap("errors", 0.2) + cap("env_vars", 0.15) + cap("arguments", 0.15)
    )
    named = head.join(per, "doc_id", "left").na.fill(0, ["commands", "errors", "env_vars", "arguments"])
    tools = named.withColumn("name", F.lower(F.coalesce("tool", F.regexp_extract("title", r"(\S+)", 1))))
    pats = (
        facts.filter("kind = 'command'").join(tools.select("doc_id", F.col("name").alias("tool_name")), "doc_id")
        .select("doc_id", command_pattern(F.col("about"), F.col("tool_name")).alias("p")).filter("p is not null").distinct()
        .groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("p")), "|").alias("patterns"))
    )
    return tools.join(pats, "doc_id", "left").select("doc_id", "name", "description", "patterns", F.round(F.least(score, F.lit(1.0)), 6).alias("confidence"))


def search_docs(docs: DataFrame, text: str, columns=("content",), k: int | None = None) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    out = docs.filter(hit)
    return out.orderBy("doc_id").limit(k) if k else out


# ---- Java sources -----------------------------------------------------------------------------

CLI_WORDS = r"cli|command|shell|terminal|args|commandline|console"


def java_entry_points(sources: DataFrame, k: int = 10) -> DataFrame:
    c = F.col("content")
    shell_, pico = c.contains("@ShellComponent"), c.contains("@Command") & F.lower(c).contains("picocli")
    cli = c.contains("public static void main") & F.lower(c).rlike(CLI_WORDS)
    kind = F.when(shell_, "spring_shell").when(pico, "picocli").when(cli, "main")
    rows = sources.filter(F.col("path").endswith(".java")).withColumn("framework", kind).filter("framework is not null")
    return top_per(rows, k, [F.col("path")], ["repo"]).select("repo", "rn", "path", "framework")


SHELL_METHOD = r"@ShellMethod\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"'](?:\s*,\s*key\s*=\s*[\"']([^\"']+)[\"'])?"
PICO_COMMAND = r"@Command\s*\((?:[^)]*name\s*=\s*[\"']([^\"']+)[\"'])?(?:[^)]*description\s*=\s*[\"']([^\"']+)[\"'])?"
PICO_OPTION = r"@Option\s*\(\s*names\s*=\s*\{?\s*([^})]+)\}?(?:[^)]*description\s*=\s*[\"']([^\"']+)[\"'])?(?:[^)]*required\s*=\s*(true|false))?"
SHELL_OPTION = r"(@ShellOption\s*\([^)]*\)\s*[\w<>\[\]]+\s+\w+)"


def kebab(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "(.)([A-Z][a-z]+)", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2"))


def java_commands(sources: DataFrame) -> DataFrame:
    c = F.col("content")
    zip2 = lambda p, kind, name, about: F.transform(
        F.arrays_zip(every(c, p, name).alias("name"), every(c, p, about).alias("about")),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), x["about"].alias("about")),
    )
    options = F.transform(every(c, SHELL_OPTION), lambda t: F.struct(
        F.lit("option").alias("kind"), F.concat(F.lit("--"), kebab(F.regexp_extract(t, r"(\w+)$", 1))).alias("name"),
        F.regexp_extract(t, r"help\s*=\s*[\"']([^\"']+)[\"']", 1).alias("about")))
    pico_options = F.transform(every(c, PICO_OPTION), lambda t: F.struct(
        F.lit("option").alias("kind"), F.btrim(F.split(t, ",")[0], F.lit(" \"'")).alias("name"), F.lit("").alias("about")))
    found = F.concat(zip2(SHELL_METHOD, "command", 2, 1), zip2(PICO_COMMAND, "command", 1, 2), options, pico_options)
    rows = sources.filter(F.col("path").endswith(".java")).select("repo", "file_id", F.explode(found).alias("f"))
    return rows.select("repo", "file_id", "f.*").filter("name <> ''")


THROW = r"throw\s+new\s+(\w+(?:Exception|Error))\s*\(\s*[\"']([^\"']+)[\"']"
CODE = r"([A-Z][A-Z0-9_]+(?:_ERROR|_FAILED|_EXCEPTION)?)"
CONSTANT = r"(?:public\s+)?(?:static\s+)?(?:final\s+)?String\s+(\w*(?:ERROR|CODE|ERR)\w*)\s*=\s*[\"']([^\"']+)[\"']"


def java_category(text: Column) -> Column:
    low = F.lower(text)
    rules = (
        ("auth|credential|token|login|permission|denied|forbidden", "CREDENTIAL"),
        ("connect|network|timeout|unreachable|host|socket|dns", "NETWORK"),
        ("config|property|setting|invalid|missing|required|file|path|directory|notfound|not found|exist", "CONFIGURATION"),
        ("build|compile|maven|gradle", "BUILD"), ("test|assert|expect", "TEST"),
    )
    out = None
    for p, name in rules:
        out = F.when(low.rlike(p), name) if out is None else out.when(low.rlike(p), name)
    return out.otherwise("TOOL_ERROR")


def java_errors(sources: DataFrame) -> DataFrame:
    """Thrown errors, one per repository and code."""
    c = F.col("content")
    pairs = F.arrays_zip(every(c, THROW, 1).alias("cls"), every(c, THROW, 2).alias("msg"))
    rows = sources.filter(F.col("path").endswith(".java")).select("repo", "file_id", F.posexplode(pairs).alias("pos", "e"))
    code = F.coalesce(X.extract(F.col("e.msg"), CODE), F.upper("e.cls"))
    rows = rows.select("repo", code.alias("code"), F.struct("file_id", "pos", F.col("e.cls").alias("cls"), F.col("e.msg").alias("msg")).alias("r"))
    one = rows.groupBy("repo", "code").agg(F.min("r").alias("r"))
    return one.select("repo", "code", F.col("r.file_id").alias("file_id"), F.col("r.cls").alias("exception"), F.col("r.msg").alias("message"), java_category(F.concat_ws(" ", "r.cls", "r.msg")).alias("category"))


def java_exit_codes(sources: DataFrame) -> DataFrame:
    """Exit codes with the error thrown in the 500 characters before."""
    c = F.col("content")
    form = r"(?s)(.{0,500})System\.exit\s*\(\s*(\d+)\s*\)"
    pairs = F.arrays_zip(every(c, form, 1).alias("before"), every(c, form, 2).alias("code"))
    rows = sources.filter(c.contains("System.exit")).select("repo", "file_id", F.explode(pairs).alias("e"))
    return rows.select(
        "repo", "file_id", F.col("e.code").cast("bigint").alias("exit_code"),
        F.element_at(F.concat(F.array(F.lit("")), every(F.col("e.before"), THROW, 2)), -1).alias("message"),
    ).withColumn("code", X.extract(F.col("message"), CODE))


def java_mentions(sources: DataFrame) -> DataFrame:
    """Log tags, environment variables and error constants of Java files."""
    c = F.col("content")
    tag = lambda kind, p, g=1: F.transform(every(c, p, g), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = F.concat(
        tag("log", r"(?:logger|log|LOG)\s*\.\s*(?:error|warn|info)\s*\(\s*[\"'](\[[^\]\"']+\])"),
        tag("env", r"(?:System\.getenv|getenv|Environment\.get)\s*\(\s*[\"']([A-Z_][A-Z0-9_]+)[\"']"),
        tag("env", r"\$\{([A-Z_][A-Z0-9_]+)(?::[^}]*)?\}"), tag("constant", CONSTANT, 2),
    )
    rows = sources.filter(F.col("path").endswith(".java")).select("repo", F.explode(found).alias("f"))
    return rows.select("repo", "f.*").distinct()


def java_to_tool(sources: DataFrame) -> DataFrame:
    """One tool row per repository with a confidence from what its sources show."""
    count = lambda df, out: df.groupBy("repo").agg(F.count("*").alias(out))
    commands = java_commands(sources).filter("kind = 'command'")
    said = java_mentions(sources)
    d = (
        sources.select("repo").distinct().join(count(commands, "commands"), "repo", "left").join(count(java_errors(sources), "errors"), "repo", "left")
        .join(count(java_entry_points(sources), "entries"), "repo", "left").join(count(said.filter("kind = 'env'"), "envs"), "repo", "left")
        .join(count(said.filter("kind = 'log'"), "logs"), "repo", "left").na.fill(0)
    )
    score = (
        F.lit(0.2) + F.least(F.lit(0.3), F.col("commands") * 0.1) + F.least(F.lit(0.2), F.col("errors") * 0.05)
        + F.when(F.col("entries") > 0, 0.15).otherwise(0.0) + F.when(F.col("envs") > 0, 0.1).otherwise(0.0) + F.when(F.col("logs") > 0, 0.05).otherwise(0.0)
    )
    return d.withColumn("confidence", F.round(F.least(score, F.lit(1.0)), 6))
