"""Operators on small literal logs."""

from pyspark.sql import functions as F

from faultline.functions import text as X
from faultline.operators import blame, classify as C, commits as G, corpus as L, errors as E, records as R, search as S, traces as TR
from faultline.rules import errors as RE
from faultline.sources import rules as UR


def one(df, col):
    return [r[col] for r in df.collect()]


def test_two_line_stage_with_blanks_between(log):
    m = C.stage_markers(log("12:00:00  [Pipeline]  stage\n\n[Pipeline]   { (Build & Test)  \nx")).collect()
    assert [(r.line_no, r.stage, r.form) for r in m] == [(1, "Build & Test", "declared")]


def test_nested_brackets_and_rejected_names(log):
    text = "[Pipeline] { (Deploy (QA))  \n[Pipeline] stage\n[Pipeline] echo\n[Pipeline] // stage"
    m = C.stage_markers(log(text)).collect()
    assert [(r.line_no, r.stage, r.form) for r in m] == [(1, "Deploy (QA)", "legacy")]


def test_early_checkout_failure_is_preferred(log, spark):
    lines = [f"line {i}" for i in range(1, 101)]
    lines[2] = "fatal: Couldn't find any revision to build."
    lines[90] = "npm ERR! code 1"
    text = log("\n".join(lines))
    first = spark.createDataFrame([(1, 3, lines[2], "TOOL_ERROR", 2)], "build_id bigint, parser_line bigint, parser_text string, parser_category string, n_errors bigint")
    primary = spark.createDataFrame([(1, 100, None, 91, lines[90], 9, True)], "build_id bigint, n_lines bigint, last_stage string, finder_line bigint, finder_text string, score int, scored boolean")
    r = E.reconcile(primary, first).first()
    assert (r.chosen_line, r.chosen_source) == (3, "parser_early_scm")
    assert E.chosen_lines(text).first().chosen_line == 3


def test_commands_and_their_output(log):
    text = "[Pipeline] sh\n09:00:01 + aws s3 cp a b\nsome output\nexit code: 2\n[Pipeline] }\n$ docker ps\n10:00:00   curl -s x"
    got = {r.cmd_line: (r.tool, r.exit_code, r.n_out) for r in C.invocations(log(text)).collect()}
    assert got == {2: ("aws", 2, 2), 6: ("docker", None, 0), 7: ("curl", None, 0)}


def test_tool_names(spark):
    cases = {"/usr/bin/abc --f": "abc", "VAR=1 abc x": "abc", '"abc" --file': "abc", "A=1": "A", "'my tool' x": "my"}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", X.tool_name(F.col("c")).alias("t"))
    assert {r.c: r.t for r in df.collect()} == cases


def test_a_report_of_the_newest_errors_keeps_a_line_whole(log):
    newest = lambda text: E.errors_from_end(log(text), 20).count()
    assert newest("\n".join(f"ERROR: connection refused {i}" for i in range(30))) == 20
    # the last line reached brings all of its categories
    assert newest("\n".join(["ERROR: connection refused x"] + [f"npm ERR! {i}" for i in range(19)])) == 21


def test_all_errors_are_kept(log):
    long = "x" * 150
    text = "\n".join(
        ["npm ERR! early", "npm ERR! both", "[Pipeline] stage", "[Pipeline] { (Test)"] + [f"npm ERR! {long} {i}" for i in range(40)] + ["  npm ERR! both "]
    )
    got = {(r.line_no, r.origin) for r in E.parsed_errors(log(text)).collect()}
    assert got == {(1, "whole"), (45, "focus")} | {(n, "focus") for n in range(5, 45)}


def test_python_and_go_traces(log):
    py = 'Traceback (most recent call last):\n  File "a.py", line 3, in f\n    x()\nValueError: bad\n'
    go = "panic: boom\n\ngoroutine 1 [running]:\nmain.f()\n\t/x.go:3\n\n"
    got = {(r.build_id, r.lang, r.exception, r.message, r.frames) for r in TR.stack_traces(log(py, go)).collect()}
    assert got == {(1, "python", "ValueError", "bad", 1), (2, "go", "Unknown", "boom", 2)}


def test_required_texts_never_hide_a_match(spark):
    lines = [
        "tests failed", "Time out", "timedout", "npm ERR! x", "HTTP 401 Unauthorized", "✗ step", "Error", "a SSL handshake error", "vars/x.groovy was not found",
        "pip install error", "FAILED  [x]", "expected:<1> but was:<2>", "couldnt find any revision", "env X is not defined", "$A is null",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    patterns = [p for ps in RE.CATEGORY_PATTERNS.values() for p in ps] + [p for _, _, ps in RE.DEEP_TYPES for p in ps]
    for p in patterns:
        texts = X.required_text(p)
        if texts is None:
            continue
        hits = one(df.filter(F.col("line").rlike("(?i)" + p)), "line")
        assert all(any(t in h.lower() for t in texts) for h in hits), p


def test_hash_and_dedupe(spark):
    rows = [(1, 1, "a" * 20, "b" * 20, "c"), (2, 2, "a" * 20, "b" * 20, "c"), (3, 1, "z" * 20, "b" * 20, None)]
    df = spark.createDataFrame(rows, "id bigint, precedence int, error_snippet string, root_cause string, fix string")
    kept = R.dedupe_examples(df.withColumn("content_hash", R.content_hash())).collect()
    assert sorted((r.id, r.skipped) for r in kept) == [(1, 1), (3, 0)]


def test_files_match_by_name_and_suffix(spark):
    changed = spark.createDataFrame([(1, "src/xfoo.py"), (1, "a/b/c.java"), (1, "d.txt")], "repo bigint, path string")
    wanted = spark.createDataFrame([(1, "foo.py"), (1, "z/c.java"), (1, "b/c.java"), (2, "d.txt")], "repo bigint, path string")
    got = {(r.path, r.error_file) for r in G.files_match(changed, wanted).collect()}
    assert got == {("src/xfoo.py", "foo.py"), ("a/b/c.java", "z/c.java"), ("a/b/c.java", "b/c.java")}


def test_login_and_error_pages(spark):
    pages = spark.createDataFrame(
        [(1, '<title>Sign in</title>'), (2, '<input type="password">'), (3, "<title>x</title>404 - not found"), (4, "<p>short</p>"), (5, "<p>" + "usage of the tool " * 20 + "</p>")],
        "page_id bigint, html string",
    )
    assert {r.page_id: r.status for r in L.page_status(pages).collect()} == {1: "auth", 2: "auth", 3: "error", 4: "empty", 5: "valid"}


def test_html_keeps_structure(spark):
    html = "<nav>x</nav><main><h1>Tool</h1><p>Does <b>it</b></p><ul><li>one</li></ul><pre>run</pre></main><footer>y</footer>"
    text = spark.createDataFrame([(html,)], "h string").select(L.html_to_text(F.col("h")).alias("t")).first().t
    assert text == "# Tool\n\nDoes it\n\n- one\n\n```\nrun\n```"


def test_documentation_facts(spark):
    content = "# Tool\n\nIt deploys.\n\n```bash\na2l deploy --env x\ncd /tmp\n```\n## Error Codes\n| A2L_AUTH | no token |\n\n# Options\n"
    docs = spark.createDataFrame([(1, content)], "doc_id bigint, content string")
    assert [(r.name, r.about) for r in L.doc_commands(docs).collect()] == [("a2l", "a2l deploy --env x")]
    assert [(r.name, r.category) for r in L.doc_errors(docs).collect()] == [("A2L_AUTH", "CREDENTIAL")]
    tool = L.docs_to_tools(docs, L.doc_facts(docs)).first()
    assert (tool.name, tool.patterns, tool.description) == ("a2l", "a2l deploy", "It deploys.")


def test_a_bad_user_pattern_is_left_out(spark):
    assert UR.register_rules(spark, {"mine": ["ok", "bad["]}) == ({"MINE": ("ok",)}, ["bad["])


def test_normalized_source(spark):
    df = spark.createDataFrame([("h", "/job/a//job/us-east-12/job/b/77/console")], "host string, src string")
    assert df.select(S.normalize_src(F.col("src"), F.col("host")).alias("s")).first().s == "/job/a/job/b"
