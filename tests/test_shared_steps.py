"""Steps that many queries share: lines are derived once, context is read from a window, few names are broadcast."""

from pyspark.sql import functions as F

from faultline.operators import blame as BL, classify as C, errors as E, mining as M
from faultline.plans import load
from faultline.sources import tables as T

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_context_is_that_of_a_join(small_chunks, log):
    lines = log("\n".join(f"l{i}" for i in range(1, 31)), "a\nb")
    points = small_chunks.createDataFrame([(1, 1, "X"), (1, 15, "X"), (1, 15, "Y"), (1, 30, "X"), (2, 2, "X")], "build_id bigint, at bigint, category string")
    got = {(r.build_id, r.at, r.category): [x.line_no for x in r.c] for r in E.context(points, lines, 10, 4).collect()}
    n = {1: 30, 2: 2}
    assert got == {(b, a, c): list(range(max(1, a - 10), min(n[b], a + 4) + 1)) for b, a, c in [tuple(r) for r in points.collect()]}


def test_lines_around_one_point_are_those_of_a_join(small_chunks, log):
    lines = log("\n".join(f"l{i}" for i in range(1, 31)), "a\nb", "c")
    points = small_chunks.createDataFrame([(1, 15), (2, 1), (3, 1)], "build_id bigint, at bigint")
    cols = ["build_id", "at", "line_no", "near_line"]
    got, want = (f(points, lines, 10, 8).select(cols).collect() for f in (E.around_point, E.around))
    assert sorted(got) == sorted(want) and len(got) == 19 + 2 + 1


def test_points_are_not_spelled_out_for_the_driver(spark):
    df = load().QUERIES["c20_context_line_labels"](spark, SF)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_log_lines_are_stored_once(spark):
    assert "l_partkey" not in _plan(load().QUERIES["d03_errors_from_end"](spark, SF))


def test_few_function_names_are_broadcast(log, spark):
    functions = spark.createDataFrame([("deploy", "vars/deploy.groovy", "")], "name string, path string, params string")
    found = M.library_functions(functions, log("calling deploy now\nother"))
    assert _plan(found).count("broadcast") == 2
    assert [tuple(r) for r in found.collect()] == [(1, "deploy", "vars/deploy.groovy", "")]


def test_output_lines_are_numbered_without_a_shuffle_of_their_own(small_chunks, log):
    text = "\n".join(["[Pipeline] sh", "+ make a", *[f"a{i}" for i in range(20)], "+ make b", "b0", "[Pipeline] echo", "x", "[Pipeline] sh", "c0", "+ make c", "c1"])
    owned = C.owned_lines(C.typed_lines(log(text)))
    got = sorted((r.cmd_line, r.out_no, r.output) for r in C.command_output(owned).collect())
    assert got == [(2, i + 1, f"a{i}") for i in range(20)] + [(23, 1, "b0"), (29, 1, "c1")]


def test_chosen_lines_are_not_worked_out_again_for_labels(spark):
    assert "finder" not in _plan(load().QUERIES["c20_context_line_labels"](spark, SF))


def test_fragments_of_a_chunk_lie_together(spark):
    parts = T.log_lines(spark, SF).withColumn("part", F.spark_partition_id()).groupBy("build_id").agg(F.count_distinct("part").alias("n"))
    assert parts.filter("n > 1").isEmpty()


def test_primary_line_with_and_without_a_weight(small_chunks, log):
    lines = log("ok\nERROR: one\n\tat a.b.C(\nlast \n ", "quiet\nstill quiet\n", "BUILD FAILURE\n[Pipeline] stage\n[Pipeline] { (B)\n\tat a.b.C(")
    got = {r.build_id: (r.finder_line, r.finder_text, r.scored) for r in E.primary_line(lines).collect()}
    assert got == {1: (2, "ERROR: one", True), 2: (2, "still quiet", False), 3: (4, "\tat a.b.C(", True)}


def test_facts_of_a_build_are_worked_out_once(spark, log):
    seen = []

    def counted(df):
        seen.append(set(df.columns))
        return df

    E.chosen_lines(log("[Pipeline] stage\n[Pipeline] { (B)\nERROR: one"), counted)
    assert {"build_id", "n_lines", "last_stage", "last_stage_line"} in seen


def test_rules_are_tried_on_few_lines_only(small_chunks, log, monkeypatch):
    quiet = "\n".join(f"quiet {i}" for i in range(20))
    lines = log(f"[Pipeline] {{ (Build)\n{quiet}\nRunning on agent-1\nquiet\nTool 'maven-3' not found\nNo such property: x for class: Lib")
    hits = M._hits
    quiet_fails = F.when(F.col("line").startswith("quiet"), F.raise_error(F.lit("a line without any fixed text was tried")).cast("string"))
    monkeypatch.setattr(M, "_hits", lambda line, rules: F.when(quiet_fails.isNull(), hits(line, rules)))
    assert [(r.line_no, r.stage, r.node, r.name) for r in M.config_issues(lines).collect()] == [(24, "Build", "agent-1", "maven-3")]
    assert [(r.line_no, r.kind) for r in M.groovy_errors(lines).collect()] == [(25, "missing_property")]


def test_a_bundle_works_facts_out_once_and_reads_outputs_in_a_scan(spark, log):
    facts = []

    def counted(df):
        if "last_stage" in df.columns:
            facts.append(df)
        return df

    text = "[Pipeline] stage\n[Pipeline] { (B)\n+ make a\nERROR: one\n\n+ make b\ncannot\nTraceback (most recent call last):\n  File \"a.py\", line 3, in f\nValueError: bad\n  File \"b.py\", line 4, in g\njava.lang.IllegalStateException: no\n\tat a.B.c(B.java:1)\n\tat a.B.d(B.java:2)"
    bundle = BL.evidence_bundle(log(text, "quiet"), counted)
    got = {(r.build_id, r.section, r.ord, r.line_no, r.text) for r in bundle.collect() if r.section != "error"}
    assert got == {
        (1, "stage", 1, 1, "B"), (1, "command", 1, 6, "make b"), (1, "command", 2, 3, "make a"),
        (1, "trace", 1, 8, "ValueError: bad"), (1, "trace", 2, 12, "java.lang.IllegalStateException: no"),
        (1, "trace", 3, 12, "IllegalStateException: no"),
    }
    errors = {r.line_no: r.text for r in bundle.collect() if r.section == "error"}
    lines = text.split("\n")
    assert errors and all(t == "\n".join(lines[max(0, n - 11) : n + 2]) for n, t in errors.items())
    assert len(facts) == 1
    assert "Join" not in _plan(BL.command_context(log(text)))


def test_context_of_deep_types_is_not_spelled_out(log):
    text = "\n".join(["no space left", *[f"l{i}" for i in range(9)], "java.io.IOException: Permission denied", "a", "b", "c", "unknown host", "404"])
    lines = log(text, "x\nERROR: one two three")
    found = E.deep_types(E.deep_primary_line(lines), lines)
    got = {(r.build_id, r.line_no, r.error_type, r.evidence) for r in found.collect()}
    assert got == {(1, 11, "PERMISSION_DENIED", "PERMISSION_DENIED:line,DISK_FULL:context,NETWORK_DNS:context"), (2, 2, "UNKNOWN", "")}
    plan = _plan(E.deep_types(lines.withColumn("n_lines", F.lit(1)), lines))
    assert "+ 4" in plan and "sequence(greatest" not in plan


def test_stage_patterns_run_where_their_text_is(small_chunks, log):
    text = "[Pipeline] stage\n[Pipeline] { (Build (QA))\n[Pipeline] sh\n+ make (all)\n[Pipeline] }\n[Pipeline] // stage\n[Pipeline] { (Old)\n[Pipeline] Stage \n[Pipeline] echo\nx\n[Pipeline] Named\n[Pipeline] {\n[Pipeline] { ()\n[pipeline] { (no)"
    marks = C.stage_markers(log(text))
    assert sorted((r.line_no, r.stage, r.form) for r in marks.collect()) == [(1, "Build (QA)", "declared"), (7, "Old", "legacy"), (8, "Named", "declared")]
    assert _plan(marks).count("regexp_extract(") <= 16  # each part of a marker is worked out once
