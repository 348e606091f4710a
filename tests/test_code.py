"""Shared-library names, brackets, call forms and walks on literal Groovy sources."""

import pytest

from faultline.operators import mining as M
from faultline.plans import load

CODE = {
    "vars/deploy.groovy": "def call(Map config, List targets = [1, 2],\n    Closure body = pick(a, (b))) {\n  build(config)\n}\ndef helper() { }",
    "vars/build.groovy": "def call(Map<String, List> config) {\n  test(config, 'x')\n}",
    "src/org/Util.groovy": "def call(x) { }\ndef test(a, b = f(1, 2)) { deploy(a) }",
    "Jenkinsfile": "deploy(env: pick(1, 2), targets: [1, 2])\n  deploy config, [1, 2], { it }\nbuild {\n}\nx = build(a)\ndeploy.call(1)\ntest 'a', f(1, 2)",
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(7, i, p, c) for i, (p, c) in enumerate(CODE.items())], "repo long, file_id long, path string, content string")


def test_call_in_a_file_of_globals_goes_by_its_name(sources):
    got = {(r.path, r.name): r.params for r in M.definitions(sources).collect()}
    assert got == {
        ("vars/deploy.groovy", "deploy"): ["Map config", "List targets = [1, 2]", "Closure body = pick(a, (b))"], ("vars/deploy.groovy", "helper"): [],
        ("vars/build.groovy", "build"): ["Map<String, List> config"], ("src/org/Util.groovy", "call"): ["x"], ("src/org/Util.groovy", "test"): ["a", "b = f(1, 2)"],
    }


def test_call_forms(sources):
    got = [(r.line_no, r.name, r.args) for r in M.call_sites(sources.where("path = 'Jenkinsfile'")).collect()]
    assert (1, "deploy", ["env: pick(1, 2)", "targets: [1, 2]"]) in got
    assert (3, "build", []) in got and (5, "build", ["a"]) in got and (7, "test", ["'a'", "f(1, 2)"]) in got and (2, "deploy", ["config", "[1, 2]"]) in got
    assert not any(n == "call" for _, n, _ in got)


def test_steps_with_a_closure_argument_end_before_it(spark):
    code = spark.createDataFrame([(1, 1, "Jenkinsfile", "deploy config, 'x'\n  run 'a', [b: 1, c: 2], true\nretries = 3\nreturn x, y")], "repo long, file_id long, path string, content string")
    assert sorted((r.line_no, r.name, r.args) for r in M.call_sites(code).collect()) == [(1, "deploy", ["config", "'x'"]), (2, "run", ["'a'", "[b: 1, c: 2]", "true"])]


def test_mismatches_of_both_kinds(spark, sources):
    missing = M.missing_methods(spark.createDataFrame([("groovy.lang.MissingMethodException: No signature of method: build.call() is applicable",), ("No signature of method: Lib.build() is",), ("x",)], "line string"))
    assert sorted(r.name for r in missing.collect()) == ["build", "call"]
    got = {(r.name, r.line_no, r.given, r.defined, r.kind) for r in M.signature_mismatch(M.call_sites(sources), M.definitions(sources), missing).collect()}
    assert ("deploy", 1, 2, 3, "argument_count") in got and ("build", 3, 0, 1, "argument_count") in got and ("build", 5, 1, 1, "missing_method") in got
    compared = {(r.line_no, r.missing, r.extra) for r in M.compare_parameters(M.call_sites(sources), M.definitions(sources)).collect()}
    assert compared == {(1, "config", "env")}


def test_walks_go_on_until_nothing_is_new(spark, sources):
    edges = {(r.src, r.dst) for r in M.call_graph(sources).collect()}
    assert {("deploy", "build"), ("build", "test"), ("test", "deploy")} <= edges
    ring = spark.createDataFrame([(1, f"n{i}", f"n{(i + 1) % 6}") for i in range(6)], "repo long, src string, dst string")
    starts = spark.createDataFrame([(1, "n2")], "repo long, start string")
    stored = []
    got = {r.node: r.depth for r in M.reach(ring, starts, 10, lambda df: stored.append(1) or df).collect()}
    assert got == {f"n{(2 + k) % 6}": k for k in range(6)} and len(stored) == 6


def test_functions_that_a_log_names(spark, sources):
    functions = M.global_functions(sources)
    assert {r.name for r in functions.collect()} == {"deploy", "helper", "build"}
    lines = spark.createDataFrame([
        (1, 1, "\tat org.codehaus.groovy.runtime.CallSite.call(CallSite.java:4)"), (1, 2, "\tat lib.vars.other.run(other.groovy:1)"), (1, 3, "\tat lib.vars.build.call(build.groovy:12)"),
        (1, 4, "\tat lib.vars.deploy.call(deploy.groovy:3)"), (2, 1, "  at Script3.mystery(Script3.groovy:1)"), (2, 2, "going to deploy, then deploy"), (3, 1, "undeployed"),
    ], "build_id long, line_no long, line string")
    named = {(r.build_id, r.name, r.path) for r in M.library_functions(functions, lines).collect()}
    assert named == {(1, "build", "vars/build.groovy"), (1, "deploy", "vars/deploy.groovy"), (2, "deploy", "vars/deploy.groovy"), (2, "mystery", "unknown")}
    cause = [(r.build_id, r.name, r.path, r.src_line) for r in M.root_cause_function(lines, functions).collect()]
    assert cause == [(1, "build", "vars/build.groovy", 12)]


@pytest.mark.parametrize("name", ["e17_call_chain", "e19_signature_mismatch", "e20_compare_parameters", "k15_library_functions", "k16_root_cause_function", "k22_signature_index"])
def test_queries_have_rows(spark, name):
    assert load().QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
