"""Patterns written for RE2 find what Java finds, in odd texts too; stored lines lie by build and chunk."""

import random

from pyspark.sql import functions as F

from faultline.functions import text as X
from faultline.functions.patterns import re2_form
from faultline.operators import classify as C, errors as E
from faultline.rules import errors as R, shell, triage as TG
from faultline.sources import tables as T

SF = "/root/testdata/sf0.001"
BITS = (
    "error", "Error", "ERROR:", ":", " ", "\t", "\x0b", "\r", "\n", "\x85", " ", "K", "ſ", "é", "✗", "K", "s", "FAILED", "failed", "test", "not found", "[", "]", "1", "x", "fatal", "git",
    "timed", "out", "exit code ", "kubectl ", "+ ", "a2l", "taſk", "npm ERR!", "Exception", "java.", "at ", "(", "\\", "$", "", "password=", "revision", "repository", "script", "\U0001f600", "TS12",
)


def _rules():
    groups = [*R.CATEGORY_PATTERNS.values(), *[[p] for p, _ in R.LINE_WEIGHTS], *[[p] for p, _ in R.SCM_WEIGHTS], *[p for _, _, p in R.DEEP_TYPES]]
    groups += [[p] for _, p in shell.TOOL_LINES] + [list(shell.OUTPUT_FAILURE), list(shell.NOISE_LINES)] + [[p] for p, *_ in TG.KNOWN_FAILURES]
    return [g for g in groups if g] + [[r"\bs\b"], [r"k$"], [r"[^a]k"], [r"[j-l]+\s$", r"(?i)S{2}"], [r"^\S+\W.\D$"], [r"(?:a|E)rror$"]]


def test_patterns_find_what_java_finds(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 7))) for _ in range(1500)] + ["", None, "k\n", "k\r\n", "k\r", "k\x85", "K", "Sſ", "ss"]
    rows = spark.createDataFrame([(t,) for t in texts], "line string")
    for ignore_case in (False, True):
        groups = _rules()
        got = X.found_each(F.col("line"), groups, ignore_case)
        want = [F.col("line").rlike(X.any_of(g, ignore_case)) for g in groups]
        flags = [F.count_if(~a.eqNullSafe(b)).alias(f"d{i}") for i, (a, b) in enumerate(zip(got, want))]
        differ = rows.agg(*flags).collect()[0].asDict()
        assert not {tuple(groups[int(k[1:])]): n for k, n in differ.items() if n}


def test_patterns_that_read_otherwise_are_left_to_java():
    assert all(re2_form(p) is None for p in (r"a\vb", r"\p{L}x", r"[a[b]]", r"[a&&b]", r"a++", r"(?=a)b", r"(a)\1", r"\Qa.\E", r"a\Z", r"(?m)^a", r"a$b"))
    assert re2_form(r"Error$") == (r"(?:[\x{45}][\x{72}][\x{72}][\x{6f}][\x{72}]\r?\z)", True)


def test_lines_are_searched_without_javas_patterns(spark):
    """Error categories of plain and odd lines alike come from one search; Java's pattern stays only where an end of line is asked for."""
    plan = E.match_errors(T.log_lines(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2


def test_stored_lines_lie_by_build_and_chunk(small_chunks):
    lines, plain = T.stored_lines(small_chunks, SF), T.log_lines(small_chunks, SF)
    assert sorted(lines.drop("_b").collect()) == sorted(plain.collect())
    assert lines.filter(F.col("_b") != F.floor((F.col("line_no") - 1) / 7)).isEmpty()
    parts = lines.withColumn("part", F.spark_partition_id())
    assert parts.groupBy("build_id", "_b").agg(F.count_distinct("part").alias("n")).filter("n > 1").isEmpty()
    plan = C.typed_lines(lines, long=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan


def test_text_of_lines_is_not_shuffled_for_deep_types(spark):
    lines = T.stored_lines(spark, SF)
    plan = E.deep_types(E.deep_primary_line(lines), lines)._jdf.queryExecution().executedPlan().toString()
    assert "near_line" in plan
    below = [row for row in plan.split("\n") if "Exchange hashpartitioning" in row and "_chunk" in row]
    scans = plan.count("Bucketed: true")
    assert scans >= 2 and len(below) <= 2  # facts alone are dealt, once to each reading of the lines


def test_tails_are_not_shuffled(spark):
    from faultline.operators import search as S

    lines = T.stored_lines(spark, SF)
    for df in (S.tail_lines(lines), S.partition_noise(S.tail_lines(lines)).groupBy("build_id", "_b").agg(F.collect_list("line"))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in S.focused_log(lines)._jdf.queryExecution().executedPlan().toString()
