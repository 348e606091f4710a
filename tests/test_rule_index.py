"""The rule index finds what a test of every pair finds, and plans no nested loop."""

import random
import re

from pyspark.sql import functions as F

from faultline.functions import rule_index as RI, scan
from faultline.operators import knowledge as K
from faultline.plans import load

ERRORS = "id long, tool string, code string, pattern string, is_regex boolean, category string, fix string, retriable boolean, confidence double"


def _errors(spark, rules):
    return spark.createDataFrame([(i, "t", f"c{i}", p, x, "B", "", True, 0.5) for i, (p, x) in enumerate(rules)], ERRORS)


def test_matches_equal_a_test_of_every_pair(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcAB.é") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["", "ab", "line\nend", "x" * 50_000 + "needle", None]
    rules = [(word(), False) for _ in range(40)] + [(re.escape(word()) + rng.choice(["", r"\s+", ".", "[a-c]+", "|" + re.escape(word())]) + re.escape(word()), True) for _ in range(40)]
    rules += [("a", False), ("NEEDLE", False), (r"e\ne", True), (r"\d", True), ("ab", True), ("(?x) a b", True), (rules[0][0], True)]
    found = K.match_errors(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string").repartition(3), _errors(spark, rules))
    want = set()
    for k, t in enumerate(texts):
        for i, (p, x) in enumerate(rules):
            if t is not None and (re.search(p, t, re.I) if x else p.lower() in t.lower()):
                want.add((k, f"c{i}"))
    got = [(r.k, r.code) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_every_needle_is_filed_once(spark):
    rules = spark.createDataFrame([("one", ["abcdef", "abcx"]), ("two", ["abc"]), ("three", ["ab"]), ("four", None), ("five", ["zzz", None])], "name string, n array<string>")
    filed = {}
    for r in RI.index(rules, "name", F.col("n")).collect():
        filed.setdefault(r.name, set()).add(r.gram)
    assert filed["two"] == {"abc"} and filed["one"] < {"bcd", "cde", "def", "bcx"} and len(filed["one"]) == 2
    assert len(filed["three"]) == len(filed["four"]) == RI.SALTS and len(filed["five"]) == RI.SALTS + 1


def test_no_nested_loops(spark):
    queries = load().QUERIES
    for name in ("e05_identify_tool", "e06_identify_tool_long", "e07_match_error", "e08_knowledge_for_log", "j06_merge_retriable", "j07_boost_confidence"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_texts_go_by_key(spark, monkeypatch):
    """Only rules that a count shows to be few are broadcast; texts never are, however small their files."""
    texts = spark.createDataFrame([(1, "npm ERR! code")], "k long, text string")
    rules = _errors(spark, [("npm err", False)])
    plan = lambda: K.match_errors(texts, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan().count("SortMergeJoin") == 1
    monkeypatch.setattr(scan, "SMALL_ROWS", 0)
    assert "Broadcast" not in plan()


def test_filed_runs_are_those_of_all_runs(spark):
    texts = ["", None, "ab", "abc", "xABCabc\nbcx", "naïve ABC", "\u0130bc abc", "ßabc", "abcab", "cab", "zzz" * 50]
    grams = ["abc", "bcx", "c\nb", "zzz", "ïve", "i̇b", "cxn", "rule 1", "q"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r for r in rows.select("i", F.array_sort(RI.filed_runs(F.col("t"), grams)).alias("f"), F.array_sort(RI.runs(F.col("t"))).alias("all")).collect()}
    for i, t in enumerate(texts):
        assert got[i].f == (None if t is None else [g for g in got[i].all if g in grams]), t
