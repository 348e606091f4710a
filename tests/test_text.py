"""The search for fixed texts never hides a line that a pattern finds."""

import random
import re

import pytest

from pyspark.sql import functions as F
from faultline.functions import text as X
from faultline.rules import errors as R
from faultline.sources import tables as T
from faultline.functions.patterns import required_text
from faultline.functions.text import found

CASES = {
    r"E\d{4}": "got E1234 here", r"\b5\d{2}\b": "http 503", r"[A-Z]{2}-\d{3,}": "AB-1234", r"\bE\d{1,5}: x": "E12: x", r"(a)\1bcd": "aabcd",
    r"x\x41bcd": "xAbcd", r"(?:foo){2}bar+": "foofoobarr", r"colou?r of": "color of", r"err(or)?s? \(fatal\)": "err (fatal)", r"a\{3\}b": "a{3}b", r"[(]abc[)]": "(abc)",
    r"[a-z&&[^b]]foo": "afoo", r"[^]]abc": "xabc", r"(?x)abc def": "abcdef", r"(?:abc|(?:defg|hij)+)kl": "hijkl", r"abc(?=def)": "abcdef", r"(?<!x)abcd": "abcd",
    r"(?<name>abc)?defg": "defg", r"a(?i)bcd": "aBCD", r"\p{Lu}abc": "Xabc", r"(abc|)defg": "defg", r"abc{2}d": "abccd",
}


@pytest.mark.parametrize("pattern", CASES)
def test_known_lines(spark, pattern):
    row = spark.createDataFrame([(CASES[pattern],)], "line string")
    assert row.where(found(row.line, [pattern])).count() == row.where(row.line.rlike(pattern)).count() == 1


def test_random_patterns():
    rng = random.Random(0)
    atoms = ["abc", "x", r"\d", r"\.", "[a-c]", "[^z]", ".", "(?:ab|cd)", "(xyz)", r"\w", "ERR"]
    fill = {r"\d": "7", r"\.": ".", "[a-c]": "b", "[^z]": "q", ".": "-", "(?:ab|cd)": "cd", "(xyz)": "xyz", r"\w": "w"}
    for _ in range(4000):
        pattern, line = "", ""
        for _ in range(rng.randint(1, 6)):
            a = rng.choice(atoms)
            q, n = rng.choice([("", 1), ("", 1), ("?", 0), ("*", 0), ("+", 2), ("{2}", 2), ("{0,3}", 0), ("{1,}", 1), ("+?", 1)])
            one = fill.get(a, a)
            if a in ("abc", "ERR") and q:  # a quantifier binds the last character
                line += one[:-1] + one[-1] * n
            else:
                line += one * n
            pattern += a + q
        assert re.search(pattern, line)
        texts = required_text(pattern)
        assert texts is None or any(t in line.lower() for t in texts), (pattern, line, texts)


@pytest.mark.parametrize("pattern,texts", [
    ("error: (?:disk full|no space)", ["disk full", "no space"]), ("(?:disk full|no space left)!?", ["disk full", "no space left"]), (r"abc\.def\d+", ["abc.def"]), ("ab|cdef", None), ("x*", None),
    ("(unclosed", None), ("[[a]b]cde", None), ("(?m)abc", None), (r"\x41bcd", None), ("abcd?", ["abc"]), ("ab(?:cdefg)+h", ["cdefg"]), ("(?i)ERROR", ["error"]),
])
def test_required_text(pattern, texts):
    assert required_text(pattern) == texts


def test_screens_lose_no_match(spark):
    """The search for many fixed texts at once changes no answer, whatever the case, blanks or letters of a line."""
    groups = [*R.CATEGORY_PATTERNS.values(), ["Straße kaputt", "ÉCHEC total", "İstek bad", "abc def", "xyz uvw"], [r"\d+"]]
    lines = ["npm ERR! code", "NPM err! x", "Connection REFUSED", "✗ one", "straße kaputt", "Straße kaputt", "ÉCHEC total", "İstek bad",
             "fatal:\x0bgone", "Error\r", "timedKout", "out of memory\x00", "", None, "7", "Caused by: x" * 5000 + "Killed by signal 9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i long, line string")
    plain = [F.col("line").rlike(X.any_of(g)) for g in groups]
    got = df.select("i", *[c.alias(f"g{n}") for n, c in enumerate(X.found_each(F.col("line"), groups))])
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(df.select("i", *[c.alias(f"g{n}") for n, c in enumerate(plain)]).collect())
    kept = df.filter(X.maybe(F.col("line"), R.CATEGORY_PATTERNS.values())).select("i")
    assert not df.filter(plain[0]).select("i").subtract(kept).count()


def test_log_lines_number_in_one_window(spark):
    lines = T.log_lines(spark, "/root/testdata/sf0.001")
    assert "Join" not in lines._jdf.queryExecution().executedPlan().toString()
    seen = lines.groupBy("build_id").agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("d"), F.max("line_no").alias("m"))
    assert seen.filter("n <> d or n <> m").count() == 0
