"""Similar cases over all cases equal a comparison of every pair."""

import random
import re
from collections import Counter

import pytest

from faultline.operators import knowledge as K

ASK = "query_id long, text string, category string, stage string, method string"
TOLD = "id long, error_snippet string, error_category string, failed_stage string, failed_method string"


def _bag(text):
    return Counter(w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 2 and w not in K.STOP_WORDS)


def _every_pair(queries, cases, k):
    out = set()
    for q, text, *mine in queries:
        a, found = _bag(text), []
        for c, snippet, *theirs in cases:
            b = _bag(snippet)
            common = sum((a & b).values())
            if common:
                boost = sum(w for (_, _, w), x, y in zip(K.BOOSTS, mine, theirs) if x is not None and x == y)
                found.append((round(2 * common / (a.total() + b.total()) + boost, 6), c))
        out |= {(q, rn, c, s) for rn, (s, c) in enumerate(sorted(found, reverse=True)[:k], 1)}
    return out


@pytest.mark.parametrize("hot, seeds", [(4096, 16), (3, 1)])
def test_similar_cases_equal_every_pair(spark, monkeypatch, hot, seeds):
    monkeypatch.setattr(K, "HOT_WORD", hot)
    monkeypatch.setattr(K, "SEED_CASES", seeds)
    rng = random.Random(hot)
    words = [f"w{i:03}" for i in range(60)]
    text = lambda: " ".join(words[int(60 * rng.random() ** 3)] for _ in range(rng.randint(1, 40)))
    facts = lambda: (rng.choice(["A", "B", None]), rng.choice(["s", "t", "u"]), rng.choice([None, "m", "n"]))
    texts = [text() for _ in range(40)] + ["", None, "the and of", "w001 " * 3000, "W001, w002!"]
    cases = [(i, rng.choice(texts), *facts()) for i in range(120)] + [(1000 + i, texts[0], "A", "s", "m") for i in range(20)]
    queries = [(i, rng.choice(texts + ["unknown words alone"]), *facts()) for i in range(80)] + [(500, texts[0], "A", "s", "m"), (501, texts[0], "A", "s", "m")]
    got = K.find_similar(spark.createDataFrame(queries, ASK).repartition(3), spark.createDataFrame(cases, TOLD), 3)
    assert {(r.query_id, r.rn, r.id, r.score) for r in got.collect()} == _every_pair(queries, cases, 3)


def test_no_cases_or_no_queries(spark):
    some, none = [(1, "w1 word", "A", "s", "m")], []
    assert K.find_similar(spark.createDataFrame(some, ASK), spark.createDataFrame(none, TOLD)).collect() == []
    assert K.find_similar(spark.createDataFrame(none, ASK), spark.createDataFrame(some, TOLD)).collect() == []


def test_no_side_is_broadcast(spark):
    asked = spark.createDataFrame([(1, "disk quota exceeded", "A", "s", "m")], ASK)
    told = spark.createDataFrame([(2, "quota of disk exceeded", "A", "s", "m")], TOLD)
    found = K.find_similar(asked, told)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.query_id, r.id) for r in found.collect()] == [(1, 2)]
