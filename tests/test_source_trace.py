"""Source lines of commands against scoring every pair."""

import random

from pyspark.sql import functions as F

from faultline.operators import commits as G, knowledge as K


def test_source_trace_matches_scoring_every_pair(spark, monkeypatch):
    monkeypatch.setattr(K, "USUAL_WORD", 4)
    rnd = random.Random(5)
    some = lambda n: " ".join(["npm", *(rnd.choice(["run", "install", "-q", "--all", *[f"w{i}" for i in range(40)], "$X"]) for _ in range(n))])
    src = sorted({("npm", f"p{rnd.randint(1, 30)}", rnd.randint(1, 9), some(rnd.randint(0, 4))) for _ in range(70)})
    steps = [(i, i, "npm", some(rnd.randint(0, 4))) for i in range(60)]
    got = K.trace_to_source(
        spark.createDataFrame(steps, "build_id bigint, cmd_line bigint, tool string, command string"),
        spark.createDataFrame(src, "tool string, path string, src_line int, command string"),
    ).select("build_id", "path", "src_line", "score").collect()
    want = []
    for b, _, _, c in steps:
        best = []
        for _, path, at, s in src:
            a, w = set(c.split()), {x for x in s.lower().split() if not x.startswith("$")}
            score = round(len({x.lower() for x in a} & w) / (len({x.lower() for x in a}) + len(w) - len({x.lower() for x in a} & w)), 6)
            if score > 0.3:
                best.append((-score, path, at, s))
        if best:
            n, path, at, _ = min(best)
            want.append((b, path, at, -n))
    assert sorted(tuple(r) for r in got) == want


def test_commands_that_differ_in_one_word_form_no_pairs(spark):
    many = spark.range(300).select(F.lit("npm").alias("tool"), F.format_string("npm install p%d", "id").alias("command"), F.format_string("f%03d", "id").alias("path"), F.lit(1).alias("src_line"))
    steps = spark.range(300, 600).select("id", F.lit("npm").alias("tool"), F.format_string("npm install p%d", "id").alias("command"))
    seen = []

    def counted(df):
        seen.append(df.count())
        return df

    got = K.trace_to_source(steps, many, cut=counted)
    assert {(r.path, r.score) for r in got.collect()} == {("f000", 0.5)} and got.count() == 300
    assert sorted(seen) == [2, 300, 300, 300]  # two usual words; commands, sources, commands with usual words


def test_only_tails_as_long_as_a_bare_name_are_spelled_out(spark):
    changed = spark.createDataFrame([(1, "s", "a/myapp.py"), (1, "s", "b/App.py"), (2, "s", "app.py")], "repo int, sha string, path string")
    wanted = spark.createDataFrame([(1, "app.py"), (1, "x/b/app.py"), (2, "p.py"), (2, "longer-than-app.py")], "repo int, path string")
    found = G.files_match(changed, wanted)
    assert sorted((r.repo, r.path, r.error_file) for r in found.collect()) == [
        (1, "a/myapp.py", "app.py"), (1, "b/App.py", "app.py"), (1, "b/App.py", "x/b/app.py"), (2, "app.py", "p.py")
    ]
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
