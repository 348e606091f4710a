"""Scans, halos and blame against brute force over chunk borders."""

import random

from pyspark.sql import functions as F

from faultline.functions.scan import attach_facts, near, own, range_max, scan, with_halo
from faultline.operators import blame


def table(spark, n=200, builds=3, seed=1):
    rnd = random.Random(seed)
    rows = [(b, i, rnd.choice([None, None, i * 10 + b])) for b in range(builds) for i in range(1, n + b)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "build_id bigint, line_no bigint, v bigint")


def test_scan_matches_a_plain_loop(small_chunks):
    rows, df = table(small_chunks)
    got = {
        (r.build_id, r.line_no): (r.last, r.total, r.top)
        for r in scan(df, {"last": ("last", F.col("v"), False), "total": ("sum", F.col("v"), True), "top": ("max", F.col("v"), True)}).collect()
    }
    for b in range(3):
        last, total, top = None, 0, None
        for _, i, v in sorted((x for x in rows if x[0] == b), key=lambda x: x[1]):
            before = last
            if v is not None:
                last, total, top = v, total + v, v if top is None else max(top, v)
            assert got[(b, i)] == (before, total, top)


def test_reverse_scan(small_chunks):
    rows, df = table(small_chunks, seed=2)
    got = {(r.build_id, r.line_no): r.nxt for r in scan(df, {"nxt": ("last", F.col("v"), False)}, reverse=True).collect()}
    for b in range(3):
        nxt = None
        for _, i, v in sorted((x for x in rows if x[0] == b), key=lambda x: -x[1]):
            assert got[(b, i)] == nxt
            nxt = v if v is not None else nxt


def test_halo_gives_exact_neighbours(small_chunks):
    _, df = table(small_chunks, n=60)
    w = near().rangeBetween(-3, 5)
    got = own(with_halo(df, 3, 5).withColumn("n", F.count("*").over(w))).collect()
    assert len(got) == df.count()
    sizes = {r.build_id: r.m for r in df.groupBy("build_id").agg(F.max("line_no").alias("m")).collect()}
    for r in got:
        assert r.n == min(sizes[r.build_id], r.line_no + 5) - max(1, r.line_no - 3) + 1


def test_facts_reach_every_line(small_chunks):
    _, df = table(small_chunks, n=50)
    facts = df.groupBy("build_id").agg(F.max("line_no").alias("n_lines"))
    assert attach_facts(df, facts).filter("n_lines >= line_no").count() == df.count()


def score(cmd, line):
    """Plain scoring of one command for one error line."""
    s = cmd["cmd_line"]
    if line < s:
        return None
    reach = 405 if cmd["command"].startswith("mvn") else 125
    out = 5000 - 0.02 * (line - s) if line <= s + reach else (-2000 if line - s - reach > 2000 else 500 - (line - s - reach))
    code = cmd["exit_code"]
    out += 350 if code not in (None, 0) else -80 if code == 0 else 0
    out += 45 * cmd["signals"] + (120 if cmd["exit_line_at"] and cmd["exit_line_at"] > cmd["n_out"] - 8 else 0)
    return round(out - 0.15 * (line - s) + (8 if cmd["command"].startswith("./") else 0), 6)


def test_blame_matches_scoring_every_pair(small_chunks):
    spark, rnd = small_chunks, random.Random(3)
    cmds = []
    for b in range(4):
        at = 1
        for _ in range(25):
            at += rnd.choice([2, 9, 150, 700, 3000])
            n = rnd.randint(0, 20)
            cmds.append(dict(
                build_id=b, cmd_line=at, command=rnd.choice(["mvn verify", "./run.sh", "echo hi"]), exit_code=rnd.choice([None, 0, 1]),
                signals=rnd.randint(0, 5), n_out=n, exit_line_at=rnd.choice([None, n]),
            ))
    inv = spark.createDataFrame(
        [tuple(c.values()) for c in cmds], "build_id bigint, cmd_line bigint, command string, exit_code bigint, signals bigint, n_out bigint, exit_line_at bigint"
    )
    asks = [(b, rnd.randint(1, 30000)) for b in range(4) for _ in range(60)]
    got = {(r.build_id, r.line_no): (r.cmd_line, round(r.score, 6)) for r in blame.blame_command(spark.createDataFrame(asks, "build_id bigint, line_no bigint"), inv).collect()}
    for b, line in set(asks):
        options = [(score(c, line), -c["cmd_line"]) for c in cmds if c["build_id"] == b and score(c, line) is not None]
        want = max(options) if options else None
        assert got.get((b, line)) == (None if want is None else (-want[1], want[0]))


def test_range_max_matches_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = [(b, i, rnd.choice([None, rnd.randint(0, 50)])) for b in range(3) for i in rnd.sample(range(1, 120), 50)]
    asks = [(b, i) for b in range(4) for i in range(1, 140)]
    ranges = {"wide": (20, 0), "gap": (33, 11), "one": (5, 5), "ahead": (2, -4)}
    got = {
        (r.build_id, r.line_no): [r[n] for n in ranges]
        for r in range_max(
            spark.createDataFrame(rows, "build_id bigint, line_no bigint, v bigint"), spark.createDataFrame(asks, "build_id bigint, line_no bigint"),
            {n: (back, ahead, F.col("v")) for n, (back, ahead) in ranges.items()},
        ).collect()
    }
    for b, e in asks:
        want = [max((v for k, i, v in rows if k == b and v is not None and e - back <= i <= e - ahead), default=None) for back, ahead in ranges.values()]
        assert got.get((b, e), [None] * 4) == want


def test_a_scan_of_short_keys_reads_its_rows_once(spark):
    _, df = table(spark, n=20)
    got = scan(df, {"last": ("last", F.col("v"), False)}, keep=True)
    again = scan(got, {"total": ("sum", F.col("last"), True)}, long=False)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
