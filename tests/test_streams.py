"""Line states over several micro-batches: carried, ended by the last line, dropped when a build stays silent."""

from faultline.operators import classify as C
from faultline.streaming import streams

TEXT = "[Pipeline] stage\n[Pipeline] { (Build)\n[Pipeline] sh\n+ mvn verify\nok\nmore\n[Pipeline] echo\nhello\n[Pipeline] sh\n+ git push\ndone"


def arrivals(spark, *batches):
    return [spark.createDataFrame(b, "build_id bigint, line_no bigint, line string") for b in batches]


def rows(build, text, first=1):
    return [(build, first + i, t) for i, t in enumerate(text.split("\n"))]


def states(frame):
    return {(r.build_id, r.line_no): (r.in_sh, r.stage, r.cmd_line) for r in frame.collect()}


def test_state_is_carried_over_three_batches_like_in_one(spark):
    lines = rows(1, TEXT) + rows(2, TEXT)
    whole = states(streams.line_states_of(arrivals(spark, lines)))
    cut = states(streams.line_states_of(arrivals(spark, *[[r for r in lines if (r[1] + r[0]) // 5 == i] for i in range(3)])))
    assert whole == cut and len(whole) == 22
    assert whole[(1, 5)] == (True, "Build", 4) and whole[(1, 8)] == (False, "Build", None) and whole[(2, 11)] == (True, "Build", 10)


def test_batch_operator_agrees(spark):
    lines = spark.createDataFrame(rows(1, TEXT), "build_id bigint, line_no bigint, line string")
    want = {(r.build_id, r.line_no): r.owner or None for r in C.command_lines(lines).collect()}
    got = states(streams.line_states_of([lines]))
    assert want and {k: got[k][2] for k in want} == want


def test_finished_ends_the_state(spark):
    got = states(streams.line_states_of(arrivals(spark, rows(1, TEXT) + rows(2, TEXT), rows(1, "Finished: SUCCESS", 12) + rows(2, "x", 12), rows(1, "y", 13) + rows(2, "y", 13))))
    assert got[(1, 12)] == (True, "Build", 10) and got[(1, 13)] == (False, None, None)
    assert got[(2, 13)] == (True, "Build", 10)


def test_silent_builds_are_dropped(spark):
    steps = arrivals(spark, rows(1, TEXT), rows(2, "a"), rows(1, "b", 12))
    assert states(streams.line_states_of(steps, idle=0))[(1, 12)] == (False, None, None)
    assert states(streams.line_states_of(steps))[(1, 12)] == (True, "Build", 10)


def test_failures_meet_rows_near_them_by_time_bucket(spark, tmp_path):
    """Rows of one host are compared by time, whatever side of a bucket's border they lie on."""
    at = lambda s: f"timestamp_seconds({s})"
    # 1,000,000 is a border of 625 seconds; times at the epoch itself are before the first watermark
    every = [1_000_000 + s for s in (0, 24, 25, 599, 600, 601, 624, 625, 626, 1200, 1224, 1225, 1249, 1250, 5000)]
    rows_of = " UNION ALL ".join(f"SELECT {i}L AS event_id, 'h' AS host, {at(s)} AS ts, 'x' AS raw" for i, s in enumerate(every))
    path = str(tmp_path / "events")
    spark.sql(rows_of).write.parquet(path)
    stream = lambda: spark.readStream.schema("event_id bigint, host string, ts timestamp, raw string").parquet(path)
    joined = streams.stream_join_build_log(stream(), stream())
    assert "bucket" in joined._jdf.queryExecution().analyzed().toString()
    got = {(r.failure, r.event_id) for r in streams.drain(joined).collect()}
    assert got == {(i, j) for i, a in enumerate(every) for j, b in enumerate(every) if a - 600 <= b <= a}


def test_builds_share_calls(spark, monkeypatch):
    """One group for all builds gives what one build alone gives: nothing flows from one into the next, and silent ones go one by one."""
    monkeypatch.setattr(streams, "LINE_GROUPS", 1)
    first, second = rows(1, TEXT) + rows(2, "+ make a\nx") + rows(3, "plain"), rows(1, "Finished: SUCCESS", 12) + rows(2, "y", 3) + rows(3, "z", 2)
    got = states(streams.line_states_of(arrivals(spark, first, second, rows(1, "z", 13) + rows(2, "z", 4))))
    assert got[(1, 11)] == (True, "Build", 10) and got[(1, 13)] == (False, None, None)
    assert got[(2, 1)] == (False, None, 1) and got[(2, 4)] == (False, None, 1) and got[(3, 2)] == (False, None, None)
    assert states(streams.line_states_of(arrivals(spark, rows(1, TEXT), rows(2, "+ b"), rows(1, "b", 12)), idle=0))[(1, 12)] == (False, None, None)
