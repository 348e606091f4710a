"""Streams of failures and log lines: the batch operators with watermarks, windows and kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from faultline.functions import text as X
from faultline.operators import classify as C, knowledge as K, records as R, search as S
from faultline.rules import shell
from faultline.session import new_shared_path

LATE = "30 minutes"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as a stream of files."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)
    # event time must be a timestamp with time zone; files may hold one without
    times = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else stream


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote to the shared folder."""
    spark = stream.sparkSession
    out, log = new_shared_path(spark, "stream"), new_shared_path(spark, "stream-log")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    log = new_shared_path(stream.sparkSession, "stream-log")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def stored_batches(spark: SparkSession, path: str) -> bool:
    """Whether a batch was written at all: a stream without rows has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_failures(events: DataFrame) -> DataFrame:
    """Only builds that are finished and failed."""
    return events.filter(S.result_of(F.col("raw")) == "FAILURE")


def stream_dedupe(failures: DataFrame, key=("host", "src"), late: str = LATE) -> DataFrame:
    """One row per key as long as copies come within the allowed lateness."""
    return failures.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def failure_windows(failures: DataFrame, width: str = "15 minutes", late: str = LATE) -> DataFrame:
    return (
        failures.withWatermark("ts", late).groupBy(F.window("ts", width), "host").agg(F.count("*").alias("failures"))
        .select(F.col("window.start").alias("start"), "host", "failures")
    )


def stream_kb_match(events: DataFrame, errors: DataFrame) -> DataFrame:
    """Known errors in each event's text, micro-batch by micro-batch: each meets the index of the rules, and nothing is kept.

    A batch's matches are written under its number, so one that runs again writes the same files anew."""
    spark = events.sparkSession
    out = new_shared_path(spark, "kb-matches")
    match = lambda batch: K.match_errors(batch, errors, "raw")
    drain_batches(events, lambda batch, n: match(batch).write.mode("overwrite").parquet(f"{out}/batch={n}"))
    shape = match(spark.createDataFrame([], events.schema))
    return spark.read.option("basePath", out).schema(shape.schema).parquet(f"{out}/batch=*") if stored_batches(spark, out) else shape


def stream_join_build_log(failures: DataFrame, others: DataFrame, late: str = LATE, reach: str = "10 minutes") -> DataFrame:
    """Failures with the other rows of the same host shortly before them; the bound lets old rows go.

    Rows meet by host and time bucket as wide as the reach: a failure asks its own bucket and the one before, so a row is
    compared with those near it in time and not with all of its host.
    """
    # a day may have 25 hours
    width = F.greatest(F.unix_micros(F.expr(f"timestamp_micros(0) + INTERVAL {reach}")) * 25 / 24, F.lit(1))
    bucket = lambda at: F.floor(F.unix_micros(at) / width).cast("bigint")
    left = failures.withWatermark("ts", late).select(F.col("event_id").alias("failure"), "host", F.col("ts").alias("failed_at"))
    left = left.withColumn("bucket", F.explode(F.array(bucket(F.col("failed_at")) - 1, bucket(F.col("failed_at")))))
    right = others.withWatermark("ts", late).select("event_id", F.col("host").alias("o_host"), F.col("ts").alias("at"), "raw")
    right = right.withColumn("o_bucket", bucket(F.col("at")))
    near = F.expr(f"o_host = host AND o_bucket = bucket AND at BETWEEN failed_at - INTERVAL {reach} AND failed_at")
    return left.join(right, near).select("failure", "event_id", "host", "raw")


LINE_STATE = StructType([
    StructField("build_id", LongType()), StructField("in_sh", BooleanType()), StructField("after_echo", BooleanType()),
    StructField("stage", StringType()), StructField("cmd_line", LongType()), StructField("seen", LongType()),
])
TYPED_LINE = StructType([
    StructField("build_id", LongType()), StructField("line_no", LongType()), StructField("in_sh", BooleanType()),
    StructField("stage", StringType()), StructField("cmd_line", LongType()),
])


FINISHED = r"^Finished: [A-Z_]+"
IDLE = 24 * 3600 * 1000


#: Groups of builds that share a call, a state list and a timer: a call costs milliseconds, whatever it is given.
LINE_GROUPS = 1024


class LineState(StatefulProcessor):
    """Carries shell state, stage and open command of builds from one micro-batch to the next, a group of builds at a time.

    Expects the lines of a build in order across micro-batches; inside one they are sorted here, so the
    size of a micro-batch (maxBytesPerTrigger of the source) bounds what one task holds. The marker, stage
    and command columns are computed by Spark before; only the carrying over is done here. A build's state goes
    with its last line (`Finished: ...`), or once no line has come for `idle` milliseconds; lines after that start anew.
    """

    def __init__(self, idle: int = IDLE) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("builds", LINE_STATE)

    def keep(self, before: list[tuple], after: list[tuple], fired: bool = False) -> None:
        """Store what is open now; the group's timer is that of the build which has been silent longest."""
        if after:
            self.state.put(after)
        elif before:
            self.state.clear()
        old, new = (min((r[-1] for r in rows), default=None) for rows in (before, after))
        if old is not None and old != new and not fired:
            self.handle.deleteTimer(old + self.idle)
        if new is not None and (old != new or fired):
            self.handle.registerTimer(new + self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows))
        if key[0] < 0:  # lines of no build at all are a group of their own
            lines["build_id"] = 0
        lines = lines.sort_values(["build_id", "line_no"], ignore_index=True)
        before, now = [tuple(r) for r in self.state.get()], timerValues.getCurrentProcessingTimeInMs()
        build = lines["build_id"]
        first, last = ~build.duplicated(), ~build.duplicated(keep="last")
        kept = pd.DataFrame(before, columns=LINE_STATE.names).set_index("build_id")
        carried = lambda name, default: build.map(kept[name]).astype(object).where(build.isin(kept.index), default)
        carry = lambda values: values.groupby(build, sort=False).ffill()
        sh_before, echo_before = carried("in_sh", False).astype(bool), carried("after_echo", False).astype(bool)
        marker, numbers = lines["marker"], lines["line_no"].astype("Int64")
        closes = marker.isin(["pipeline_step", "pipeline_stage", "pipeline_echo"])
        # 1 where a shell step opens, 0 where something else does, carried on
        opened = pd.Series(pd.NA, lines.index, "Int64").mask(marker == "pipeline_sh", 1).mask(closes, 0)
        shell_now = carry(opened).fillna(sh_before.astype("Int64")) == 1
        in_sh = shell_now.shift(fill_value=False).where(~first, sh_before).astype(bool)
        echo = marker == "pipeline_echo"
        after_echo = echo.shift(fill_value=False).where(~first, echo_before).astype(bool)
        starts = marker.isna() & ~after_echo & (lines["traced"] | (lines["continued"] & ~in_sh))
        owner = carry(numbers.where(starts).mask(closes, 0)).fillna(carried("cmd_line", 0).astype("Int64"))
        stages = carry(lines["stage"].astype(object).where(lines["stage"].notna(), None))
        stages = stages.where(stages.notna(), carried("stage", None))
        stages = stages.where(stages.notna(), None)

        came = set(build[first].tolist())
        # builds that are silent for too long go, as with a timer of their own
        after = [r for r in before if r[0] not in came and r[-1] + self.idle > now]
        left = last & ~lines["finished"]
        ends = (x[left].tolist() for x in (build, shell_now.astype(bool), echo, stages, owner))
        after += [(int(b), bool(s), bool(e), stage, int(c), now) for b, s, e, stage, c in zip(*ends, strict=True)]
        self.keep(before, after)
        names = build if key[0] >= 0 else pd.Series(pd.NA, lines.index, "Int64")
        yield pd.DataFrame({"build_id": names, "line_no": numbers, "in_sh": in_sh, "stage": stages, "cmd_line": owner.mask(owner == 0)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, now = [tuple(r) for r in self.state.get()], timerValues.getCurrentProcessingTimeInMs()
        self.keep(before, [r for r in before if r[-1] + self.idle > now], fired=True)
        return iter(())

    def close(self) -> None:
        pass


def stream_line_state(lines: DataFrame, idle: int = IDLE) -> DataFrame:
    """Shell state, stage and command of each streamed line."""
    line = F.col("line")
    group = F.when(F.col("build_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("build_id"), F.lit(LINE_GROUPS))).cast("long")
    marked = lines.select(
        group.alias("group"),
        "build_id", "line_no", C.marker(line).alias("marker"), X.extract(line, C.STAGE_LABEL).alias("stage"),
        X.shell_command(line).isNotNull().alias("traced"), X.continued_command(line).isNotNull().alias("continued"), line.rlike(FINISHED).alias("finished"),
    )
    return marked.groupBy("group").transformWithStateInPandas(
        statefulProcessor=LineState(idle), outputStructType=TYPED_LINE, outputMode="Append", timeMode="ProcessingTime"
    )


#: Timers need the RocksDB state store; batches without rows would only look for timers, without end.
LINE_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def line_states_of(arrivals: Sequence[DataFrame], idle: int = IDLE) -> DataFrame:
    """Line states of lines that arrive one frame after the other (build_id, line_no, line).

    Each arrival is added to one folder and the same query, known by its checkpoint, runs over what is new; so the
    state outlives the micro-batch and the query that wrote it.
    """
    spark = arrivals[0].sparkSession
    path, out, log = (new_shared_path(spark, n) for n in ("lines", "line-states", "stream-log"))
    before = {c: spark.conf.get(c) for c in LINE_STATE_CONF}
    for c, v in LINE_STATE_CONF.items():
        spark.conf.set(c, v)
    try:
        for frame in arrivals:
            frame.select("build_id", "line_no", "line").write.mode("append").parquet(path)
            stream = spark.readStream.schema("build_id bigint, line_no bigint, line string").parquet(path)
            run = stream_line_state(stream, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", log)
            run.trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    return spark.read.schema(TYPED_LINE).parquet(out)


def stream_to_queue(failures: DataFrame, queue_path: str) -> None:
    """Insert what the queue does not hold yet, batch by batch; a repeated batch inserts nothing twice."""
    spark = failures.sparkSession

    def insert(batch: DataFrame, batch_id: int) -> None:
        queue = spark.read.schema(batch.schema).parquet(queue_path)
        R.queue_insert(queue, batch).select(*batch.columns).write.mode("append").parquet(queue_path)

    drain_batches(failures, insert)
