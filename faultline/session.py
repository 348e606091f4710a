"""Session defaults and cluster settings shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHUNK_CONF = "faultline.chunkLines"
DEFAULT_CHUNK_LINES = 20000


def get_session(app: str = "faultline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for; a cluster's own submit settings win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("FAULTLINE_DRIVER_MEMORY", "8g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def chunk_lines(spark: SparkSession) -> int:
    """Lines per chunk: the unit in which one build's log is spread over tasks."""
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK_LINES)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master without that setting (tests) gets a folder of its own, one for its context.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-"))
    return spark.sparkContext.getCheckpointDir()


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/faultline-{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Store a frame once in the shared folder and go on from there: short lineage, safe against lost
    executors. Unlike DataFrame.checkpoint the frame is computed once, and readers prune its columns."""
    path = new_shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df, keys, order):
    """Store a frame like `checkpointed`, dealt by `keys` into as many files as there are shuffle partitions. What is then done per
    these keys reads the files as they lie and shuffles nothing of them, nor sorts them: a file a bucket, written in order."""
    spark, name = df.sparkSession, f"faultline_cut_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, *keys).sortBy(*order).saveAsTable(name, format="parquet", path=new_shared_path(spark, "cut"))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its entry in the session's catalog alone; the files stay like all others there
    return out
