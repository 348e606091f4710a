"""Steps that several operators share: row positions in a stored table, gapless ranks, a bounded row sketch, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import new_shared_path

#: Rows of a stored file that one task ranks together.
BLOCK_ROWS = 50_000
#: Bits of the sketch in `maybe_in`: at most 2**18 rows are broadcast, whatever the tables hold.
SKETCH_BITS = 1 << 24


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and go on from there; lost executors cost no more than their running tasks."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(table: DataFrame, key: str, rank: str) -> DataFrame:
    """Number the rows of each `key` from 0 without a gap, where one key may hold most rows.

    `table` is one that `stored` returned: a row's place in its file is fixed, so rows are numbered in blocks of a file
    and blocks are moved by running counts. No task sees a whole key.
    """
    placed = table.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    placed = placed.withColumn("_b", F.floor(F.col("_i") / BLOCK_ROWS))
    counts = placed.groupBy(key, "_f", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(key, "_f", "_b").orderBy("_i")
    return (
        placed.withColumn("_r", F.row_number().over(inside) - 1)
        .join(counts, [key, "_f", "_b"])
        .withColumn(rank, (F.col("_o") + F.col("_r")).cast("long"))
        .drop("_f", "_b", "_i", "_n", "_o", "_r")
    )


def _slot(c: Column) -> Column:
    return F.xxhash64(c).bitwiseAND(SKETCH_BITS - 1)


def maybe_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose `column` occurs in the one column of `wanted`, and a few more: a bit sketch of fixed size is broadcast.

    The sketch has SKETCH_BITS bits in words of 64; when many values set all bits, every row passes and the exact join
    that must follow does the whole work.
    """
    v = wanted.columns[0]
    words = (
        wanted.select(_slot(F.col(v)).alias("_s"))
        .select(F.shiftright("_s", 6).alias("_w"), F.expr("shiftleft(1L, cast(_s & 63 as int))").alias("_m"))
        .groupBy("_w")
        .agg(F.bit_or("_m").alias("_m"))
    )
    hit = F.expr("shiftright(_m, cast(_s & 63 as int)) & 1") == 1
    return (
        rows.withColumn("_s", _slot(F.col(column)))
        .withColumn("_w", F.shiftright("_s", 6))
        .join(F.broadcast(words), "_w")
        .where(hit)
        .drop("_s", "_w", "_m")
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links` (pairs of longs): root is the smallest node that links reach.

    Alternates two steps in which every node sends its neighbours to the smallest one (first larger, then smaller
    neighbours), until only stars are left; a star at a large root is an aggregate and an equality join, never a list.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # larger neighbours go to the smallest neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"), "large")
        # so do the smaller neighbours and the node itself
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        mark = now
