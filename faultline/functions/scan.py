"""Ordered scans over one key that never need the whole key in one task.

A build's log may hold a third of all lines, so a plain window partitioned by build would put it in a
single task. Each key is cut into buckets along its order. Windows run per (key, bucket); what flows
from one bucket into the next travels in a small per-bucket summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.session import chunk_lines

BUILD = ["build_id"]


#: So many rows of rules or facts may be sent to every executor.
SMALL_ROWS = 20_000


def by_key(df: DataFrame) -> DataFrame:
    """Marks a side whose joins shuffle both sides by key. Left to itself Spark goes by the size of compressed files and
    shuffles, and a few MB of those may be hundreds in the driver once they are broadcast."""
    return df.hint("merge")


def counted_small(df: DataFrame) -> DataFrame:
    """A side that is broadcast if a count shows that it is small, and shuffled by key if not."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else by_key(df)


def line_chunk(df: DataFrame, pos: str = "line_no") -> Column:
    """Chunk number of a 1-based line position."""
    return F.floor((F.col(pos) - 1) / F.lit(chunk_lines(df.sparkSession))).cast("long")


def with_chunk(df: DataFrame, pos: str = "line_no") -> DataFrame:
    return df.withColumn("_chunk", line_chunk(df, pos))


def layout(lines: DataFrame) -> list[str]:
    """The chunk as a column, for lines that are stored by it: a selection keeps it, so that scans and facts go by how the lines lie."""
    return ["_b"] if "_b" in lines.columns else []


def has_long(lines: DataFrame, pos: str = "line_no") -> bool:
    """Whether a line lies beyond the first chunk. On stored lines the positions' statistics tell."""
    return not lines.filter(F.col(pos) > chunk_lines(lines.sparkSession)).isEmpty()


def whole_keys(lines: DataFrame) -> list[str]:
    """Keys under which all rows of a build lie: the chunk is one of them where lines are stored by it and no build is longer
    than one, so that what is done per build shuffles nothing."""
    return [*BUILD, *layout(lines)] if layout(lines) and not has_long(lines) else BUILD


def scan(
    df: DataFrame,
    specs: dict[str, tuple[str, Column, bool]],
    keys: Sequence[str] = BUILD,
    order: Sequence[str] = ("line_no",),
    reverse: bool = False,
    long: bool | None = None,
    keep: bool = False,
) -> DataFrame:
    """Add running values along `order` within `keys`.

    specs maps an output column to (kind, expression, inclusive); kind is one of last, sum, max, min.
    `last` is the last non-null value. With reverse=True the scan runs from the end of the key to its start.

    `long` tells whether a position lies beyond the first chunk (looked up, if not given). If none does, nothing flows over a
    border and the rows are read once. With `keep` the chunk stays as `_b`, and a scan of the result by the same keys and
    order needs no shuffle of its own.
    """
    keys, order = list(keys), list(order)
    tagged = df if "_b" in df.columns else df.withColumn("_b", line_chunk(df, order[0]))
    long = has_long(df, order[0]) if long is None else long
    for out, (_, expr, _) in specs.items():
        tagged = tagged.withColumn(f"_in_{out}", expr)

    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    inside = W.partitionBy(*keys, "_b").orderBy(*ordering)
    across = W.partitionBy(*keys).orderBy(F.col("_b").desc() if reverse else F.col("_b").asc()).rowsBetween(
        W.unboundedPreceding, -1
    )
    position = F.struct(*[F.col(c) for c in order])
    edge = F.min_by if reverse else F.max_by

    sums, carries, useful = [], [], F.lit(False)
    for out, (kind, _, _) in specs.items():
        v = F.col(f"_in_{out}")
        sums.append((edge(v, F.when(v.isNotNull(), position)) if kind == "last" else _fold(kind, v)).alias(f"_s_{out}"))
        s = F.col(f"_s_{out}")
        carries.append((F.last(s, ignorenulls=True) if kind == "last" else _fold(kind, s)).over(across).alias(f"_c_{out}"))
        useful = useful | F.col(f"_c_{out}").isNotNull()
    joined = tagged
    if long:
        rows = tagged
        if keys == BUILD:  # only builds of several chunks carry; each of them has more lines than a chunk, so they are few
            several = df.filter(F.col(order[0]) > chunk_lines(df.sparkSession)).select(*keys).distinct()
            rows = tagged.join(F.broadcast(several), keys, "left_semi")
        carry = rows.groupBy(*keys, "_b").agg(*sums).select(*keys, "_b", *carries).filter(useful)
        joined = tagged.join(carry, [*keys, "_b"], "left")
    cols = {}
    for out, (kind, _, inclusive) in specs.items():
        frame = inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        v, c = F.col(f"_in_{out}"), F.col(f"_c_{out}") if long else F.lit(None)
        if kind == "last":
            cols[out] = F.coalesce(F.last(v, ignorenulls=True).over(frame), c)
        elif kind == "sum":
            cols[out] = F.coalesce(F.sum(v).over(frame), F.lit(0)) + F.coalesce(c, F.lit(0))
        else:
            pick = F.greatest if kind == "max" else F.least
            cols[out] = pick(_fold(kind, v).over(frame), c)
    kept = [c for c in tagged.columns if c not in specs and not c.startswith("_in_") and (keep or c != "_b")]
    return joined.select(*kept, *[v.alias(k) for k, v in cols.items()])


def _fold(kind: str, v: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v)


def range_max(
    entries: DataFrame, asks: DataFrame, ranges: dict[str, tuple[int, int, Column]], keys: Sequence[str] = BUILD, pos: str = "line_no"
) -> DataFrame:
    """Largest value among the entries at pos - back .. pos - ahead of each ask, for each range by name.

    ranges maps an output column to (back, ahead, value); all values have one type, an entry whose value is null does
    not count. Positions are cut into blocks as wide as the range, which then is the end of one block and the start of
    the next: a running maximum from the end of the first and one from the start of the second, whatever the width.
    A task holds a block, so a long key spreads out. Asks are distinct; those that meet no entry are left out.
    """
    keys, at = list(keys), F.col(pos)
    cell = lambda name, way, place, width, **more: F.struct(
        F.lit(name).alias("name"), F.lit(way).alias("way"), F.floor(place / width).cast("long").alias("block"),
        (way * place).cast("long").alias("at"), *[v.alias(k) for k, v in more.items()],
    )
    given, wanted = [], []
    for name, (back, ahead, value) in ranges.items():
        width = back - ahead + 1
        given += [F.when(value.isNotNull(), cell(name, way, at, width, value=value)) for way in (1, -1)]
        wanted += [cell(name, 1, at - ahead, width), cell(name, -1, at - back, width)]
    rows = entries.select(*keys, F.inline(F.array_compact(F.array(*given)))).unionByName(
        asks.select(*keys, F.col(pos).alias("ask"), F.inline(F.array(*wanted))), allowMissingColumns=True
    )
    seen = W.partitionBy(*keys, "name", "way", "block").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    met = rows.withColumn("top", F.max("value").over(seen)).filter("ask is not null and top is not null")
    return met.groupBy(*keys, F.col("ask").alias(pos)).agg(*[F.max(F.when(F.col("name") == n, F.col("top"))).alias(n) for n in ranges])


def with_halo(df: DataFrame, before: int, after: int, pos: str = "line_no") -> DataFrame:
    """Copy the rows near a chunk border into the neighbouring chunks.

    Adds `_chunk` and `_own`. A window over (key, _chunk) that looks at most `before` lines back and
    `after` lines ahead is then exact for the rows with `_own`.
    """
    size = F.lit(chunk_lines(df.sparkSession))
    at = lambda p: F.floor((p - 1) / size).cast("long")
    p = F.col(pos)
    home = at(p)
    last_reader, first_reader = at(p + before), at(F.greatest(p - after, F.lit(1)))
    return (
        df.drop("_b").withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(first_reader, last_reader)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def near(keys: Sequence[str] = BUILD, pos: str = "line_no"):
    """The window to use on a frame made by with_halo; frames are ranges of `pos`."""
    return W.partitionBy(*keys, "_chunk").orderBy(pos)


def own(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_chunk")


def attach_facts(
    lines: DataFrame, facts: DataFrame, last_line: str = "n_lines", how: str = "inner", pos: str = "line_no", keep: bool = False
) -> DataFrame:
    """Join one-row-per-build facts to lines on (build, chunk), so that a long build spreads out.

    `last_line` names the facts column with the highest line number that has to be reached. Facts are one row a build, however
    small their files, so they are never broadcast. Facts by `whole_keys` bring their chunk with them. With `keep` the chunk of
    stored lines stays.
    """
    size = F.lit(chunk_lines(lines.sparkSession))
    top = F.floor((F.greatest(F.col(last_line), F.lit(1)) - 1) / size).cast("long")
    chunked = lines.withColumnRenamed("_b", "_chunk") if layout(lines) else with_chunk(lines, pos)
    if layout(facts):
        spread = facts.withColumnRenamed("_b", "_chunk")
    else:
        spread = facts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    out = chunked.join(by_key(spread), ["build_id", "_chunk"], how)
    return out.withColumnRenamed("_chunk", "_b") if keep and layout(lines) else out.drop("_chunk")


def top_per(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str] = BUILD, out: str = "rn") -> DataFrame:
    """First k rows per key; Spark limits each map task to k rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
