"""Rendezvous hashing: every record goes to the shard that draws the best ticket for its key.

Only DataFrame functions. A key's tickets do not depend on the other shards, so adding a shard moves rows only into it
and removing one moves only its own rows. No shuffle is needed to place a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import ranked, stored

DRAWS = 1 << 53


def ticket(key: Column, shard: int, weight: float = 1.0) -> Column:
    """-weight / ln(u), u in (0, 1) from XXH64 of "key#shard" (seed 42): shard s is best with probability weight / sum."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"#{shard}"))), 11)
    return F.lit(-float(weight)) / F.log((bits + 0.5) / DRAWS)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key; null keys count as the empty key, ties go to the smaller shard, weights must be positive."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    k = F.coalesce(key.cast("string"), F.lit(""))
    best = F.array_max(F.array(*[F.struct(ticket(k, s, w).alias("t"), F.lit(-s).alias("s")) for s, w in sorted(weights.items())]))
    return (-best["s"]).cast("int")


def place(rows: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """Add `shard`, and `grown_shard` for a second set of weights (null without one).

    Equal keys go together, whatever a key's share of the rows; empty tables stay empty; other columns are kept, but a
    column named shard or grown_shard is replaced.
    """
    after = shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")
    return rows.withColumns({"shard": shard_of(F.col(key), weights), "grown_shard": after})


def slots(placed: DataFrame) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard. Stores the rows once, so pass only the columns that are needed."""
    return ranked(stored(placed, "shards"), "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, written without a shuffle."""
    placed.write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for `docs` (doc_id, text) over equal shards 0 .. n-1.

    size is the UTF-8 bytes of the text and 1; a null text counts as empty.
    """
    equal = {s: 1.0 for s in range(shards)}
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = place(docs.select("doc_id", text.alias("_t")), "doc_id", equal, equal | {shards: 1.0})
    digest = placed.select(
        "doc_id",
        (F.octet_length("_t") + 1).cast("long").alias("size"),
        F.crc32("_t").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
    )
    return slots(digest).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
