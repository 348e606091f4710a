"""Importance resampling towards a target distribution, with hashed word features.

Features (runs of words) are hashed by CRC-32 into a fixed number of buckets. How often a bucket occurs in all documents and
in all target texts gives it a gain, a document weighs as much as its features gain, and the documents with the largest
weight plus Gumbel noise are drawn, which is a draw without replacement in proportion to the exponentials of the weights.

CRCs are computed for all distinct features of a slice of texts at once: features of equal length are the rows of a
two-dimensional uint8 matrix, whose columns update all CRCs one after another; the buckets are scattered back to the
features. Very long features are cut into pieces of PIECE bytes, which are rows of one more matrix; as the register is
linear in its start and the bytes, pieces add up by the fixed map that PIECE zero bytes are.

The noise depends on the seed and doc_id alone, so any run draws the same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import stored
from faultline.llm.words import lean, slices

BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Features of more bytes are cut into pieces of so many.
PIECE = 256
#: Gains and noise are in thousandths.
UNIT = 1000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of words as they are, all others as blanks.
_PLAIN = bytes(b if _WORD.match(bytes([b])) else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    """The register after one byte: eight steps of the reversed polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_TABLE = _crc_table()


def _columns(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The registers after the bytes of their rows: one step per column for all rows."""
    for column in np.ascontiguousarray(matrix.T):
        register = _TABLE[(register ^ column) & np.uint32(255)] ^ (register >> np.uint32(8))
    return register


def _shift_table() -> np.ndarray:
    """What PIECE zero bytes make of each byte of a register, by its place."""
    start = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return _columns(start.ravel(), np.zeros((1024, PIECE), np.uint8)).reshape(4, 256)


_SHIFT = _shift_table()


def crc_matrix(features: list[bytes]) -> np.ndarray:
    """The unsigned CRC-32 of each feature: length by length, column by column."""
    size = np.fromiter(map(len, features), np.int64, len(features))
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order], prepend=-1))
    for rows in np.split(order, cut[1:]) if len(order) else []:
        n = int(size[rows[0]])
        matrix = np.frombuffer(b"".join([features[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), n)
        pieces, head = (n // PIECE, n % PIECE) if n > PIECE else (0, n)
        register = _columns(np.full(len(rows), 0xFFFFFFFF, np.uint32), matrix[:, :head])
        if pieces:
            alone = _columns(np.zeros(len(rows) * pieces, np.uint32), matrix[:, head:].reshape(-1, PIECE)).reshape(len(rows), pieces)
            for k in range(pieces):
                b = [(register >> np.uint32(8 * j)) & np.uint32(255) for j in range(4)]
                register = _SHIFT[0][b[0]] ^ _SHIFT[1][b[1]] ^ _SHIFT[2][b[2]] ^ _SHIFT[3][b[3]] ^ alone[:, k]
        out[rows] = register ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes 0-9, a-z (A-Z count as these) and from 0x80 on."""
    return text.lower().translate(_PLAIN).split()


def bucketed(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, text after text; features per text; words per text."""
    found, words = [], []
    for t in texts:
        w = words_of(t)
        words.append(len(w))
        found.append(w if longest == 1 else [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)])
    distinct = list(set().union(*found))
    bucket = dict(zip(distinct, (crc_matrix(distinct) % np.uint32(buckets)).tolist(), strict=True))
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((bucket[f] for doc in found for f in doc), np.int64, int(n.sum()))
    return flat, n, np.array(words, np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often the features of all texts fall into each bucket; buckets without any have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, t in slices(b.column(0)):
                total += np.bincount(bucketed(t, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: `buckets` numbers, whatever the tables hold, so they fit the driver and a broadcast."""

    def counts(table):
        t = bucket_counts(table, text, longest, buckets).toArrow()
        out = np.zeros(buckets, np.int64)
        out[t["bucket"].to_numpy()] = t["n"].to_numpy()
        return out.tolist(), float(out.sum())

    (s, all_s), (t, all_t) = counts(docs), counts(target)
    return np.array([math.floor(UNIT * math.log((float(b) + 1.0) * (all_s + buckets) / ((float(a) + 1.0) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Narrow rows, one per row of `docs`: doc, ra and rb (which name the row), n_words, n_features, weight, score."""
    q = lambda c: F.col(f"`{c}`")
    gain = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text, longest, buckets))
    kind = docs.schema[doc].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in slices(b.column("t")):
                flat, n, words = bucketed(t, longest, buckets)
                run = np.zeros(len(flat) + 1, np.int64)
                np.cumsum(gain.value[flat], out=run[1:])
                ends = np.cumsum(n)
                part = b.slice(at, len(t))
                cols = [part.column(c) for c in ("doc", "ra", "rb")] + [pa.array(x, pa.int64()) for x in (words, n, run[ends] - run[ends - n])]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "ra", "rb", "n_words", "n_features", "weight"])

    rows = docs.select(q(doc).alias("doc"), F.xxhash64(q(doc), q(text)).alias("ra"), F.xxhash64(F.lit(1), q(text), q(doc)).alias("rb"), q(text).cast("string").alias("t"))
    return rows.mapInArrow(lean(weigh), f"doc {kind}, ra long, rb long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise(F.col("doc"), seed))


def ranked_draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`rows` as `weighted` returns them, with rank: 1, 2, ... for the `percent` of a hundred with the highest scores, else null.

    Rows are stored (their weights come from whole texts, which are read once), sorted by range and stored again with the number of
    their range; ranges are numbered on from one another by their
    sizes, so no task ranks more than a range. Documents with fewer than `least_words` words have no part in it.
    """
    drawn = F.col("n_words") >= least_words
    by = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc"), F.asc("ra"), F.asc("rb")]
    sorted_ = stored(rows, "weights").withColumn("able", drawn.cast("int")).repartitionByRange(*by).withColumn("range", F.spark_partition_id())
    sorted_ = stored(sorted_, "scores")
    sizes = sorted_.where("able = 1").groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("of"))
    inside = Window.partitionBy("able", "range").orderBy(*by[1:])
    place = F.when(F.col("able") == 1, F.row_number().over(inside) + F.col("before"))
    out = sorted_.join(F.broadcast(sizes), "range", "left").withColumn("place", place)
    return out.select(*rows.columns, F.when(F.col("place") <= F.expr(f"{int(percent)} * of div 100"), F.col("place")).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The drawn rows of `docs`, all columns as they are. Equal rows (doc and text) are drawn together if one of them is."""
    q = lambda c: F.col(f"`{c}`")
    rank = ranked_draw(weighted(docs, target, doc, text, **how), percent, least_words)
    keyed = docs.select(F.struct(*[q(c) for c in docs.columns]).alias("rec"), F.xxhash64(q(doc), q(text)).alias("ra"), F.xxhash64(F.lit(1), q(text), q(doc)).alias("rb"))
    kept = keyed.join(rank.where("rank is not null").select("ra", "rb").distinct(), ["ra", "rb"], "left_semi")
    return kept.select(*[F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs` (doc_id, text); `target` has text.

    Null texts have no features and weight 0. A null doc_id is the empty string in the noise and comes last among ties.
    With an empty target, or no documents, gains come from the counts as they are (0 where nothing was counted).
    """
    rows = weighted(docs, target)
    return ranked_draw(rows).select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")
