"""Embedding whitening from bit-sliced cross-products.

Entries become integers z = floor(1024 c), and x = z + 100000. Sums and cross-products of z are exact: in a block of rows
every dimension is shifted by its smallest entry there, and each bit of the shifted numbers is a plane, one bit a row,
packed into 64-bit words. The cross-product of two dimensions is the sum over their planes a and b of 2^(a + b) times the
popcount of (plane a AND plane b); a plane of ones gives sums and the count. The shift is taken back in integers, so
blocks, tasks and retries add up to the same numbers in any order. Only one row per pair of dimensions leaves a task.

n * sum(x x') - S S' is then the scatter matrix, centred as integers; only its quotient by n^2 is rounded, before eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import lean

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block: 128 words a plane.
BLOCK = 8192
#: z beyond this is taken for this (no vector in use comes near).
MOST = 1 << 62
#: Exact sums leave tasks in digits of so many bits.
LIMB = 32
#: Components with less than this share of the largest eigenvalue have no variance to divide by.
FLAT = 1e-12


@dataclass
class Whitening:
    """n rows; sums of z per dimension (exact); components as columns, eigenvalues falling, trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def known(self) -> np.ndarray:
        """Which components have variance."""
        return (self.values > FLAT * max(float(self.values[0]), 0.0)) if len(self.values) else np.zeros(0, bool)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """k, v (array of doubles) of the rows whose vector has no null and no non-finite entry.

    Empty vectors go. Where lengths differ, the commonest counts (the longest of equally common ones) and the others go.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    out = rows.select(F.col(f"`{key}`").alias("k"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    common = out.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return out.where(F.size("v") == (common.d if common else 0))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """z of all vectors, rows by dimensions."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64)


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """bits x words: the bits of the numbers y >= 0, packed across rows."""
    set_ = ((y[None, :] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(set_, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def scatter(z: np.ndarray) -> list[list[int]]:
    """Exact sums over the rows of z: the upper triangle of cross-products of (1, z)."""
    rows, d = z.shape
    low = z.min(axis=0)
    y = np.concatenate([np.ones((rows, 1), np.uint64), z.astype(np.uint64) - low.astype(np.uint64)], axis=1)
    bits = [int(m).bit_length() for m in y.max(axis=0).tolist()]
    sliced = np.concatenate([planes(np.ascontiguousarray(y[:, j]), bits[j]) for j in range(d + 1)])
    start = np.concatenate([[0], np.cumsum(bits)])
    # plain integers where the sums fit 64 bits, Python's own where they do not
    kind = np.int64 if 2 * max(bits) + rows.bit_length() < 63 else object
    weight = np.array([1 << b for n in bits for b in range(n)], dtype=kind)
    cross = np.zeros((d + 1, d + 1), dtype=kind)
    for i in range(d + 1):
        if not bits[i]:
            continue
        rest = sliced[start[i] :]
        has = [j for j in range(i, d + 1) if bits[j]]
        for a in range(bits[i]):
            count = np.bitwise_count(sliced[start[i] + a] & rest).sum(axis=1, dtype=np.int64).astype(kind)
            cross[i, has] += np.add.reduceat(count * weight[start[i] :], start[has] - start[i]) * weight[start[i] + a]
    # y = z - low: sum z z' = sum y y' + low' sum y + low sum y' + rows low low'
    c, m, s = cross.tolist(), [0, *low.tolist()], cross[0].tolist()
    return [[c[i][j] + m[j] * (s[i] if i else rows) + m[i] * s[j] + (rows * m[i] * m[j] if i else 0) for j in range(i, d + 1)] for i in range(d + 1)]


def _limbs(v: int) -> list[int]:
    """v in digits of LIMB bits, lowest first; the last one carries the sign and may be larger."""
    out = []
    while not -(1 << LIMB) < v < (1 << LIMB):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def cross_products(vectors: DataFrame, d: int) -> list[list[int]]:
    """The exact cross-products of (1, z) over all rows of `vectors` (v): (d + 1)^2 / 2 numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            z = integers(b.column("v"), d)
            for at in range(0, len(z), BLOCK):
                part = scatter(z[at : at + BLOCK])
                total = part if total is None else [[p + q for p, q in zip(x, y, strict=True)] for x, y in zip(total, part, strict=True)]
        if total is not None:
            out = [(i, i + j, k, digit) for i, row in enumerate(total) for j, v in enumerate(row) for k, digit in enumerate(_limbs(v))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "limb", "v"])

    sums = vectors.select("v").mapInArrow(lean(add), "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in sums:
        out[r.i][r.j] += r.v << (LIMB * r.limb)
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """Sums, components and eigenvalues over all rows of `vectors` (v, of one length); None without rows.

    What comes to the driver are the exact sums, a number per pair of dimensions.
    """
    one = vectors.select(F.size("v").alias("d")).first()
    if one is None:
        return None
    d = one.d
    cross = cross_products(vectors, d)
    n, sums = cross[0][0], cross[0][1:]
    v = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * cross[i + 1][j + 1] - sums[i] * sums[j]) / (n * n)  # integers divided once, rounded once
    values, vecs = np.linalg.eigh(v)
    return Whitening(n, sums, np.ascontiguousarray(vecs[:, ::-1]), values[::-1].copy(), float(np.trace(v)))


def _centred(z: np.ndarray, model: Whitening) -> np.ndarray:
    """n z - S, exact: 64-bit integers where they fit, Python's own where they do not."""
    fits = max(int(np.abs(z).max(initial=0)), 1) * model.n < 1 << 61
    kind = np.int64 if fits and max(map(abs, model.sums)) < 1 << 61 else object
    return z.astype(kind) * model.n - np.array(model.sums, dtype=kind)


def _white(u: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    """The whitened values of the first k components; nan where a component has no variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (u.astype(np.float64) / model.n) @ model.vectors[:, :k] / np.sqrt(model.values[:k])
    w[:, ~model.known()[:k]] = np.nan
    return w


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, measured on all rows.

    Components without variance are left out; None if there are no others. Values are centred before they are multiplied.
    """
    held, d = vectors.sparkSession.sparkContext.broadcast(model), len(model.sums)
    able = np.flatnonzero(model.known()[:k])
    if not len(able):
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = held.value, np.zeros((len(able), len(able)))
        for b in batches:
            w = _white(_centred(integers(b.column("v"), d), m), m, k)[:, able]
            total += w.T @ w
        i, j = np.triu_indices(len(able))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], ["i", "j", "s"])

    rows = vectors.select("v").mapInArrow(lean(moments), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r.s / model.n - (r.i == r.j)) for r in rows)


def whitened(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """k, deviation (decimal: the exact sum over dimensions of (n x - S)^2, null beyond 38 digits), white (an array with a
    value per component, null where it has no variance) of every row of `vectors` (k, v)."""
    held, d, most = vectors.sparkSession.sparkContext.broadcast(model), len(model.sums), min(components, len(model.sums))
    kind = vectors.schema["k"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            u = _centred(integers(b.column("v"), d), m)
            if u.dtype == object or int(np.abs(u).max(initial=0)) ** 2 * d >= 1 << 62:
                far = (u.astype(object) ** 2).sum(axis=1).tolist()
                far = pa.array([x if x < 10**38 else None for x in far], pa.decimal128(38, 0))
            else:
                far = pa.array((u * u).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            w = _white(u, m, most).ravel()
            white = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, most), pa.int32()), pa.array(w, pa.float64(), mask=np.isnan(w)))
            yield pa.RecordBatch.from_arrays([b.column("k"), far, white], ["k", "deviation", "white"])

    return vectors.select("k", "v").mapInArrow(lean(project), f"k {kind}, deviation decimal(38,0), white array<double>")


def whitening_report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row and component.

    Rows with a null vector, a null or non-finite entry, or another length than most have none. Repeated and null keys are rows
    like any other. Vectors of fewer dimensions have as many components. Where a component has no variance (all rows alike,
    fewer rows than components) its whitened value is null and explained 0 (null if nothing varies). A deviation beyond a
    long is null; `whitened` has it as a decimal. Other columns are not looked at.
    """
    spark = rows.sparkSession
    vectors = usable(rows, key, vector)
    model = fit(vectors)
    kind = rows.schema[key].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    most = min(components, len(model.sums))
    share = [float(max(e, 0.0)) / model.trace if model.trace > 0 else None for e in model.values[:most]]
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    flat = whitened(vectors, model, components).select("k", "deviation", F.posexplode("white").alias("c", "w"))
    return flat.select(
        F.col("k").alias("vec_id"), (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.col("w").alias("whitened"), F.get(shares, F.col("c")).alias("explained"), F.lit(identity_error(vectors, model, most)).cast("double").alias("identity_error"),
    )
