"""Approximate nearest neighbours with learned partitions.

A bounded sample of vectors makes a neighbour graph; the graph is cut into balanced parts by recursive bisection (halves of
equal size, then swaps that lower the number of cut edges); a small network learns to tell from a vector in which parts its
neighbours lie. Every vector is stored in its most probable part; a query goes to its most probable parts, and all vectors
there are ranked by the exact inner product. How many parts a query visits is set on vectors of the sample that the fit has
not seen, so that TARGET of their true neighbours are met.

Equal vectors are one point with its smallest ids, so a vector with any number of copies loads no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import stored


@dataclass(frozen=True)
class Fit:
    """Parameters. The fit takes at most `sample` distinct vectors (smallest hashed ids)."""

    sample: int = 6000
    held: int = 600
    near: int = 10
    depth: int = 4
    hidden: int = 96
    epochs: int = 30
    target: float = 0.96
    block: int = 8192
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """Two layers; `visits` is the number of parts that a query goes to."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    visits: int

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.a + self.b, 0) @ self.c + self.d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def neighbours(x: np.ndarray, y: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The k rows of y with the largest inner product for each row of x, in blocks."""
    out = np.empty((len(x), min(k, len(y) - same)), np.int64)
    for s in range(0, len(x), 1024):
        p = x[s : s + 1024] @ y.T
        if same:
            p[np.arange(len(p)), s + np.arange(len(p))] = -np.inf
        out[s : s + 1024] = np.argsort(-p, axis=1)[:, : out.shape[1]]
    return out


def balanced(x: np.ndarray, near: np.ndarray, depth: int, rng) -> np.ndarray:
    """The part of each node: 2**depth parts whose sizes differ by one per cut at most."""
    part = np.zeros(len(x), np.int64)
    for level in range(depth):
        for p in range(1 << level):
            nodes = np.flatnonzero(part == p)
            if len(nodes) < 2:
                continue
            local = np.full(len(x), -1)
            local[nodes] = np.arange(len(nodes))
            u = np.repeat(np.arange(len(nodes)), near.shape[1])
            v = local[near[nodes]].ravel()
            u, v = u[v >= 0], v[v >= 0]
            u, v = np.concatenate([u, v]), np.concatenate([v, u])
            degree = np.maximum(np.bincount(u, minlength=len(nodes)), 1)
            # a smooth value over the graph, without its mean: its median cuts few edges
            f = x[nodes] @ rng.standard_normal(x.shape[1])
            for _ in range(40):
                f = 0.5 * f + 0.5 * np.bincount(u, weights=f[v], minlength=len(nodes)) / degree
                f -= np.average(f, weights=degree)
                f /= np.linalg.norm(f) + 1e-12
            side = np.zeros(len(nodes), np.int64)
            side[np.argsort(f, kind="stable")[len(nodes) // 2 :]] = 1
            for _ in range(10):  # swap equally many nodes that have more neighbours on the other side
                other = np.bincount(u, weights=side[u] != side[v], minlength=len(nodes))
                gain = 2 * other - np.bincount(u, minlength=len(nodes))
                a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1))
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                n = min(len(a), len(b)) // 2
                if not n:
                    break
                side[a[:n]], side[b[:n]] = 1, 0
            part[nodes] = p + (side << level)
    return part


def learn(x: np.ndarray, p: Fit) -> Model:
    """Graph, parts, network and number of visits from sampled vectors (float64)."""
    rng = np.random.default_rng(p.seed)
    held = max(1, min(p.held, len(x) // 5)) if len(x) > 40 else 0
    test, train = x[:held], x[held:]
    near = neighbours(train, train, p.near, True)
    parts = 1 << (p.depth if len(train) >= 64 << p.depth else 0)
    part = balanced(train, near, parts.bit_length() - 1, rng)
    goal = np.zeros((len(train), parts))
    np.add.at(goal, (np.repeat(np.arange(len(train)), near.shape[1]), part[near].ravel()), 1.0)
    goal[np.arange(len(train)), part] += p.near / 2
    goal /= goal.sum(1, keepdims=True)
    w = [rng.standard_normal((x.shape[1], p.hidden)) / np.sqrt(x.shape[1]), np.zeros(p.hidden), rng.standard_normal((p.hidden, parts)) / np.sqrt(p.hidden), np.zeros(parts)]
    first, second, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(p.epochs if parts > 1 else 0):
        for i in np.array_split(rng.permutation(len(train)), max(1, len(train) // 128)):
            h = np.maximum(train[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - goal[i]) / len(i)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((train[i].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] -= 3e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(*w, visits=parts)
    if parts == 1 or not held:
        return model
    # visits: where the true neighbours are stored, against the order in which a query visits
    true = neighbours(test, train, 2 * p.near, False)
    stored_in = model.chances(train).argmax(1)
    order = np.argsort(np.argsort(-model.chances(test), axis=1), axis=1)
    place = np.take_along_axis(order, stored_in[true], axis=1)
    met = [float((place < v).mean()) for v in range(1, parts + 1)]
    return Model(*w, visits=next(v for v, share in enumerate(met, 1) if share >= p.target or v == parts))


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """id, v, name of the vectors that take part: name is a hash of the vector.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of another length
    than most have, nor rows without an id.
    """
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    length = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    x = x.where(F.size("v") == (length[0] if length else 0)).select("id", F.transform("v", lambda c: c + 0.0).alias("v"))
    return x.withColumn("name", F.sha2(F.to_json(F.struct("v")), 256))


def points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors of `rows` (id, v, name): name, v, ids (the k + 1 smallest, in order; repeated ids count once)."""
    few = Window.partitionBy("name").orderBy("id")
    x = rows.withColumn("_r", F.dense_rank().over(few)).where(F.col("_r") <= k + 1)
    return x.groupBy("name").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64) if rows else np.empty((0, 0))


def fit(pts: DataFrame, p: Fit = Fit()) -> Model:
    """One task fits the model on the bounded sample."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("name")
            m = learn(_matrix(t["v"]), p)
            for x in (m.a, m.b, m.c, m.d):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()]), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([m.visits], pa.int32())], ["w", "shape", "visits"])

    sample = pts.select("name", "v").orderBy("name").limit(p.sample).coalesce(1)
    got = sample.mapInArrow(run, "w binary, shape array<int>, visits int").collect()
    if not got:
        return Model(np.zeros((0, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    return Model(*(np.frombuffer(r["w"], "<f8").reshape(r["shape"]) for r in got), visits=got[0]["visits"])


def placed(pts: DataFrame, model: Model, visits: int) -> DataFrame:
    """`pts` once for each of its `visits` most probable parts, with `part`."""
    held = pts.sparkSession.sparkContext.broadcast(model)
    schema = pts.withColumn("part", F.lit(0)).schema

    def route(batches):
        m = held.value
        for b in batches:
            if b.num_rows:
                top = np.argsort(-m.chances(_matrix(b.column("v"))), axis=1, kind="stable")[:, :visits]
                take = pa.array(np.repeat(np.arange(b.num_rows), top.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(top.ravel(), pa.int32())], schema.names)

    return pts.mapInArrow(route, schema)


def search(pts: DataFrame, asks: DataFrame, model: Model, k: int, p: Fit = Fit()) -> DataFrame:
    """(name, near, score, low): for every point of `asks` the k + 1 points of the visited parts with the largest inner product.

    Equal scores are ordered by `low`, the smallest id of the point, at every cut: k + 1 points in this order hold the k + 1 first
    ids. A part is split into blocks of about `block` vectors by name, and a part's queries likewise; each pair of blocks is a
    task's unit.
    """
    stored_in = placed(pts.select("name", "v", F.get("ids", F.lit(0)).alias("low")), model, 1)
    stored_in = stored(stored_in, "parts")
    asking = stored(placed(asks.select("name", "v"), model, model.visits), "asking")
    size = lambda df, name: df.groupBy("part").count().select("part", F.ceil(F.col("count") / p.block).alias(name))
    sizes = size(stored_in, "blocks").join(size(asking, "turns"), "part")  # a row per part
    spread = lambda df: df.join(F.broadcast(sizes), "part")
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    base = spread(stored_in).select("part", own("blocks").alias("block"), every("turns").alias("turn"), "name", "v", "low")
    queries = spread(asking).select("part", every("blocks").alias("block"), own("turns").alias("turn"), "name", "v")

    def rank(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.schema([("name", pa.string()), ("near", pa.string()), ("score", pa.float64()), ("low", pa.int64())]).empty_table()
        q, y, low = _matrix(left["v"]), _matrix(right["v"]), right["low"].to_numpy()
        n = min(k + 1, len(y))
        # by so much a product by blocks may differ from the one below
        slack = 4 * y.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(y, axis=1).max()
        at, picks, scores = [], [], []
        for s in range(0, len(q), 256):
            d = q[s : s + 256] @ y.T
            least = np.partition(d, -n, axis=1)[:, -n] - 2 * slack[s : s + 256]
            for i in range(len(d)):
                # all that may be among the first, once more one by one: a pair's score never depends on its place in a block
                near = np.flatnonzero(d[i] >= least[i])
                score = (q[s + i] * y[near]).sum(1)
                best = np.lexsort((low[near], -score))[:n]
                at.append(np.full(len(best), s + i))
                picks.append(near[best])
                scores.append(score[best])
        picks = np.concatenate(picks)
        return pa.table({"name": left["name"].take(pa.array(np.concatenate(at))), "near": right["name"].take(pa.array(picks)), "score": np.concatenate(scores), "low": low[picks]})

    keys = ("part", "block", "turn")
    got = queries.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(rank, "name string, near string, score double, low long")
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "low"))
    return got.withColumn("_r", best).where(F.col("_r") <= k + 1).drop("_r")


def nearest(vectors: DataFrame, key: str, vec: str, every: int, k: int, p: Fit = Fit()) -> DataFrame:
    """query_id, rank, vec_id, score: for every usable row whose id divides by `every`, its k nearest other rows found.

    Nearest first by the inner product in double precision, ties by the smaller id; fewer rows where there are fewer.
    """
    rows = stored(usable(vectors, key, vec), "vectors")
    pts = stored(points(rows, k), "points")
    asked = stored(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "name").distinct(), "asked")
    asks = pts.join(asked.select("name").distinct(), "name", "left_semi")
    found = search(pts, asks, fit(pts, p), k, p)
    # of each asking point the k + 1 nearest ids; of its own ids each query leaves out itself
    members = pts.select(F.col("name").alias("near"), F.explode("ids").alias("vec_id"))
    ids = found.join(members, "near")
    ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    pairs = asked.withColumnRenamed("id", "query_id").join(ids.select("name", "vec_id", "score"), "name").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
