"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

A text's features are the distinct hashes of its words, its word pairs and its pairs with one word between, all words
without case and outer punctuation. FTRL keeps two sums per coordinate, so every coordinate has its own learning rate,
and its L1 term leaves most weights at exactly 0: only the others are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import U64, WordHashes, hashed, lean, mix, owner, slices

_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_WORDS = WordHashes(lambda w: w.decode("utf-8", "replace").lower().encode().strip(_EDGES) or w)
#: Bytes of texts whose features are taken at once.
_SLICE = 1 << 20
_PAIR, _SKIP = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ftrl:
    """Parameters. At most `sample` labelled rows are used for the fit: those whose hashed key is smallest."""

    bits: int = 18
    alpha: float = 0.8
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    passes: int = 5
    least_rows: int = 3
    sample: int = 12_000
    seed: int = 7


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each feature, feature): all of them, with repeats."""
    h, starts = hashed(texts, _WORDS)
    own, shift = owner(starts), U64(64 - bits)
    out, at = [mix(h) >> shift], [own]
    for gap, odd in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = own[gap:] == own[:-gap]
            out.append((mix(h[:-gap] * odd + h[gap:]) >> shift)[same])
            at.append(own[gap:][same])
    return np.concatenate(at), np.concatenate(out).astype(np.int64)


def forget() -> None:
    _WORDS.clear()


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(flat: np.ndarray, size: np.ndarray, labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of distinct features (all in one array, `size` of each row), one row at a time; returns the
    weights that are not 0.

    A feature of fewer than `least_rows` rows is left out. The last coordinate is the intercept, which bears no L1.
    """
    n, z = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    count = np.zeros(1 << p.bits, np.int64)
    for at in range(0, len(flat), 1 << 20):
        count += np.bincount(flat[at : at + (1 << 20)], minlength=1 << p.bits)
    often, stay = count >= p.least_rows, np.zeros(len(flat) + 1, np.int64)
    np.cumsum(often[flat], out=stay[1:])
    ends = np.concatenate([[0], np.cumsum(size)])
    flat, starts = flat[often[flat]], stay[ends]
    del stay
    rng = np.random.default_rng(p.seed)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        w[np.abs(z[i]) <= p.l1] = 0.0
        w[-1] = -z[i[-1]] / ((p.beta + np.sqrt(n[i[-1]])) / p.alpha + p.l2)
        return w

    for _ in range(p.passes):
        for r in rng.permutation(len(size)):
            i = np.append(flat[starts[r] : starts[r + 1]], np.uint32(1 << p.bits))
            w = weights(i)
            g = float(_sigmoid(w.sum()) - labels[r])
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - s * w
            n[i] += g * g
    every = np.arange(len(z))
    w = weights(every)
    kept = np.flatnonzero(w)
    return kept, w[kept]


def fit(docs: DataFrame, known: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights from `docs` (doc_id, text) and `known` (doc_id, label 0/1, neither null); no rows give no weights.

    The sample is chosen among the narrow labels, so only its texts move; of repeated doc_ids the smallest text and label
    count once. Its features are taken in parallel, and one task holds them for the passes.
    """
    bits = p.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column("text"), _SLICE):
                own, f = features(texts, bits)
                both = np.unique((own.astype(np.int64) << 32) | f)
                cut = np.searchsorted(both >> 32, np.arange(len(texts) + 1))
                rows = [(both[cut[i] : cut[i + 1]] & 0xFFFFFFFF).astype("<u4").tobytes() for i in range(len(texts))]
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("o"), part.column("label"), pa.array(rows, pa.binary())], ["o", "label", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [t for t in batches if t.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        order = np.lexsort((t["label"].to_numpy(), t["o"].to_numpy()))
        t = t.take(pa.array(order))
        size = pa.compute.binary_length(t["f"]).to_numpy() // 4
        flat = np.frombuffer(b"".join(x.as_buffer() for x in t["f"]), "<u4")
        kept, w = train(flat, size, t["label"].to_numpy(), p)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w, pa.float64())], ["i", "w"])

    order = F.xxhash64("doc_id").alias("o")
    sample = known.groupBy("doc_id").agg(F.min("label").cast("double").alias("label")).select("doc_id", order, "label").orderBy("o").limit(p.sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("o", "label").agg(F.min("text").alias("text")).repartition(24, "o").mapInArrow(lean(extract, forget), "o long, label double, f binary")
    found = rows.repartition(1).mapInArrow(lean(learn, forget), "i long, w double").collect()  # at most 2**bits + 1 rows
    return np.array([r.i for r in found], np.int64), np.array([r.w for r in found])


def scored(docs: DataFrame, text: str, weights: tuple[np.ndarray, np.ndarray], p: Ftrl = Ftrl(), name: str = "score") -> DataFrame:
    """Add `name` to `docs`: the probability of label 1 from the whole text; null and empty texts score by the intercept."""
    dense = np.zeros((1 << p.bits) + 1, np.float32)
    dense[weights[0]] = weights[1]
    held = docs.sparkSession.sparkContext.broadcast((dense != 0, dense))
    bits, schema = p.bits, docs.withColumn(name, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, w = held.value
        for b in batches:
            out = np.full(b.num_rows, float(w[-1]))
            for at, texts in slices(b.column(text), _SLICE):
                own, f = features(texts, bits)
                hit = np.flatnonzero(used[f])
                both = np.unique((own[hit].astype(np.int64) << 32) | f[hit])
                out[at : at + len(texts)] += np.bincount(both >> 32, weights=w[both & 0xFFFFFFFF], minlength=len(texts))
            cols = dict(zip(b.schema.names, b.columns, strict=True)) | {name: pa.array(_sigmoid(out), pa.float64())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

    return docs.mapInArrow(lean(score, forget), schema)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the key as text leaves `fold`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def learnable(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: labelled and in no held-out fold."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col(label).alias("label"))


def toxicity_report(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; rows of the held-out fold are never learned from."""
    weights = fit(docs, learnable(labels), p)
    out = scored(docs.select("doc_id", "text"), "text", weights, p)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """The documents whose score stays below 0.5, with their columns as they are."""
    if "_toxic" in docs.columns:
        raise ValueError("column _toxic is taken")
    weights = fit(docs, learnable(labels), p)
    return scored(docs, "text", weights, p, "_toxic").where("_toxic < 0.5").drop("_toxic")
