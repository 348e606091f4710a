"""Language identification by nearest centroid.

A text is the vector of its hashed character n-grams (2 to 4 bytes of lower-cased text, anything but letters as one
blank), with log counts, IDF weights and unit length. Each language has several centroids, found by spherical k-means, so
that text of different kinds in one language need not share one; a text takes the language of the centroid with the
largest cosine. A text farther from its centroid than nearly all rows of the fit is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.toxicity import held_out
from faultline.llm.words import U64, mix, slices

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = r"\p{L}"
ORDERS = (2, 3, 4)
#: Parts of a language that are ranked on their own.
PARTS = 256


@dataclass(frozen=True)
class Fit:
    """Parameters. Centroids are fitted on at most `sample` keys of each language (smallest hashes), each text as a whole
    and by its first words; IDF counts cover every row that may be learned from."""

    bits: int = 12
    clusters: int = 4
    rounds: int = 8
    sample: int = 1500
    seed: int = 3


def counts(texts: list[bytes], bits: int) -> np.ndarray:
    """One row of n-gram counts per text."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for r, t in enumerate(texts):
        clean = _OTHER.sub(" ", t.decode("utf-8", "replace").lower()).strip()
        if not clean:
            continue
        b = np.frombuffer(f" {clean} ".encode(), np.uint8).astype(U64)
        total = np.zeros(1 << bits, np.int64)
        for n in ORDERS:
            if len(b) >= n:
                v = np.full(len(b) - n + 1, n, U64)
                for k in range(n):
                    v = (v << U64(8)) | b[k : len(b) - n + 1 + k]
                total += np.bincount((mix(v) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        out[r] = total
    return out


def vectors(texts: list[bytes], bits: int, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts, bits)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def centroids(v: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from far points; returns the centroids and each row's cosine to its own."""
    rng = np.random.default_rng(seed)
    c = v[[int(rng.integers(len(v)))]]
    while len(c) < min(k, len(v)):
        c = np.vstack([c, v[int(np.argmin((v @ c.T).max(1)))]])
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c, (v @ c.T).max(1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    langs: list[str]
    lang: np.ndarray
    centres: np.ndarray
    least: np.ndarray


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """(lang, o, text) of the `most` smallest distinct `o` of each language; rows that share an `o` count as one, with their
    smallest text.

    Only (lang, o) is ranked, first within parts of a language, so that no task sees a whole one; texts move for the sample alone.
    """
    keys = rows.select("lang", "o").distinct().withColumn("part", F.pmod("o", F.lit(PARTS)))
    for by in (("lang", "part"), ("lang",)):
        keys = keys.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).where(F.col("_r") <= most).drop("_r")
    last = keys.groupBy("lang").agg(F.max("o").alias("last"))  # a row per language, as the model has
    near = rows.join(F.broadcast(last), "lang").where("o <= last")
    return near.groupBy("lang", "o").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, p: Fit = Fit()) -> Model:
    """Fit on rows (key, text, lang); rows with a null language or no letter teach nothing. The model is a few hundred kB
    per language, whatever the table holds."""
    bits = p.bits

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for _, texts in slices(b.column("text"), 1 << 20):
                df += (counts(texts, bits) > 0).sum(0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << bits), pa.int64()), pa.array(np.append(n, df), pa.int64())], ["i", "n"])

    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)).select("key", "text", "lang")
    got = rows.select("text").mapInArrow(frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << bits) + 1)
    for r in got:
        df[r.i + 1] = r.n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    def learn(key, table):
        texts = [t.encode() for t in table.sort_by("o")["text"].to_pylist()]
        # short texts must find their language too: each row also teaches by its first words
        v = np.vstack([vectors(texts, bits, idf), vectors([b" ".join(t.split()[:8]) for t in texts], bits, idf)])
        v = v[(v * v).sum(1) > 0]
        c, own = centroids(v, p.clusters, p.rounds, p.seed)
        low = float(np.quantile(own, 0.001))
        return pa.table({"lang": [key[0].as_py()] * len(c), "c": [x.astype("<f4").tobytes() for x in c], "least": [low] * len(c)})

    taken = sampled(rows.withColumn("o", F.xxhash64("key")), p.sample)
    found = taken.groupBy("lang").applyInArrow(learn, "lang string, c binary, least double").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["c"]))
    langs = sorted({r["lang"] for r in found})
    centres = np.stack([np.frombuffer(r["c"], "<f4") for r in found]) if found else np.zeros((0, 1 << bits), np.float32)
    return Model(idf, langs, np.array([langs.index(r["lang"]) for r in found], np.int64), centres, np.array([r["least"] for r in found]))


def identified(docs: DataFrame, text: str, model: Model, bits: int = Fit.bits) -> DataFrame:
    """Add lang_pred, score (cosine, 0 to 1) and rejected to `docs`.

    `und`, score 0 and rejected: a null text, a text without a letter, or a model without languages. Equal cosines go to
    the language that sorts first.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumns({"lang_pred": F.col(text).rlike(_LETTER).cast("string"), "score": F.lit(0.0), "rejected": F.lit(True)})
    schema = rows.schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            letters = np.array([x == "true" for x in b.column("lang_pred").to_pylist()], bool)
            lang, score, far = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            for at, texts in slices(b.column(text), 1 << 20):
                if not len(m.langs):
                    continue
                cos = vectors(texts, bits, m.idf) @ m.centres.T
                best = cos.argmax(1)
                s = np.clip(cos[np.arange(len(texts)), best], 0, 1)
                ok = letters[at : at + len(texts)]
                lang[at : at + len(texts)] = np.where(ok, np.array(m.langs, object)[m.lang[best]], "und")
                score[at : at + len(texts)] = np.where(ok, s, 0)
                far[at : at + len(texts)] = ~ok | (s < m.least[best])
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols |= {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "rejected": pa.array(far)}
            yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

    return rows.mapInArrow(predict, schema)


def language_report(docs: DataFrame, p: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of `docs`; held-out rows are never learned from."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out).select(F.col("doc_id").alias("key"), "text", "lang"), p)
    return identified(docs.select("doc_id", "text"), "text", model, p.bits).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
