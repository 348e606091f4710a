"""Benchmark decontamination by SimHash windows.

Words are compared without case and outer punctuation. Each benchmark item has a SimHash of its weighted shingles (a
shingle weighs as often as it occurs); a document has one for every window of the item's length. A window whose hash lies
within RADIUS bits of the item's is a candidate: hashes are cut into BLOCKS blocks, and of two hashes that differ in at
most r bits one block differs in at most r // BLOCKS bits, so the item is filed under all values that near of each block
and a window is looked up by its own block values. Candidates are verified: the weighted Jaccard similarity of the two
multisets of shingles (sum of minima over sum of maxima) must reach `least` hundredths.

A window without any shingle of the benchmark has similarity 0, so only windows around shared shingles are hashed. The
items are a stated query set: they are broadcast in blocks of BATCH items, and every block goes over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import U64, WordHashes, grams, hashed, lean, slices

WORDS, LEAST = 5, 75
BITS, BLOCKS, RADIUS = 64, 8, 23
#: Items per block of the query set: some 20 kB each once they are indexed.
BATCH = 4096
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _normal(word: bytes) -> bytes:
    return word.decode("utf-8", "replace").lower().encode().strip(_EDGES) or word


_WORDS = WordHashes(_normal)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hashed(texts, _WORDS)


def forget() -> None:
    _WORDS.clear()


def signs(tokens: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each token."""
    bits = np.unpackbits(tokens.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of bit sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sum of minima and sum of maxima of two multisets of tokens."""
    names, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    ca = np.bincount(np.searchsorted(names, a), minlength=len(names))
    cb = counts - ca
    return int(np.minimum(ca, cb).sum()), int(np.maximum(ca, cb).sum())


class Items:
    """The index of a block of items: their shingles, hashes and, per hash block, the items filed under each value."""

    def __init__(self, ids: list[int], texts: list[bytes], words: int):
        w, starts = word_hashes(texts)
        self.ids, self.words = [], words
        self.length, self.tokens = [], []
        for i, key in enumerate(ids):
            own = w[starts[i] : starts[i + 1]]
            if len(own):  # an item of fewer words is one shingle of its own length
                self.ids.append(key)
                self.length.append(len(own))
                self.tokens.append(grams(own, min(words, len(own))))
        self.known = {n: np.unique(np.concatenate([t for t, m in zip(self.tokens, self.length, strict=True) if min(words, m) == n])) for n in {min(words, m) for m in self.length}}
        self.hash = np.array([simhash(signs(t).sum(0, keepdims=True))[0] for t in self.tokens], U64)
        self.lengths = sorted(set(self.length))
        width = BITS // BLOCKS
        near = [0] + [sum(1 << b for b in c) for k in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(width), k)]
        self.filed = [[[] for _ in range(1 << width)] for _ in range(BLOCKS)]
        for i, h in enumerate(self.hash.tolist()):
            for k in range(BLOCKS):
                value = h >> (k * width) & ((1 << width) - 1)
                for flip in near:
                    self.filed[k][value ^ flip].append(i)
        self.of_length = {m: np.unique(np.concatenate([t for t, n in zip(self.tokens, self.length, strict=True) if n == m])) for m in self.lengths}
        self.by_length = {m: np.array([n == m for n in self.length]) for m in self.lengths}

    def found(self, w: np.ndarray, least: int) -> dict[int, tuple[int, int, int, int]]:
        """item -> (first word, length, sum of minima, sum of maxima) of its most similar window in one text."""
        best: dict[int, tuple[int, int, int, int]] = {}
        width, shared = BITS // BLOCKS, {}
        for n, known in self.known.items():
            tokens = grams(w, n)
            if len(tokens):
                shared[n] = tokens, np.flatnonzero(known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens)
        for m in self.lengths:
            n = min(self.words, m)
            if n not in shared:
                continue
            tokens, hits = shared[n]
            hits = hits[np.isin(tokens[hits], self.of_length[m])]
            if not len(hits):
                continue
            size = min(m, len(w))  # a text shorter than the item is one window
            last = len(w) - size
            step = np.zeros(last + 2, np.int32)
            np.add.at(step, np.clip(hits - (size - n), 0, last), 1)
            np.add.at(step, np.minimum(hits, last) + 1, -1)
            start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            lo, per = start[0], size - n + 1
            sums = np.zeros((start[-1] - lo + per + 1, BITS), np.int32)
            np.cumsum(signs(tokens[lo : start[-1] + per]), axis=0, out=sums[1:])
            hashes = simhash(sums[start - lo + per] - sums[start - lo])
            mine = self.by_length[m]
            for s, h in zip(start.tolist(), hashes.tolist(), strict=True):
                near = {i for k in range(BLOCKS) for i in self.filed[k][h >> (k * width) & ((1 << width) - 1)] if mine[i]}
                for i in near:
                    if (int(self.hash[i]) ^ h).bit_count() > RADIUS:
                        continue
                    low, high = similarity(tokens[s : s + size - n + 1], self.tokens[i])
                    if 100 * low >= least * high and (i not in best or low * best[i][3] > best[i][2] * high):
                        best[i] = (s, size, low, high)
        return best


def matches(docs: DataFrame, items: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, row, item_id, first_word, n_words, similarity: for each text of `docs` (doc_id, text) and each item of
    `items` (item_id, text) that it holds, the most similar window (the first of equals).

    Null and empty texts hold nothing and are held by nothing; items of fewer words than a shingle must occur word by word.
    """
    spark = docs.sparkSession
    out = None
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").where("text is not null")
    schema = "doc_id long, row long, item_id long, first_word int, n_words int, similarity double"
    total = items.agg(F.count("*")).first()[0]
    blocks = -(-total // BATCH)
    for k in range(blocks):  # the query set in blocks of bounded size
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = part.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Items([r["item_id"] for r in got], [r["text"].encode() for r in got], words))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                doc, row, found = b.column("doc_id").to_pylist(), b.column("row").to_pylist(), []
                for at, texts in slices(b.column("text")):
                    w, starts = word_hashes(texts)
                    hit = _touched(index, w, starts)
                    for i in hit:
                        for item, (s, n, low, high) in index.found(w[starts[i] : starts[i + 1]], least).items():
                            found.append((doc[at + i], row[at + i], index.ids[item], s, n, low / high))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                    names = ["doc_id", "row", "item_id", "first_word", "n_words", "similarity"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        one = rows.mapInArrow(lean(look, forget), schema)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def _touched(index: Items, w: np.ndarray, starts: np.ndarray) -> list[int]:
    """The texts of a slice that share a shingle with an item."""
    hit = np.zeros(len(starts) - 1, bool)
    for n, known in index.known.items():
        tokens = grams(w, n)
        if not len(tokens):
            continue
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens)
        text = np.searchsorted(starts, at, side="right") - 1
        hit[text[at + n <= starts[text + 1]]] = True
    return np.flatnonzero(hit).tolist()


def clean(docs: DataFrame, items: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The rows of `docs` that hold no item, with their columns as they are."""
    if "_row" in docs.columns:
        raise ValueError("column _row is taken")
    dirty = matches(docs, items, words, least).select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(dirty, "_row", "left_anti").drop("_row").select(*docs.columns)
