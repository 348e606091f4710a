"""Packing by minimum bin slack.

Texts become token ids; every full window of `capacity` ids is a sequence of its own, and what remains of each text, at
most one piece, is packed whole. Pieces of one length are alike, so the packing needs only how many pieces there are of
each length: at most `capacity` numbers, whatever the corpus holds. For each window the largest remaining length is
taken and a bitset of reachable sums over the remaining multiset finds the rest that comes closest to the capacity; the
counts are read back from the bitsets, and the found pattern is used as often as the multiset allows. Pieces then take
their places by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import ranked, stored
from faultline.llm.words import lean, slices

CAPACITY = 2048
#: Bytes that a worker's three memos (chunks, their words, and what follows the words) may take together, and what an entry
#: takes besides its text and ids.
MEMO_BYTES, ENTRY = 128 << 20, 80
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of a text by a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit values.

    The file's splitting rule starts a new piece at a blank that follows no other blank, so a text is cut at single blanks
    and each distinct chunk is encoded once. A text where a chunk starts with white space is encoded as a whole, and so
    is a text that holds the string of a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is text
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        rule = spec["pre_tokenizer"] or {}
        self.model = self.tokenizer.model
        plain = spec["normalizer"] is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        self.memo = _Memo(self.whole, self.word if plain else self.whole)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        """Of a blank and letters: one piece by the splitting rule, so it goes straight to the model in its byte alphabet."""
        return np.array([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(_SIGNS))], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return (self.whole(first) if first else b"") + b"".join(map(self.memo.__getitem__, rest))
        except _Uncuttable:
            return self.whole(text)


def _signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


_SIGNS = _signs()


class _Uncuttable(Exception):
    pass


class _Memo(dict):
    """Ids of a chunk after a blank. A chunk of letters and something that starts with an ASCII sign is encoded in these two
    parts, which the splitting rule never joins. Full memos keep what they have: the frequent chunks come early."""

    LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    PARTS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([\n!-@\[-`{-~][\s\S]*)")

    def __init__(self, encode, word):
        super().__init__()
        self.encode, self.word, self.words, self.rests, self.room = encode, word, {}, {}, MEMO_BYTES

    def keep(self, memo: dict[str, bytes], text: str, ids: bytes) -> None:
        size = len(text) * (1 if text.isascii() else 4) + len(ids) + ENTRY
        if size <= self.room:
            memo[text] = ids
            self.room -= size

    def part(self, memo: dict[str, bytes], encode, text: str) -> bytes:
        ids = memo.get(text)
        if ids is None:
            ids = encode(text)
            self.keep(memo, text, ids)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Uncuttable
        two = self.PARTS.fullmatch(chunk)
        if two:
            ids = self.part(self.words, self.word, " " + two[1]) + self.part(self.rests, self.encode, two[2])
        else:
            letters = self.LETTERS.fullmatch(chunk)
            ids = self.part(self.words, self.word if letters else self.encode, " " + chunk)
        self.keep(self, chunk, ids)
        return ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Cut every text (doc_id, text; null is empty) with `end_id` at its end: doc_id, start, length, ids_crc32, doc_tokens,
    and ids (little-endian unsigned 32-bit) if asked for. Repeated doc_ids are texts of their own."""
    schema = PIECE + (", ids binary" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer).ids  # one per task, so its memos go with it
        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for at, texts in slices(b.column("text")):
                rows = []
                for i, t in enumerate(texts):
                    ids = encode(t.decode("utf-8", "replace")) + end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        part = ids[4 * s : 4 * (s + capacity)]
                        rows.append((keys[at + i], s, len(part) // 4, zlib.crc32(part), n, part)[: 5 + keep_ids])
                kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(lean(cut), schema)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length come closest to `room` from below: bitset subset sums, with the counts read back."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            grown = (reach | reach << (take * length)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, per sequence, first sequence, offset) for every length of every pattern.

    A pattern is used until one of its lengths no longer suffices, so there are at most a few patterns per length.
    """
    left, taken, out, sequence = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while left:
        top = max(left)
        left[top] -= 1
        use = closest(left, capacity - top)
        left[top] += 1
        use[top] = use.get(top, 0) + 1
        times, offset = min(left[k] // c for k, c in use.items()), 0
        for k, c in sorted(use.items(), reverse=True):
            out.append((k, taken[k], taken[k] + times * c, c, sequence, offset))
            taken[k] += times * c
            left[k] -= times * c
            offset += c * k
            if not left[k]:
                del left[k]
        sequence += times
    return out


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces with a `length` of 1 to `capacity`.

    The plan holds at most a few rows per length and is broadcast; pieces are ranked without gathering a length.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)]
    steps = spark.createDataFrame(rows, "length long, _from long, _to long, _per long, _first long, _at long")
    placed = ranked(cut, "length", "_rank").join(F.broadcast(steps), "length").where("_rank >= _from and _rank < _to")
    spot = F.col("_rank") - F.col("_from")
    return placed.withColumn("sequence_id", F.col("_first") + F.floor(spot / F.col("_per"))).withColumn(
        "offset", F.col("_at") + spot % F.col("_per") * F.col("length")
    ).drop("_rank", "_from", "_to", "_per", "_first", "_at")


def packing_report(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every text.

    A null or empty text is its end id alone; without documents there are no sequences.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = packed(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
