"""Words of whole texts as hash arrays, batch by batch, inside Spark tasks.

A word is a run of bytes other than the ASCII blanks 0x20 and 0x09-0x0D. Every function here works on one
Arrow batch, cut into slices of a few MB, so that memory is bound by a slice and the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

SLICE_BYTES = 4 << 20
#: Bytes a memo of words may take, and what an entry takes besides the word itself.
CACHE_BYTES, ENTRY = 64 << 20, 85

U64 = np.uint64
_C1, _C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_ODD = U64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash of its normal form; filled on demand and emptied when it holds CACHE_BYTES."""

    def __init__(self, normal: Callable[[bytes], bytes] | None = None):
        super().__init__()
        self.normal, self.held = normal, 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        h, size = xxhash.xxh64_intdigest(self.normal(word) if self.normal else word), len(word) + ENTRY
        if self.held + size > CACHE_BYTES:
            self.clear()
        if size <= CACHE_BYTES:
            self[word] = h
            self.held += size
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]):
    """`task`, a function of a partition's batches, that leaves nothing behind in a reused worker: memos are emptied by
    `forget`, and freed memory goes back to the system (glibc keeps it otherwise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def parts(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `limit` bytes in a text column; one long text is a run of its own. An empty batch has none."""
    if not batch.num_rows:
        return
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // limit
    cut = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
    for s, e in zip(cut, [*cut[1:], batch.num_rows], strict=True):
        yield batch.slice(s, e - s)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = (h ^ (h >> U64(33))) * _C1
    h = (h ^ (h >> U64(33))) * _C2
    return h ^ (h >> U64(33))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on; len(w) - n + 1 of them."""
    if len(w) < n:
        return np.empty(0, U64)
    h, k = w, 1
    while 2 * k <= n:
        h, k = mix(h[: len(h) - k] * _ODD + h[k:]), 2 * k
    if k < n:  # two overlapping runs of k cover n
        h = mix(h[: len(w) - n + 1] * _C1 + h[n - k : len(w) - k + 1])
    return h


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of about `limit` bytes; null is the empty text."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts.cast(pa.binary())):
        b = t.as_py() or b""
        run.append(b)
        size += len(b)
        if size >= limit:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def hashed(texts: list[bytes], cache: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and where each text starts in it (one more entry at the end)."""
    parts = [cache.of((t.lower() if lower else t).split()) for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return (np.concatenate(parts) if parts else np.empty(0, U64)), starts


#: Bytes that end a word; words of more than MANY bytes are hashed one by one.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MANY = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def hashed_plain(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What `hashed` gives (other values) for words as they are: all words of a slice at once, eight bytes at a time."""
    raw = b" ".join(texts) + b" " * 8
    raw = raw.lower() if lower else raw
    buf = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(buf) + 1, bool)  # one more in front
    np.logical_not(_BLANK[buf], out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    at, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(buf) - 7,), "<u8", buffer=raw, strides=(1,))
    h = size.astype(U64) * _ODD
    left = np.arange(len(at)) if len(at) == 0 or size.max() <= MANY else np.flatnonzero(size <= MANY)
    done = 0
    while len(left):
        rest = size[left] - done
        h[left] = mix(h[left] * _ODD + (eight[at[left] + done] & _KEEP[np.minimum(rest, 8)]))
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(size > MANY):
        h[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + size[i]])
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return h, np.searchsorted(at, begin)


def owner(starts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def within(starts: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n words lie in one text."""
    total = int(starts[-1])
    if total < n:
        return np.empty(0, np.int64)
    ok = np.ones(total - n + 1, bool)
    for e in starts[1:-1]:
        ok[max(0, int(e) - n + 1) : int(e)] = False
    return np.flatnonzero(ok)


def pack48(h: np.ndarray) -> bytes:
    """The upper 48 bits of each value, six bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    """What pack48 kept, as values below 2**48."""
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()
