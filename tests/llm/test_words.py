import random

import numpy as np
import pyarrow as pa
import xxhash

from faultline.llm import packing, words
from faultline.llm.words import MANY, hashed_plain


def test_plain_hashes_tell_words_apart_and_count_them_per_text():
    rng = random.Random(1)
    texts = [b"", b" \t\n", b"a", b"A b  a", b"x" * (MANY + 1) + b" " + b"x" * MANY, b"12345678 123456789 1234567", "é ü é".encode(), b"\x00 \x00\x00"]
    texts += [bytes(rng.choice(b"ab \n\x0b") for _ in range(rng.randrange(60))) for _ in range(300)] + [b""]
    for lower in (False, True):
        h, starts = hashed_plain(texts, lower)
        plain = [w for t in texts for w in (t.lower() if lower else t).split()]
        assert np.diff(starts).tolist() == [len(t.split()) for t in texts]
        known = {}
        assert all(known.setdefault(w, x) == x for w, x in zip(plain, h.tolist(), strict=True))
        assert len(set(known.values())) == len(known)
    assert [len(x) for x in hashed_plain([])] == [0, 1]


def test_memos_are_bound_in_bytes(monkeypatch):
    monkeypatch.setattr(words, "CACHE_BYTES", 1000)
    memo = words.WordHashes()
    plain = [b"w%d" % i for i in range(500)] + [b"x" * 5000]
    assert memo.of(plain).tolist() == [xxhash.xxh64_intdigest(w) for w in plain]
    assert memo.held <= 1000 and sum(len(w) + words.ENTRY for w in memo) == memo.held
    monkeypatch.setattr(packing, "MEMO_BYTES", 2000)
    held = packing._Memo(lambda t: t.encode() * 4, lambda t: t.encode() * 4)
    for w in ["ab", "long" * 900, *(f"w{i}" for i in range(100)), "ab,cd"]:
        assert held[w] == held[w]
    assert 0 <= held.room < 200 and sum(len(k) + len(v) + packing.ENTRY for m in (held, held.words, held.rests) for k, v in m.items()) == 2000 - held.room


def test_a_lean_task_empties_its_memos_and_parts_are_runs_of_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"], "k": [1, 2, 3, 4, 5]})
    seen = []
    assert list(words.lean(lambda batches: (b for b in batches), lambda: seen.append(1))([batch])) == [batch] and seen == [1]
    cut = list(words.parts(batch, "text", 50))
    assert [k for p in cut for k in p["k"].to_pylist()] == [1, 2, 3, 4, 5] and len(cut) == 2
    assert list(words.parts(batch.slice(0, 0), "text")) == []
