"""Substring dedup by prefix-partitioned suffix trees.

A window of `span` words is repeated if it is the prefix of two suffixes of the corpus, that is, if the suffix tree has an
internal node at least `span` words deep above it. The tree is never held whole:

* A suffix belongs to the subtree of a prefix. The prefix is that of the smallest of the KEY-word runs in the suffix's
  first `span` words, so equal windows meet in one subtree, and about a dozen neighbouring suffixes share one record.
* A record is split further by longer prefixes: the run's place in the window (how many words stand before it) and two
  independent 64-bit prints of all `span` words. The subtree is the sorted list of these; equal neighbours are its deep
  internal nodes. Windows are the same only if prefix, place and both prints agree.
* Records are counted per prefix first. A prefix with a single record has no deep node, so its windows' prints are never
  sent. The prefixes with more are known by a bit sketch that lets a few others through, which changes no result.
* Subtrees are dealt to groups by the prefix hash; the number of groups follows the corpus, so a group fits one task. A
  prefix with more than HEAVY records is lengthened: its records are taken apart into windows, which are dealt by prefix,
  place and print, so a run that any share of the texts holds loads all groups alike.
* Records that a slice has several times are sent once and marked as repeated. The others need no comparison: only their
  places are sent, dealt by row. So one passage with any number of copies loads a group by at most one record per slice.

Neighbouring deep nodes of one text add up to its maximal repeats, and every word under one is marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import U64, grams, hashed_plain, lean, mix, owner, pack48, parts, slices, unpack48, within

SPAN, KEY = 35, 12
#: Words per group: at 16 bytes a window a group of 4 million words holds 64 MB of prints, if all of them are sent.
GROUP_WORDS = 4_000_000
#: The sketch of prefixes has two to four bits per KEY words, 2**28 (32 MB) at most; a full one only sends more.
SKETCH_LOG = 28
#: Records from which a prefix is heavy: up to 24 windows each, some 12 MB of prints.
HEAVY = 1 << 15
_PLACE = U64(0xFFFFFFFF)
_OTHER = U64(0xD6E8FEB86659FD93)


def records(w: np.ndarray, starts: np.ndarray, span: int, key: int) -> dict[str, np.ndarray]:
    """The windows of all texts as runs that share their smallest key-word run.

    text: of the record; first: place of its first window among all words; n: its windows; lead: words before the key run
    in the first window; prefix: hash of the key run.
    """
    at = within(starts, span)
    if not len(at):
        none = np.empty(0, np.int64)
        return {"text": none, "first": none, "n": none, "lead": none, "prefix": np.empty(0, U64)}
    runs = grams(w, key)
    low = (runs & ~_PLACE) | np.arange(len(runs), dtype=U64)  # equal upper bits: the leftmost wins
    width, k = span - key + 1, 1
    while 2 * k <= width:
        low, k = np.minimum(low[: len(low) - k], low[k:]), 2 * k
    if k < width:
        n = len(runs) - width + 1
        low = np.minimum(low[:n], low[width - k : width - k + n])
    where = (low[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    own = owner(starts)
    return {
        "text": own[at[head]], "first": at[head], "n": np.diff(np.append(head, len(at))), "lead": where[head] - at[head],
        "prefix": runs[where[head]],
    }


def _bits(n: np.ndarray) -> np.ndarray:
    return ((1 << n.astype(np.int64)) - 1).astype(np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, for each pair."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _census(batches, span: int, key: int, log_groups: int):
    """The prefixes (mixed, 48 bits) of every slice's records, one row per group that has some; `many` counts those that
    occur several times, which come first."""
    for b in batches:
        for _, texts in slices(b.column("text")):
            w, starts = hashed_plain(texts)
            prefix, n = np.unique(mix(records(w, starts, span, key)["prefix"]) >> U64(16), return_counts=True)
            group = (prefix >> U64(48 - log_groups)).astype(np.int64)
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            out = []
            for part in np.split(np.arange(len(prefix)), cut[1:]) if len(prefix) else []:
                p, m = prefix[part], n[part]
                out.append((int(group[part[0]]), pack48(np.concatenate([p[m > 1], p[m == 1]]) << U64(16)), m[m > 1].astype("<u4").tobytes()))
            if out:
                kinds = (pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "prefix", "many"])


def _counted(table, log_groups: int, log_bits: int, heavy: int):
    """Of one group: its part of the sketch of prefixes with two records or more, and the prefixes with more than `heavy`."""
    prefixes, counts = [], []
    for p, m in zip(table["prefix"].to_pylist(), table["many"].to_pylist(), strict=True):
        prefixes.append(unpack48(p))
        counts.append(np.ones(len(prefixes[-1]), np.int64))
        counts[-1][: len(m) // 4] = np.frombuffer(m, "<u4")
    prefix, back = np.unique(np.concatenate(prefixes), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts))
    bits = np.zeros(1 << log_bits - log_groups, bool)
    bits[((prefix[n > 1] >> U64(48 - log_bits)) & U64(len(bits) - 1)).astype(np.int64)] = True
    return pa.table({"grp": table["grp"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "heavy": pa.array([pack48(prefix[n > heavy] << U64(16))], pa.binary())})


def _apart(r: dict[str, np.ndarray], heavy: np.ndarray) -> dict[str, np.ndarray]:
    """The records `r`, those of heavy prefixes (mixed, 48 bits) taken apart into one record per window."""
    times = np.where(np.isin(mix(r["prefix"]) >> U64(16), heavy), r["n"], 1)
    if not len(heavy) or times.max(initial=1) == 1:
        return r
    own, place = np.repeat(np.arange(len(times)), times), _spread(np.zeros_like(times), times)
    r = {k: v[own] for k, v in r.items()}
    return r | {"first": r["first"] + place, "lead": r["lead"] - place, "n": np.where(times[own] > 1, 1, r["n"])}


def _share(batches, span: int, key: int, groups: int, sketch: np.ndarray, log_bits: int, heavy: np.ndarray):
    """Records of every slice whose prefix the sketch has, one row per group that has some."""
    names = ["grp", "row", "first", "n", "lead", "known", "prefix", "prints", "second"]
    for b in batches:
        rows = b.column("row").to_numpy()
        for at, texts in slices(b.column("text")):
            w, starts = hashed_plain(texts)
            r = records(w, starts, span, key)
            spot = (mix(r["prefix"]) >> U64(64 - log_bits)).astype(np.int64)
            meets = (sketch[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)
            r = _apart({k: v[meets] for k, v in r.items()}, heavy)
            if not len(r["first"]):
                continue
            ends = np.cumsum(r["n"])
            windows = _spread(r["first"], r["n"])
            prints, second = grams(w, span)[windows], grams(mix(w ^ _OTHER), span)[windows]
            # equal records of this slice: sums of mixed prints, the prefix, the lead and the length tell them apart
            place = _spread(np.zeros_like(r["n"]), r["n"]).astype(U64)
            tail = r["prefix"] * U64(3) + (r["lead"] * 64 + r["n"]).astype(U64)
            one, two = (np.add.reduceat(mix(x + place), ends - r["n"]) + tail for x in (prints, second))
            order = np.lexsort((two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(order)))
            send, known = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
            send[order[new]] = True
            known[order[new]] = np.where(many > 1, _bits(r["n"][order[new]]), 0)
            row, first = rows[at + r["text"]], r["first"] - starts[r["text"]]
            # windows of a heavy prefix go by all that names them, copies by their row
            light = ~np.isin(mix(r["prefix"]) >> U64(16), heavy)
            deal = np.where(light, r["prefix"], mix(r["prefix"] + prints[ends - r["n"]] * U64(3) + r["lead"].astype(U64)))
            deal = np.where(send, deal, mix(row.astype(np.int64).view(U64)))
            group = (deal >> U64(40)).astype(np.int64) % groups
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order], prepend=-1))
            sent = np.repeat(send, r["n"])
            out = []
            for part in np.split(order, cut[1:]):
                mine = _spread((ends - r["n"])[part], r["n"][part])
                mine = mine[sent[mine]]
                out.append((
                    int(group[part[0]]), row[part].astype("<i8").tobytes(), first[part].astype("<u4").tobytes(), r["n"][part].astype(np.uint8).tobytes(),
                    r["lead"][part].astype(np.uint8).tobytes(), np.where(send[part], known[part], -1).astype("<i4").tobytes(), r["prefix"][part].astype("<u8").tobytes(),
                    prints[mine].astype("<u8").tobytes(), second[mine].astype("<u8").tobytes(),
                ))
            kinds = [pa.int32()] + [pa.binary()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _deep(table, span: int, key: int):
    """Of one group: the windows below a deep internal node, one row per text and run of windows."""
    join = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    row, first, n, lead, known, prefix = (join(c, k) for c, k in (("row", "<i8"), ("first", "<u4"), ("n", "u1"), ("lead", "u1"), ("known", "<i4"), ("prefix", "<u8")))
    n = n.astype(np.int64)
    send = known != -1
    prints, second = join("prints", "<u8"), join("second", "<u8")
    each = n[send]
    place = _spread(np.zeros_like(each), each)
    own = np.repeat(np.flatnonzero(send), each)
    # equal windows have equal prints, so in this order they are neighbours; all that names a window is compared
    order = np.lexsort((second, prints))
    eq = np.ones(max(len(order) - 1, 0), bool)
    for x in (prints, second, prefix[own], lead[own].astype(np.int64) - place):
        x = x[order]
        eq &= x[1:] == x[:-1]
    deep = np.zeros(len(order), bool)
    deep[order[1:][eq]] = True
    deep[order[:-1][eq]] = True
    deep |= (known[own] >> place & 1).astype(bool)
    rest = np.flatnonzero(~send)  # copies inside a batch: wholly repeated
    row_out = np.concatenate([row[own[deep]], np.repeat(row[rest], n[rest])])
    at = np.concatenate([first[own[deep]].astype(np.int64) + place[deep], _spread(first[rest].astype(np.int64), n[rest])])
    order = np.lexsort((at, row_out))
    row_out, at = row_out[order], at[order]
    once = np.ones(len(at), bool)  # equal rows share their windows
    once[1:] = (row_out[1:] != row_out[:-1]) | (at[1:] != at[:-1])
    row_out, at = row_out[once], at[once]
    new = np.ones(len(at), bool)
    new[1:] = (row_out[1:] != row_out[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return pa.table({"row": row_out[head], "first": at[head].astype(np.int32), "n": np.diff(np.append(head, len(at))).astype(np.int32)})


def dealt(texts: DataFrame, span: int = SPAN, key: int = KEY, heavy: int = HEAVY) -> DataFrame:
    """The records of `texts` (row, text) that may hold repeated windows, dealt to groups (grp)."""
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(12, int(size / 6 / GROUP_WORDS) + 1)
    log_groups = max(4, groups.bit_length())
    log_bits = max(min(int(size / 6 / key * 2).bit_length(), SKETCH_LOG), log_groups + 12)

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _census(batches, span, key, log_groups)

    def counted(table):
        return _counted(table, log_groups, log_bits, heavy)

    texts = texts.select("row", "text")
    found = texts.select("text").mapInArrow(lean(census), "grp int, prefix binary, many binary").groupBy("grp").applyInArrow(counted, "grp int, bits binary, heavy binary")
    sketch, often = np.zeros((1 << log_groups, 1 << log_bits - log_groups - 3), np.uint8), []
    for r in found.toLocalIterator():
        sketch[r.grp] = np.frombuffer(r.bits, np.uint8)
        often.append(unpack48(r.heavy))
    held = texts.sparkSession.sparkContext.broadcast((sketch.ravel(), np.concatenate([np.empty(0, U64), *often])))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, many = held.value
        return _share(batches, span, key, groups, bits, log_bits, many)

    kinds = "grp int, row binary, first binary, n binary, lead binary, known binary, prefix binary, prints binary, second binary"
    return texts.mapInArrow(lean(share), kinds)


def repeats(texts: DataFrame, span: int = SPAN, key: int = KEY, heavy: int = HEAVY) -> DataFrame:
    """Runs of repeated windows: row, first (word), n, for `texts` (row, text), row being a long that names the text.
    Prefixes with more than `heavy` records are taken apart."""

    def deep(table):
        return _deep(table, span, key)

    return dealt(texts, span, key, heavy).groupBy("grp").applyInArrow(deep, "row long, first int, n int")


def covered(n_words: int, runs: list[tuple[int, int]], span: int) -> np.ndarray:
    """Which of a text's words lie under a run of repeated windows."""
    step = np.zeros(n_words + 1, np.int32)
    for first, n in runs:
        step[first] += 1
        step[first + n + span - 1] -= 1
    return np.cumsum(step[:-1]) > 0


def _named(docs: DataFrame) -> DataFrame:
    """`row`: a hash of doc_id and text; repeated rows share it, and with it their removals."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def _with_runs(docs: DataFrame, span: int, key: int) -> DataFrame:
    """`docs` with `runs`, the repeated windows of each text in word order (null: none). A window of a row is
    found at most twice (in its prefix's group and, as a copy inside a slice, in its row's), whatever the number of equal
    rows, so the list is bound by the text itself. Copies of a whole row count as other places."""
    named = _named(docs)
    found = repeats(named.select("row", "text"), span, key)
    found = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("runs"))
    return named.join(found, "row", "left").drop("row")


def substring_report(docs: DataFrame, span: int = SPAN, key: int = KEY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs` (doc_id, text): each word under a window of `span`
    words that also starts elsewhere is removed, in all its places; null and empty texts have no words."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in parts(batch, "text")):
            out = []
            for doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                words = (text or "").encode().split()
                kept = words
                if runs:
                    gone = covered(len(words), [(r["first"], r["n"]) for r in runs], span)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_runs(docs.select("doc_id", "text"), span, key).mapInArrow(lean(report), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN, key: int = KEY) -> DataFrame:
    """`docs` with its columns, repeated passages cut out of `text` (what stands between kept words stays) and n_chars set
    anew for the texts that lost words. Texts without repeats stay as they are, null texts stay null."""
    import re

    taken = {"row", "runs"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    schema, word = docs.schema, re.compile(rb"[^\x20\x09-\x0d]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in parts(batch, "text")):
            texts, runs = b.column("text").to_pylist(), b.column("runs").to_pylist()
            changed = {}
            for i, (t, r) in enumerate(zip(texts, runs, strict=True)):
                if t is None or not r:
                    continue
                raw = t.encode()
                spots = [m.span() for m in word.finditer(raw)]
                gone = covered(len(spots), [(x["first"], x["n"]) for x in r], span)
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                keep, at = [], 0
                for s, e in edges.reshape(-1, 2):
                    keep.append(raw[at : spots[s][0]])
                    at = spots[e][0] if e < len(spots) else len(raw)
                changed[i] = (b"".join(keep) + raw[at:]).decode()
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(texts)]
                cols["text"] = pa.array(texts, pa.string())
                if "n_chars" in cols:
                    old = cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([len(changed[i]) if i in changed else old[i] for i in range(len(old))], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

    return _with_runs(docs, span, key).select(*docs.columns, "runs").mapInArrow(lean(cut), schema)
