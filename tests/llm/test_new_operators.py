"""Line dedup, importance resampling and whitening against brute force: nulls, empty and long texts, ties, repeated rows, empty
tables and further columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import linededup, resampling, whitening

BLANKS = " \t\n\x0b\x0c\r"


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _line_texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefÉß") for _ in range(6))
    shared = [" ".join(word() for _ in range(4)) for _ in range(6)]
    out = []
    for k in range(60):
        lines = [rng.choice(["", "short", "\t " + rng.choice(shared).upper() + " \r", rng.choice(shared), word() * 3]) for _ in range(rng.randint(1, 12))]
        out.append("\n".join(lines))
    out += [None, "", "\n", "\n\n", "exactly 10", "EXACTLY 10", "only nine", "only nine", "É" * 10, "é" * 10, "\x0b" + shared[0] + "\xa0", "\n".join([shared[1]] * 4000 + ["own line here"]), "x" * 200_000]
    return out


def _lines_by_force(rows, least_docs=2):
    held = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            key = _lower(line.strip(BLANKS))
            if len(key) >= 10:
                held[key].add((k is None, k or 0, k))
    want = Counter()
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[_lower(x.strip(BLANKS))]) < least_docs or min(held[_lower(x.strip(BLANKS))])[2] == k]
        want[k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return want


def test_lines(spark, monkeypatch):
    rows = list(enumerate(_line_texts()))
    rows += [rows[3], rows[3], rows[5], (None, rows[4][1]), (None, "no id at all, twice"), (None, "no id at all, twice"), (9, "a second text of nine\n" + (rows[9][1] or ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lambda: Counter(tuple(r) for r in linededup.line_report(docs).collect())
    assert got() == _lines_by_force(rows)
    monkeypatch.setattr(linededup, "COMMON", 2)  # most keys now meet their lines in the shuffle
    assert got() == _lines_by_force(rows)


def test_lines_keep_other_columns(spark):
    rows = [(1, "a shared line\nown", "x", 5), (2, "a shared line\nelse", None, 6), (3, None, "z", 7)]
    docs = spark.createDataFrame(rows, "id long, body string, `doc` string, `ka.x` long").withColumnRenamed("ka.x", "ra")
    out = linededup.without_shared_lines(docs, doc="id", text="body")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a shared line\nown", "x", 5), (2, "else", None, 6), (3, None, "z", 7)]
    assert linededup.without_shared_lines(docs, least_docs=3, doc="id", text="body").collect() == docs.collect()
    assert linededup.without_shared_lines(docs.where("false"), doc="id", text="body").count() == 0
    assert linededup.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_run_without_python_workers(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = linededup.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("size", [0, 1, 3, 255, 256, 257, 512, 513, 5000, 70_001])
def test_crc_matrix(size):
    rng = random.Random(size)
    features = [rng.randbytes(size) for _ in range(3)] + [b"", b"a", b"ab", b"b" * 300]
    assert resampling.crc_matrix(features).tolist() == [zlib.crc32(f) for f in features]
    assert resampling.crc_matrix([]).tolist() == []


def _resampling_by_force(rows, items, longest=1, buckets=10_000, least=20, percent=10):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(at(f) for _, t in rows for f in features(t)[0])
    t = Counter(at(f) for x in items for f in features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for k, x in rows:
        f, words = features(x)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(y)) for y in f)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


def _resampling_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgXé7") for _ in range(rng.randint(1, 3)))
    rows = [(i, rng.choice([" ", ".", "_-"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "\x00 \x7f !"), (403, "日本語" * 400 + " " + "z" * 100_000), (404, "Ab " * 5000), (405, "ab " * 19), (406, "ab " * 20), (-3, "Ab " * 20)]
    return rows, [rows[5][1], "ab ab cd 日本語", None, ""]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, longest):
    rows, items = _resampling_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("weight", linededup.F.lit("x"))
    target = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    got = resampling.ranked_draw(resampling.weighted(docs, target, longest=longest)).select("doc", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == _resampling_by_force(rows, items, longest)
    if longest == 1:
        assert Counter(map(tuple, resampling.resampling_report(docs, target).collect())) == _resampling_by_force(rows, items)


def test_resampling_of_repeats_and_of_nothing(spark):
    rows, items = _resampling_rows()
    rows = rows + [rows[7]] * 40 + [(None, rows[8][1])] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, able int").repartition(5)
    target = spark.createDataFrame([(x,) for x in items], "text string")
    got = resampling.resampling_report(docs, target).collect()
    want = _resampling_by_force(rows, items)
    assert Counter(map(tuple, got)) == want
    kept = resampling.resampled(docs, target)
    assert kept.columns == docs.columns
    drawn = {k[0] for k in want if k[4] is not None}
    assert {r.doc_id for r in kept.collect()} == drawn
    assert resampling.resampling_report(docs.where("false"), target).count() == 0
    some = resampling.resampling_report(docs, target.where("false")).collect()
    assert Counter(map(tuple, some)) == _resampling_by_force(rows, [])


def _vectors():
    rng = np.random.default_rng(11)
    base = rng.standard_normal((700, 12)) * np.linspace(1, 3, 12) + np.arange(12)
    base[300:500] = base[0]
    base[5], base[6, 3] = base[5] * -40, -250.25
    return base


BAD = [(7000, None), (7001, [0.5] * 11 + [None]), (7002, [float("nan")] * 12), (7003, [float("inf")] + [0.0] * 11), (7004, []), (7005, [1.0] * 11)]


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for z in (rng.integers(-700, 700, (130, 5)), rng.integers(-(1 << 62), 1 << 62, (70, 4)), np.full((3, 2), -9), rng.integers(0, 2, (1, 6)), np.array([[whitening.MOST, -whitening.MOST]] * 3)):
        one = [[1, *r] for r in z.tolist()]
        want = [[sum(r[i] * r[j] for r in one) for j in range(i, len(one[0]))] for i in range(len(one[0]))]
        assert whitening.scatter(z.astype(np.int64)) == want
    for v in (0, 1, -1, 1 << 200, -(1 << 200) + 7, (1 << 32) - 1, -(1 << 32)):
        assert sum(x << (32 * k) for k, x in enumerate(whitening._limbs(v))) == v


@pytest.mark.parametrize("kind", ["double", "float"])
def test_whitening(spark, kind):
    base = _vectors().astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + BAD + [(None, [float(c) for c in base[1]]), (2, [float(c) for c in base[2]])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding array<{kind}>, component int").repartition(5)
    got = whitening.whitening_report(frame).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in [*base.tolist(), base[1].tolist(), base[2].tolist()]]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    scatter = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(12)] for i in range(12)]
    v = np.array([[c / n**3 for c in r] for r in scatter])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    want = (np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]) / n) @ q / np.sqrt(e)
    far = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    sign = {}
    keys = {**{i: i for i in range(700)}, None: 700}
    for r in got:
        k = keys[r.vec_id]
        assert r.deviation == far[k] and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9 and 0 <= r.identity_error < 1e-6
        w = want[k, r.component - 1]
        s = sign.setdefault(r.component, 1 if abs(r.whitened - w) < abs(r.whitened + w) else -1) if abs(w) > 0.1 else sign.get(r.component, 0)
        assert abs(r.whitened - s * w) < 1e-6 * max(1, abs(w)) if s else True
    assert Counter(r.vec_id for r in got)[2] == 16


def test_whitening_without_variance_and_of_nothing(spark):
    report = lambda rows: whitening.whitening_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert report([]) == [] and report(BAD[:5]) == []
    one = report([(1, [0.25, 0.5])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = sorted((r.vec_id, r.component, r.whitened is None) for r in report([(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 3.0])]))
    assert flat == [(k, c, c > 1) for k in (1, 2) for c in (1, 2, 3)]
    far = report([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])
    assert len(far) == 6 and all(r.deviation is None or r.vec_id == 3 for r in far)
