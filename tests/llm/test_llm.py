"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows,
empty tables and further columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from faultline.llm import ann, chat, decontam, jaccard, langid, packing, sharding, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_ string"


def _texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(30)]
    near = base[3].split() + [word() for _ in range(20)]
    out = [*base, base[3], base[4], " ".join(near), passage, f"{base[5]} {passage}\n{base[6]}", f"{passage}  {base[7]}", "", None, " \t\n", "one", "ONE", "One two", "x " * 500, "é ü\x0bñ " * 20]
    out += [" ".join([*base[9].split()[:k], "zz", *base[9].split()[k:]]) for k in range(3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(_texts())]
    rows += [rows[2], rows[30], (None, "no id here at all", None, None, None, None), (7, "a second text of seven", "en", "s", 1, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def _words(t):
    return (t or "").encode().split()


def test_rendezvous(spark, docs):
    got = sharding.shard_report(docs, 8).collect()
    assert len(got) == docs.count()
    draw = lambda k, s: -1 / math.log(((xxhash.xxh64_intdigest(f"{k}#{s}", seed=42) >> 11) + 0.5) / 2**53)
    slots, texts = defaultdict(list), {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        k = "" if r.doc_id is None else r.doc_id
        assert r.shard == max(range(8), key=lambda s: (draw(k, s), -s)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
        if r.doc_id not in (7, None):
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_report(docs.where("false"), 8).count() == 0
    shares = Counter(r.s for r in spark.range(6000).select(sharding.shard_of(chat.F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).collect())
    assert 0.70 < shares[1] / 6000 < 0.80
    with pytest.raises(ValueError):
        sharding.shard_of(chat.F.col("id"), {0: 0.0})


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (2, 1, None, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (4, 5, 99, 1.0)]
    rows += [(9, i, i - 1 if i > 1 else None, 1.0) for i in range(1, 40)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = defaultdict(list)
    for r in chat.branches(m, 2).collect():
        got[r.tree, r.branch].append((r.depth, r.node))
    assert [n for _, n in sorted(got[1, 1])] == [1, 2, 4] and [n for _, n in sorted(got[1, 2])] == [1, 3, 5]
    assert [n for _, n in sorted(got[9, 1])] == list(range(1, 40)) and got[2, 1] == [(0, 1)] and got[4, 1] == [(0, 5)]
    assert (3, 1) not in got


def test_chat_round_trip(spark):
    odd = ["<turn>user\n</turn>\n", "<\\turn", "<\\\\/turn> \\", None, "", "a\n\nb", "é</turn>\n" * 3, "\\### Assistant: </turn> ok"]
    rows = [(1, i, ("user", "assistant", "a<turn\\b\nc", None)[i % 4], t) for i, t in enumerate(odd)] + [(2, 0, "assistant", "x")] * 2 + [(None, 1, "user", "n")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_report(c).collect()}
    for key in (1, 2, None):
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == key))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[key].n_turns, got[key].turns_sha256) == (len(mine), want)
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_report(c.where("false")).count() == 0


def test_encoder_gives_the_ids_of_the_whole_text():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", "a", " a  b", "Straße über.\nNeue Zeile, l'été don't", "x1 2y <|endoftext|> z", "ñandú\u00a0ÿ ÷× ЖЗ 漢字 🙂 a\u0301b", "\n\nfoo bar\tbaz "):
        assert encoder.ids(text) == encoder.whole(text), text
        assert encoder.ids(text) == encoder.whole(text), text  # from the memos


def test_deep_and_circular_replies(spark):
    deep = [("t", i, i - 1 if i else None, 1.0) for i in range(37)]
    flat = [("f", 0, None, 0.0)] + [("f", i, 0, float(i)) for i in range(1, 50)]
    ring = [("r", 0, 1, 1.0), ("r", 1, 0, 1.0), ("r", 2, 1, 1.0)]
    m = spark.createDataFrame(deep + flat + ring, "tree string, node int, parent int, score double")
    got = sorted((r.tree, r.depth, r.node) for r in chat.branches(m).collect())
    assert got == sorted([("t", i, i) for i in range(37)] + [("f", 0, 0), ("f", 1, 49)])


def test_subset_sums_and_plan():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 90)
        use = packing.closest(counts, room)
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * j for s in sums for j in range(1, n + 1)}
        assert sum(k * n for k, n in use.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in use.items())
    counts = {k: rng.randint(0, 50) for k in range(1, 101)}
    used, fill = Counter(), Counter()
    for k, lo, hi, per, first, at in packing.plan(counts, 100):
        used[k] += hi - lo
        for i in range(hi - lo):
            fill[first + i // per] += k
            assert at + (i % per + 1) * k <= 100
    assert used == Counter({k: n for k, n in counts.items() if n})
    # no packing needs fewer bins than pieces over half a bin, or than the total length
    least = max(sum(n for k, n in counts.items() if k > 50), -(-sum(k * n for k, n in counts.items()) // 100))
    assert len(fill) <= 1.2 * least


def test_packing(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = ["a  b", " lead", "trail ", "tab\t x", "don't we'll", "a \n b", "œuvre naïve, l'été 12,5!", "<|endoftext|> x", "a b", "日本 語", "word\nNext. (x)y_z 3a"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    got, want = defaultdict(list), Counter()
    for r in packing.packing_report(d, capacity=64).collect():
        got[r.sequence_id].append((r.offset, r.length))
        want[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] -= 1
    for r in d.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 64):
            p = ids[s : s + 64]
            want[r.doc_id, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)] += 1
    assert not any(want.values())
    for v in got.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packing_report(d.where("false")).count() == 0


def test_archive(spark):
    rows = [(i, f"http://x/{i}\r\nX: y", h) for i, h in enumerate([None, "", "short", "short", "L" * 1000, "L" * 1000, "L" * 999, "é" * 500, "é" * 500, "é" * 500, "z" * 3_000_000])]
    rows += [(None, None, "no id"), rows[4], (5, "http://x/5", "L" * 1000)]
    got = warc.archive_report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    last = defaultdict(lambda: -1)
    for k, _, h in rows:
        last[h or ""] = max(last[h or ""], -1 if k is None else k)
    want = Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        ref = last[h or ""] if len(raw) >= 1000 and k < last[h or ""] else None
        want[k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if ref is None else "revisit", ref] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_jaccard(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    low = {top(i): min((rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None), default=None) for i in range(len(rows))}
    want = Counter((k, len(sets[i]), low[top(i)]) for i, (k, _) in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(docs).collect())
    assert got == want


def test_one_of_each_keeps_a_row_of_every_component(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    near = a + " more"
    rows = [(None, c), (None, d), (None, d), (5, e), (5, f), (None, a), (9, near), (8, a), (3, b), (3, b), (None, None), (None, ""), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in jaccard.one_of_each(docs).collect())
    assert got == Counter([(None, c), (None, d), (5, e), (5, f), (8, a), (3, b), (None, None), (None, ""), (4, " ")])


def test_count_tree_finds_all_in_reach():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (300, 16)).astype(np.int32)
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, 16)), 0)
    n = points.sum(1)
    tree = jaccard.CountTree(points, n)
    for i in range(0, 300, 7):
        want = {j for j in range(300) if np.minimum(points[i], points[j]).sum() >= jaccard.needed(n[i], n[j], 75) and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j])}
        assert set(tree.search(points[i], int(n[i]), 75).tolist()) == want


def test_substrings(spark, docs):
    rows = [(r.doc_id, _words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for k, w in rows:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[k, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.substring_report(docs).collect()) == want
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns
    assert Counter((r.doc_id, hashlib.sha256(b" ".join(_words(r.text))).hexdigest()) for r in cut.collect()) == Counter({(k[0], k[3]): 0 for k in want}) + sum((Counter({(k[0], k[3]): n}) for k, n in want.items()), Counter())


def test_windows_that_agree_in_40_bits_are_not_repeats(spark):
    # the upper 40 bits of the prints of "k0 x535863" and "k0 x351324" are equal, so are prefix and place
    rows = [(1, "k0 x535863"), (2, "k0 x351324"), (3, "k0 x7 k0 x8"), (4, "a k0 x8")]
    got = substrings.repeats(spark.createDataFrame(rows, "row long, text string"), 2, 1).collect()
    assert sorted(tuple(r) for r in got) == [(3, 2, 1), (4, 1, 1)]


def test_a_run_that_all_texts_share_is_dealt_to_all_groups(spark):
    rng = random.Random(5)
    word = lambda: str(rng.randrange(10**6))
    runs = [[word() for _ in range(12)] for _ in range(300)]
    run = min(runs, key=lambda r: int(substrings.grams(substrings.hashed_plain([" ".join(r).encode()])[0], 12)[0]))
    texts = [[*(word() for _ in range(30)), *run, *(word() for _ in range(30))] for _ in range(400)]
    texts += [[*t[:45], word(), *t[46:]] for t in texts[:20]]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = {(k, i) for k, w in enumerate(texts) for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "row long, text string").repartition(3)
    for heavy in (1, 100, 10**6):
        got = substrings.repeats(frame, heavy=heavy).collect()
        assert {(r.row, i) for r in got for i in range(r.first, r.first + r.n)} == want
    load = [r.n for r in substrings.dealt(frame, heavy=100).groupBy("grp").agg(chat.F.sum(chat.F.octet_length("prints")).alias("n")).collect()]
    assert max(load) < sum(load) / 4  # by the prefix alone one of twelve groups would have nearly all


def test_equal_rows_do_not_lengthen_the_list_of_runs(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text)] * 40, "doc_id long, text string").repartition(4)
    assert max(sum(x.n for x in r.runs) for r in substrings._with_runs(docs, 35, 12).collect()) <= 2 * (120 - 34)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("mnopqrst") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (30, 45, 3)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[0].split()
    edited[15] = "other"
    texts = [noise(80), f"{noise(30)} {items[0].upper()}, {noise(9)}", f"{noise(5)}\n{items[1]}", f"{noise(20)} {' '.join(edited)}", f"a {items[2]} b", "", None, noise(3000) + items[1][:60]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(docs, bench).collect()}
    assert {(1, 0), (2, 1), (4, 2)} <= set(got) and all(got[k] == 1.0 for k in ((1, 0), (2, 1), (4, 2)))
    # one word of 30 changed: 21 of 26 shingles stay, 21 / 31 in all
    assert set(got) == {(1, 0), (2, 1), (4, 2)}
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [0, 3, 5, 6, 7]
    assert decontam.matches(docs, bench.where("false")).count() == 0


def test_simhash_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontam.Items(list(range(20)), [" ".join(f"w{x}" for x in rng.integers(0, 999, 30)).encode() for _ in range(20)], 5)
    for i, h in enumerate(index.hash.tolist()):
        for _ in range(40):
            other = h
            for b in rng.choice(64, decontam.RADIUS, replace=False).tolist():
                other ^= 1 << b
            assert any(i in index.filed[k][other >> (8 * k) & 255] for k in range(8))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[700:740] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0]), (2080, [None] * 16), (None, [1.0] * 16)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 20, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, v in got.items():
        v.sort()
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        hit += len(set(want.tolist()) & {i for _, i, _ in v})
        assert [r for r, _, _ in v] == list(range(1, 21)) and np.allclose([c for _, _, c in v], s[[i for _, i, _ in v]])
    assert hit / 20 / len(got) >= 0.9
    assert [i for _, i, _ in got[0]] == list(range(700, 720))
    assert ann.nearest(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 20, 20).count() == 0


def test_neighbours_with_equal_scores_come_by_id(spark):
    """400 different vectors with the inner product 1 to the queries, and copies of some of them."""
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, *rng.standard_normal(6).tolist()]) for i in range(1, 400)] + [(400 + i, [1.0] + [float(i)] * 6) for i in range(3)]
    rows += [(k, [1.0] + [0.0] * 6) for k in (0, 1000, 1001)]
    got = ann.nearest(spark.createDataFrame(rows, "id long, v array<double>").repartition(5), "id", "v", 1000, 20, ann.Fit(block=50)).collect()
    for q, want in ((0, [*range(1, 21)]), (1000, [*range(0, 20)])):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [v for _, v, _ in mine] == want and all(s == 1.0 for _, _, s in mine)


def test_one_of_each_hands_on_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 777, "x"), (2, "a b c d e f", 778, "y"), (3, None, 779, "z")], "doc_id long, text string, _row long, row string")
    assert sorted(map(tuple, jaccard.one_of_each(docs).collect())) == [(1, "a b c d e f", 777, "x"), (3, None, 779, "z")]


def test_a_chain_of_near_copies_is_one_component_in_any_blocks(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):  # each differs from the one before in two words, so far ones are not linked
        words = [f"v{rng.randrange(10**6)}" if i in (2 * k % 120, (2 * k + 1) % 120) else w for i, w in enumerate(words)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "star_pairs", lambda found: found.select(jaccard.F.lit(0).cast("long").alias("a"), jaccard.F.lit(0).cast("long").alias("b")).where("false"))
    for block, tokens in ((1024, 10**6), (4, 500)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_TOKENS", tokens)
        assert {r.component_id for r in jaccard.joined(docs).collect()} == {0}


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(30)) + (" Vile!" if i % 4 == 0 else "")) for i in range(600)] + [(601, None), (602, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(601, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0 and r.doc_id < 600) for r in got) and len(got) == 602
    assert all(r.predicted in (0, 1) for r in toxicity.toxicity_report(docs, labels.where("false")).collect())


def test_language_held_out(spark):
    rng = random.Random(6)
    alphabet = {"xx": "abcde", "yy": "cdefg", "zz": "éüñab"}
    rows = [(i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(6)) for _ in range(20)), lang) for i in range(240) for lang in [("xx", "yy", "zz")[i % 3]]]
    rows += [(900, None, "xx"), (901, "12 34 !", "yy"), (902, "", None), (903, "日本語", None)]
    got = {r.doc_id: r for r in langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i < 900) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in alphabet and all(0 <= r.score <= 1 for r in got.values())


def test_language_sample_is_the_smallest_keys_with_repeats_as_one(spark):
    rows = [("a", i, f"t{i}") for i in range(-900, 900)] + [("b", 5, t) for t in ("z", "y", "x")] + [("b", 6, "w")]
    got = langid.sampled(spark.createDataFrame(rows, "lang string, o long, text string"), 40).collect()
    assert sorted(map(tuple, got)) == [("a", i, f"t{i}") for i in range(-900, -860)] + [("b", 5, "x"), ("b", 6, "w")]
    assert langid.sampled(spark.createDataFrame([], "lang string, o long, text string"), 40).count() == 0
