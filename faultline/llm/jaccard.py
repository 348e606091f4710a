"""N-gram Jaccard join with count vectors.

A text is the set of its distinct shingles. The tokens of a set (its shingles, as hashes) are dealt to groups, and the
counts per group are a point: two sets share at most the sum of the coordinate-wise minima of their points. Points are kept
in packed R-trees whose nodes hold the largest count per coordinate and the range of sizes; a search leaves out a node, or a
point, whose summed minima cannot reach the overlap that the similarity asks for. Surviving pairs are verified on whole sets.

One tree over the corpus would be one task and would meet every text with every other, so texts first meet in cells: a cell
is a token, and a text lies in the cells of its `prefix`, the first n - ceil(t n) + 1 of its tokens in one order for all
texts (frequent tokens last). Two sets of similarity t or more always share a cell. Cells with one text go, cells with the
same texts are one. Copies are one text. Then

1. in every cell the texts meet its smallest and its largest one (two stars): a group of near copies, of any size, links up
   in about as many checks as it has members;
2. cells that still hold texts of several components are searched with the R-tree. Cells with the same smallest component
   are one group; a group is cut into blocks, and texts outside the group's largest component are looked up in all of them.
   Survivors are verified in the block's task unless their components are joined there already, so a block yields
   fewer links than it has components. All other pairs are in one component already.

So no cell's pairs are all listed, and no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tables import components, maybe_in, stored
from faultline.llm.words import U64, grams, hashed_plain, lean, mix, owner, pack48, slices, unpack48

WORDS, LEAST = 5, 75
#: A token is frequent if a task's run of SHINGLES tokens has it LOCAL times and the corpus TOTAL times; at most FREQUENT are kept,
#: the most frequent first. This sets the order of tokens only, never a result.
SHINGLES, LOCAL, TOTAL, FREQUENT = 4_000_000, 8, 50, 1 << 18
#: Texts per block of a cell, tokens per group of cells, coordinates of a tree's boxes.
BLOCK, GROUP_TOKENS, BOX = 1024, 1_500_000, 64
#: Tokens per block of a group that is searched with trees.
BLOCK_TOKENS = 1_000_000
LEAF = 16


def sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of every distinct shingle, ordered by both; texts with fewer words have one token for all of them."""
    w, starts = hashed_plain(texts, lower=True)
    own = owner(starts)
    g = grams(w, words)
    n = np.diff(starts)
    for s, e in zip(starts[:-1].tolist(), (starts[1:] - words + 1).tolist(), strict=True):
        if e > s + 1:
            g[s:e].sort()
    inside = own[: len(g)] == own[words - 1 :]
    text, token = own[: len(g)][inside], g[inside]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = []
        for i in short:
            h = U64(n[i])
            for x in w[starts[i] : starts[i + 1]]:
                h = mix(np.array([h], U64) * U64(0x9E3779B97F4A7C15) + x)[0]
            whole.append(h)
        text, token = np.append(text, short), np.append(token, np.array(whole, U64))
        order = np.argsort(text, kind="stable")
        text, token = text[order], token[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    return text[new], token[new]


def prefix_length(n: np.ndarray, least: int) -> np.ndarray:
    return n - -(-least * n // 100) + 1


def needed(a, b, least: int):
    """The overlap from which sets of sizes a and b reach the similarity: 100 i >= least (a + b - i)."""
    return -(-least * (a + b) // (100 + least))


def dims(n: np.ndarray | int):
    """Coordinates of a set of n tokens: the power of two up to n, 16 at least."""
    return 1 << np.clip(np.floor(np.log2(np.maximum(n, 1))), 4, 20).astype(np.int64)


def fold(points: np.ndarray, d: int) -> np.ndarray:
    """Points (last axis) in fewer coordinates, down to d; what falls together adds up."""
    if points.shape[-1] <= d:
        return points
    return points.reshape(*points.shape[:-1], -1, d).sum(-2, dtype=np.int32)


def frequent(texts: DataFrame, words: int) -> np.ndarray:
    """The frequent tokens, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for b in batches:
            for _, t in slices(b.column("text")):
                token = sets(t, words)[1]
                held.append(token)
                size += len(token)
                if size >= SHINGLES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    found = texts.select("text").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    kept = found.where(F.col("n") >= TOTAL).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return kept["token"].to_numpy().view(U64)[::-1].copy() if kept.num_rows else np.empty(0, U64)


def signatures(rows: DataFrame, words: int, least: int, late: np.ndarray) -> DataFrame:
    """row columns, n, cls (hash of the whole set, null for an empty one), prefix (six bytes a token), point (four bits a count)."""
    held = rows.sparkSession.sparkContext.broadcast((np.sort(late), np.argsort(late)))
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", n long, cls long, prefix binary, point binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = held.value
        for b in batches:
            for at, texts in slices(b.column("text")):
                text, token = sets(texts, words)
                n = np.bincount(text, minlength=len(texts))
                ends = np.cumsum(n)
                whole = np.zeros(len(texts), U64)
                np.add.at(whole, text, mix(token ^ U64(0x5851F42D4C957F2D)))
                whole = mix(whole * U64(31) + n.astype(U64)).view(np.int64)
                # frequent tokens go to the end, rarest of them first; only they are sorted anew
                last, slot = np.zeros(len(token), bool), np.empty(0, np.int64)
                if len(often):
                    spot = np.minimum(np.searchsorted(often, token), len(often) - 1)
                    last = often[spot] == token
                    slot = rank[spot[last]]
                order = np.lexsort((slot, text[last])) if len(slot) else slot
                seldom, common = token[~last], token[last][order]
                past = np.cumsum(np.bincount(text[last], minlength=len(texts)))
                prefixes, points = [], []
                for i in range(len(texts)):
                    if not n[i]:
                        prefixes.append(None)
                        points.append(None)
                        continue
                    hi, lo = int(ends[i]), int(ends[i] - n[i])
                    late_hi, late_lo = int(past[i]), int(past[i - 1]) if i else 0
                    mine, want = seldom[lo - late_lo : hi - late_hi], int(prefix_length(n[i], least))
                    if want > len(mine):
                        mine = np.concatenate([mine, common[late_lo : late_lo + want - len(mine)]])
                    prefixes.append(pack48(mine[:want]))
                    d = int(dims(n[i]))
                    points.append(_packed(np.bincount((token[lo:hi] & U64(d - 1)).astype(np.int64), minlength=d)))
                part = b.slice(at, len(texts))
                cols = [part.column(c) for c in keep]
                cols += [pa.array(n, pa.int64()), pa.array(whole, pa.int64(), mask=n == 0), pa.array(prefixes, pa.binary()), pa.array(points, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n", "cls", "prefix", "point"])

    return rows.mapInArrow(lean(sign), schema)


def cells(signed: DataFrame) -> DataFrame:
    """Distinct cells with two texts or more: cell (hash of its members), low and high (smallest and largest member), block, members."""
    tokens = signed.agg(F.sum(F.octet_length("prefix") / 6)).first()[0] or 0
    groups = max(12, int(tokens / GROUP_TOKENS) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, first = np.unique(b.column("cls").to_numpy(), return_index=True)  # copies within a batch once
            blobs = b.column("prefix").to_pylist()
            token = unpack48(b"".join(blobs[i] for i in first))
            who = np.repeat(cls, [len(blobs[i]) // 6 for i in first])
            group = (token % U64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order], prepend=-1))
            out = [(int(group[p[0]]), pack48(token[p] << U64(16)), who[p].astype("<i8").tobytes()) for p in np.split(order, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["grp", "token", "who"])

    def meet(table):
        token = unpack48(b"".join(table["token"].to_pylist()))
        who = np.frombuffer(b"".join(table["who"].to_pylist()), "<i8")
        order = np.lexsort((who, token))
        token, who = token[order], who[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
        token, who = token[new], who[new]
        head = np.flatnonzero(np.diff(token, prepend=token[0] + U64(1)))
        size = np.diff(np.append(head, len(token)))
        many = size > 1
        name = np.add.reduceat(mix(who.view(U64)), head) if len(head) else head.astype(U64)
        name, pick = np.unique(mix(name + size.astype(U64))[many], return_index=True)
        head, size = head[many][pick], size[many][pick]
        out = [
            (n, int(who[h]), int(who[h + s - 1]), k, who[h + k * BLOCK : min(h + (k + 1) * BLOCK, h + s)])
            for n, h, s in zip(name.view(np.int64).tolist(), head.tolist(), size.tolist(), strict=True)
            for k in range(-(-s // BLOCK))
        ]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["cell", "low", "high", "block", "members"])

    dealt = signed.where("cls is not null").select("cls", "prefix").mapInArrow(lean(deal), "grp int, token binary, who binary")
    met = dealt.groupBy("grp").applyInArrow(meet, "cell long, low long, high long, block int, members array<long>")
    return met.dropDuplicates(["cell", "block"])


class CountTree:
    """A packed R-tree over count vectors: points sorted by size and main direction, LEAF to a leaf, LEAF leaves to a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        main = points @ np.sign(points.mean(0) - points[np.argmax(sizes)])
        self.order = np.lexsort((main, np.round(np.log(sizes) * 8)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, low, top = self.points, self.sizes, self.sizes
        while len(high) > LEAF:
            cut = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)
            self.levels.append((high, low, top))

    def search(self, point: np.ndarray, size: int, least: int) -> np.ndarray:
        """Indexes of the points that can reach the similarity with (point, size)."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low, top = (x[at] for x in self.levels[k])
            fits = (np.minimum(high, point).sum(1) >= needed(size, low, least)) & (100 * top >= least * size) & (100 * size >= least * low)
            at = (at[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.levels[k - 1][0] if k else self.points)]
        n = self.sizes[at]
        fits = (np.minimum(self.points[at], point).sum(1) >= needed(size, n, least)) & (100 * n >= least * size) & (100 * size >= least * n)
        return self.order[at[fits]]


def reachable(a: np.ndarray, b: np.ndarray, na: int, nb: int, least: int) -> bool:
    """Whether the summed minima, in the finest coordinates both have, leave the similarity possible."""
    d = min(len(a), len(b))
    return int(np.minimum(fold(a, d), fold(b, d)).sum(dtype=np.int64)) >= needed(na, nb, least)


def _packed(counts: np.ndarray) -> bytes:
    """Four bits a count, the second half of the coordinates in the upper ones; 15 stands for any count from there on."""
    c = np.minimum(counts, 15).astype(np.uint8)
    return (c[: len(c) // 2] | c[len(c) // 2 :] << 4).tobytes()


def _point(blob: bytes) -> np.ndarray:
    """The counts; 15 becomes 255, so that a minimum is never too small (counts stay below 9 as a rule)."""
    b = np.frombuffer(blob, np.uint8)
    c = np.concatenate([b & 15, b >> 4])
    return np.where(c == 15, np.uint8(255), c)


def star_pairs(found: DataFrame) -> DataFrame:
    """(a, b): every member with its cell's smallest and largest one."""
    member = found.select("low", "high", F.explode("members").alias("b"))
    pairs = member.select(F.explode(F.array("low", "high")).alias("a"), "b").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bounded(pairs: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and whole points leave the similarity possible."""
    side = lambda x: points.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {least} * greatest(na, nb)")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("na", "nb", "pa", "pb")), strict=True)
            ok = [reachable(_point(x), _point(y), m, n, least) for m, n, x, y in rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(lean(bound), "a long, b long")


def tree_groups(found: DataFrame, comp: DataFrame) -> DataFrame:
    """grp, cls, root: the texts that the trees search. Cells that hold several components and have the same smallest one are
    one group, so a text stands in a group once, however many of its cells are in it."""
    inside = found.select("cell", F.explode("members").alias("cls")).join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cell", "cls", F.coalesce("root", "cls").alias("root"))
    inside = stored(inside, "cells")
    mixed = inside.groupBy("cell").agg(F.min("root").alias("grp"), F.max("root").alias("y")).where("grp <> y").select("cell", "grp")
    return inside.join(mixed, "cell").select("grp", "cls", "root").distinct()


def tree_blocks(rows: DataFrame, size: str, least_block: int) -> DataFrame:
    """`rows` (grp, cls, root, others) with block, visits and asks: groups cut by class into blocks in which the column `size`
    sums up to about `least_block`.

    Of two texts of different components at least one is outside its group's largest component: those ask, and visit all
    blocks of the group; the others stay in their own.
    """
    sizes = rows.groupBy("grp", "root").agg(F.count("*").alias("k"), F.sum(size).alias("s"))
    main = sizes.groupBy("grp").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.ceil(F.sum("s") / least_block).alias("blocks"))
    placed = rows.join(main, "grp").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("asks", F.col("root") != F.col("main"))
    goes = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    placed = placed.withColumn("block", F.explode(goes)).withColumn("visits", F.col("block") != F.col("own")).drop("main", "blocks", "own")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little to read, much to do: not to be merged
    return placed.repartition(tasks, "grp", "block").sortWithinPartitions("grp", "block")


def by_block(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """done(table, first rows of its blocks) for runs of whole blocks; what a batch has of its last one waits for the next batch."""

    def starting(t):
        new = np.ones(t.num_rows, bool)
        x, y = t["grp"].to_numpy(), t["block"].to_numpy()
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return np.flatnonzero(new)

    held = None
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            t = pa.Table.from_batches([b.slice(at, 2048)])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            last = int(starting(t)[-1])
            if last:
                yield done(t.slice(0, last), starting(t)[:-1])
            held = t.slice(last)
    if held is not None:
        yield done(held, starting(held))


def survivors(points: list[np.ndarray], n: np.ndarray, asks: np.ndarray, visits: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows of the block's own that can reach the similarity with it) for the rows that ask, by trees over the own ones."""
    home, size = np.flatnonzero(~visits), np.array([len(p) for p in points])
    # sets in reach of one another have like sizes, so their points have as many coordinates or twice as many
    for d in np.unique(size).tolist():
        at = home[(size[home] == d) | (size[home] == 2 * d)]
        if not len(at):
            continue
        fine = np.stack([fold(points[i], d) for i in at])
        tree = CountTree(fold(fine, BOX).astype(np.int32), n[at])
        for me in np.flatnonzero(asks & ((size == d) | (size == 2 * d))).tolist():
            mine = fold(points[me], d)
            hit = tree.search(fold(mine, BOX), int(n[me]), least)
            # two points of 2 d coordinates are compared in those
            hit = hit[(size[me] == d) | (size[at[hit]] == d)]
            hit = hit[np.minimum(fine[hit], mine).sum(1, dtype=np.int64) >= needed(int(n[me]), n[at[hit]], least)]
            if len(hit):
                yield me, at[hit]


class Forest(dict):
    """Union-find over component labels."""

    def top(self, x: int) -> int:
        while self.get(x, x) != x:
            self[x] = self.get(self[x], self[x])
            x = self[x]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def overlaps(tokens: np.ndarray, pool: np.ndarray, own: np.ndarray, many: int) -> np.ndarray:
    """How many of `tokens` each of `many` sets has, from all their tokens in order (`pool`) and their owners."""
    lo, hi = np.searchsorted(pool, tokens), np.searchsorted(pool, tokens, side="right")
    hit = hi > lo
    lo, k = lo[hit], (hi - lo)[hit]
    ends = np.cumsum(k)
    at = np.repeat(lo - (ends - k), k) + np.arange(ends[-1] if len(ends) else 0)
    return np.bincount(own[at], minlength=many)


def pairs_in_reach(groups: DataFrame, points: DataFrame, least: int) -> DataFrame:
    """Those rows of `groups` that can reach the similarity with one of another component in their group, by their points
    (repeated, if they do so in several blocks)."""

    def leaf(root, n, blobs):
        """The same for a group that is one leaf: sizes first, then whole points."""
        found = np.zeros(len(n), bool)
        order = np.argsort(n, kind="stable").tolist()
        for k, i in enumerate(order):
            for j in order[k + 1 :]:
                if 100 * n[i] < least * n[j]:
                    break
                if root[i] != root[j] and not (found[i] and found[j]) and reachable(_point(blobs[i]), _point(blobs[j]), int(n[i]), int(n[j]), least):
                    found[i] = found[j] = True
        return found

    def search(t, head):
        root, n, asks, visits = (t[c].to_numpy() for c in ("root", "n", "asks", "visits"))
        blobs, found = t["point"].to_pylist(), np.zeros(t.num_rows, bool)
        for s, e in zip(head.tolist(), np.append(head[1:], t.num_rows).tolist(), strict=True):
            if e - s <= LEAF and not visits[s:e].any():
                found[s:e] = leaf(root[s:e], n[s:e], blobs[s:e])
                continue
            for me, hit in survivors([_point(p) for p in blobs[s:e]], n[s:e], asks[s:e], visits[s:e], least):
                hit = s + hit[root[s + hit] != root[s + me]]
                found[hit] = True
                found[s + me] |= len(hit) > 0
        return pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in ("grp", "cls", "root")], ["grp", "cls", "root"]).filter(pa.array(found))

    rows = tree_blocks(groups.join(points, "cls").withColumn("one", F.lit(1)), "one", BLOCK)
    return rows.mapInArrow(lean(lambda batches: by_block(batches, search)), "grp long, cls long, root long")


def block_links(cls: np.ndarray, root: np.ndarray, visits: np.ndarray, asks: np.ndarray, sets_: list[np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """(a, b, overlap) of one block: links that join its components, at most one fewer than there are components.

    Survivors that are joined already are left out, the others are verified on whole sets.
    """
    n = np.array([len(t) for t in sets_])
    home = np.flatnonzero(~visits)
    if not len(home) or not asks.any():
        return []
    flat = np.concatenate([sets_[i] for i in home])
    order = np.argsort(flat, kind="stable")
    pool, own = flat[order], np.repeat(np.arange(len(home)), n[home])[order]
    place = np.cumsum(~visits) - 1  # of a row among the block's own
    points = [np.bincount((t & U64(d - 1)).astype(np.int64), minlength=d).astype(np.int32) for t, d in zip(sets_, dims(n).tolist(), strict=True)]
    forest, label, out = Forest(), root.tolist(), []
    for me, hit in survivors(points, n, asks, visits, least):
        top = forest.top(label[me])
        hit = [h for h in hit.tolist() if forest.top(label[h]) != top]
        if len(hit) > 8:
            i = overlaps(sets_[me], pool, own, len(home))[place[hit]].tolist()
        else:
            i = [len(np.intersect1d(sets_[me], sets_[h], assume_unique=True)) for h in hit]
        for h, k in zip(hit, i, strict=True):
            if k >= needed(int(n[me]), int(n[h]), least) and forest.unite(label[me], label[h]):
                out.append((int(cls[me]), int(cls[h]), k))
    return out


def tree_links(groups: DataFrame, whole: DataFrame, least: int) -> DataFrame:
    """(a, b, i): verified links that join the components of every group as all its links would; a block at a time."""

    def verify(t, head):
        c = {k: t[k].to_numpy() for k in ("cls", "root", "visits", "asks")}
        sets_, out = [unpack48(x) for x in t["tokens"].to_pylist()], []
        for s, e in zip(head.tolist(), np.append(head[1:], t.num_rows).tolist(), strict=True):
            out += block_links(c["cls"][s:e], c["root"][s:e], c["visits"][s:e], c["asks"][s:e], sets_[s:e], least)
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["a", "b", "i"])

    rows = tree_blocks(groups.join(whole, "cls").withColumn("n", F.octet_length("tokens") / 6), "n", BLOCK_TOKENS)
    return rows.mapInArrow(lean(lambda batches: by_block(batches, verify)), "a long, b long, i long")


def verified(pairs: DataFrame, whole: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets in `whole` (cls, tokens) reach the similarity, with the exact overlap i.

    b's set travels to its pair, a's set once for all pairs of a block of them, and tasks go through them in that order.
    """
    own = Window.partitionBy("a").orderBy("b")
    pairs = pairs.withColumn("part", F.floor(F.row_number().over(own) / 256))
    members = pairs.join(whole.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "tokens")
    heads = pairs.select("a", "part").distinct().join(whole.withColumnRenamed("cls", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "tokens")
    ordered = heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            out = []
            for a, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "tokens")), strict=True):
                mine = unpack48(tokens)
                if b is None:
                    head = mine
                    continue
                i = len(np.intersect1d(head, mine, assume_unique=True))
                if 100 * i >= least * (len(head) + len(mine) - i):
                    out.append((a, b, i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "i"])

    return ordered.mapInArrow(lean(check), "a long, b long, i long")


def whole_sets(rows: DataFrame, signed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) of the classes in `wanted`, from the texts of `rows` (row, text) again: only candidates are kept whole."""
    picked = signed.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("row").alias("row"))
    texts = maybe_in(rows.select("row", "text"), "row", picked.select("row")).join(picked, "row")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in slices(b.column("text")):
                text, token = sets(t, words)
                ends = np.searchsorted(text, np.arange(len(t) + 1))
                blobs = [pack48(token[ends[i] : ends[i + 1]]) for i in range(len(t))]
                yield pa.RecordBatch.from_arrays([b.column("cls").slice(at, len(t)), pa.array(blobs, pa.binary())], ["cls", "tokens"])

    return texts.select("cls", "text").mapInArrow(lean(take), "cls long, tokens binary").dropDuplicates(["cls"])


def linked(rows: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(signatures, components) of `rows` (row: a long that names a text, others, text).

    signatures: the other columns, row, n, cls; equal sets share a class, empty sets have none. components: node and root,
    classes that links reach from one another; classes without a link are not listed.
    """
    late = frequent(rows, words)
    signed = stored(signatures(rows, words, least, late), "signatures")
    full = signed.where("cls is not null")
    found = stored(cells(full), "found")
    member = found.select(F.explode("members").alias("cls")).distinct()
    points = stored(full.select("cls", "n", "point").join(member, "cls", "left_semi").dropDuplicates(["cls"]), "points")
    stars = star_pairs(found)
    first = stored(bounded(stars, points, least), "stars")
    ends = lambda p: p.select(F.col("a").alias("cls")).union(p.select(F.col("b").alias("cls"))).distinct()
    links = stored(verified(first, whole_sets(rows, full.select("cls", "row"), ends(first), words), least), "links")
    groups = stored(tree_groups(found, components(links)), "groups")
    groups = stored(pairs_in_reach(groups, points, least).distinct(), "reach")
    more = stored(tree_links(groups, whole_sets(rows, full.select("cls", "row"), groups.select("cls").distinct(), words), least), "links")
    return signed.drop("prefix", "point"), components(links.select("a", "b").union(more.select("a", "b")))


def _labelled(docs: DataFrame, words: int, least: int) -> DataFrame:
    """doc_id, row, n, label for every row of `docs` (doc_id, text): rows of one component, and no others, share a label
    (a class); texts with an empty set have none."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    signed, comp = linked(rows, words, least)
    label = signed.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("root", "cls"))
    return label.select("doc_id", "row", "n", "label")


def joined(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, row, n_shingles, component_id for every row of `docs` (doc_id, text): the smallest doc_id of the row's
    component, null doc_ids left out; its own where nothing is linked. Rows are lower-cased in A-Z only; null texts and
    texts without words have an empty set and link with nothing, equal sets of other texts are linked."""
    label = _labelled(docs, words, least)
    low = label.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("low"))
    return label.join(low, "label", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The rows of `docs`, one of each group of linked documents: that with the smallest doc_id (of its equal rows, one).

    Texts with an empty set all stay; of a group without any doc_id one row stays. A group is a component, not its doc_id:
    unlinked texts stay even if they share a doc_id or have none. Other columns may have any names and are handed on.
    """
    out = _labelled(docs, words, least)
    q = lambda c: F.col(f"`{c}`")
    keyed = docs.select(F.struct(*[q(c) for c in docs.columns]).alias("rec"), F.xxhash64("doc_id", "text").alias("row"))
    free = out.where("label is null").select("row").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = out.where("label is not null").groupBy("label").agg(first.alias("first")).select(F.col("first.row").alias("row")).distinct()
    chosen = keyed.join(kept, "row", "left_semi").dropDuplicates(["row"])
    return chosen.union(keyed.join(free, "row", "left_semi")).select(*[F.col(f"rec.`{c}`").alias(c) for c in docs.columns])
