"""Exact Jaccard join of documents on sets of word n-grams, with signature trees.

1.  Documents with the same words in the same order (a digest of 128 bits) are one class, named by its smallest id;
    only one row of each class, its head, goes on, under a number of its own (``node``). A set is its distinct
    shingle hashes (64 bits); they find candidates.
2.  Two sets that link share a shingle among the first ``n - ceil(t n) + 1`` of each, in any order common to all.
    The order puts shingles last that were seen to be frequent, so passages that many documents share
    seldom make candidates. Which ones are taken to be frequent bears on speed alone, never on the result.
3.  The heads that share a prefix shingle are its holders, and the smallest node among them is its center. All
    holders of shingles with one center are a block, so two sets that link stand in a block together, and a family that
    shares many shingles stands there once. In each block all are compared with the center first (star
    pairs), which links groups of near copies without their pairs.
4.  Members of blocks that have one of another component and of like size beside them go through signature trees, one for each width of bitmap. A leaf has
    the bitmap of one set, a node the OR of its children's bitmaps, the range of their sizes and the fewest bits of a set
    below it. Two nodes are traversed together; a pair of nodes is left if their sizes cannot match, if both lie in
    one component, or if the greatest possible overlap is too small: a set with ``k`` bits of which at most ``c`` are
    common to both nodes has ``k - c`` shingles or more that the other side lacks.
5.  What both steps leave is verified on the words themselves, read again from the texts.

Blocks beyond ``BLOCK`` members or ``BLOCK_BYTES`` of bitmaps are compared as pairs of chunks, so no task holds an unbounded
group; keys that very many rows share (a class, a shingle, a center) are dealt out by salts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bucketed, discard, hot_keys, salted_join, saved, table
from .rolling import BASE, joined, mix, powers, slices

HOT_TOKENS, HOT_SHARE, HOT_LEAST = 65_536, 0.002, 64
BLOCK, BLOCK_BYTES, LEAF = 4_096, 4 << 20, 64
BUCKET_BYTES, ROW_BYTES = 8 << 20, 64  # of one task's group; of a row beside its bitmap
LONG_WORD = 64  # bytes
FILTER_BITS = 1 << 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time are mixed in, so words of up to eight bytes differ for certain if their
    lengths are equal; of words beyond ``LONG_WORD`` bytes by a cryptographic digest."""
    size = last - first
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    out = mix(size.astype(np.uint64) * _STEP + _STEP)
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        chunk = eight[first[live] + at] & _FIRST_BYTES[np.minimum(size[live] - at, 8)]
        out[live] = mix((out[live] ^ chunk) * np.uint64(BASE) + _STEP)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split and bytes.lower know just the white space and the letters that are meant."""
    return (text or "").encode().lower().split()


def shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k words running, or all words if there are fewer."""
    data, start, end = joined(column, b" ")
    data = _LOWER[data]
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    first = np.flatnonzero(word & ~before)
    last = np.flatnonzero(~word & before)  # each text ends in a gap
    hashes = word_hashes(data, first, last)
    low, high = np.searchsorted(first, start), np.searchsorted(first, end)
    runs = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        runs += hashes[j : j + len(runs)] * powers(BASE, k + 1)[j + 1]
    runs = mix(runs)
    out = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if b - a >= k:
            own = np.sort(runs[a : b - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = (hashes[a:b] * powers(BASE, b - a + 1)[1:]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.array([b - a], np.uint64) * _STEP))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest shingles of a set of ``n`` that another set must share to link with it."""
    return -(-num * n // den)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Bits of a set, in 64-bit words: a power of two of them, four bits or more for each shingle."""
    words = 1 << max(0, (4 * max(1, len(own)) - 1).bit_length() - 6)
    out = np.zeros(words * 8, np.uint8)
    place = own & np.uint64(words * 64 - 1)
    np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return out.view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap, or rows of them, at a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, num: int, den: int) -> bool:
    """Whether bitmaps and sizes allow two sets to link."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    words = min(len(a), len(b))
    a, b = fold(a, words), fold(b, words)
    both = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return (num + den) * both >= num * (na + nb)


class Tree:
    """A signature tree over sets sorted by size; arrays by node, children at 2i + 1 and 2i + 2."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.bits, self.sizes, self.groups = bits, sizes, groups
        self.count = np.bitwise_count(bits).sum(axis=1)
        self.nodes: dict[int, tuple] = {}
        self._build(0, 0, len(sizes))

    def _build(self, at: int, a: int, b: int) -> None:
        own = self.groups[a:b]
        self.nodes[at] = (a, b, np.bitwise_or.reduce(self.bits[a:b], axis=0), int(self.sizes[a]), int(self.sizes[b - 1]), int(self.count[a:b].min()), int(own[0]) if (own == own[0]).all() else None)
        if b - a > LEAF:
            self._build(2 * at + 1, a, (a + b) // 2)
            self._build(2 * at + 2, (a + b) // 2, b)


def traverse(left: Tree, right: Tree, num: int, den: int, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs of places (left, right) that may link and lie in different groups; ``same``: once each, below the diagonal."""
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        a, b, ors, low, high, bits, group = left.nodes[x]
        c, d, ors2, low2, high2, bits2, group2 = right.nodes[y]
        if same and a >= d:
            continue
        if (group is not None and group == group2) or den * high < num * low2 or den * high2 < num * low:
            continue
        common = int(np.bitwise_count(ors & ors2).sum())
        both = min(high - max(0, bits - common), high2 - max(0, bits2 - common))
        if (num + den) * both < num * (low + low2):
            continue
        down, down2 = 2 * x + 1 in left.nodes, 2 * y + 1 in right.nodes
        if down and (not down2 or b - a >= d - c):
            todo += [(2 * x + 1, y), (2 * x + 2, y)]
        elif down2:
            todo += [(x, 2 * y + 1), (x, 2 * y + 2)]
        else:
            n, n2 = left.sizes[a:b, None], right.sizes[None, c:d]
            miss = np.bitwise_count(left.bits[a:b, None] & ~right.bits[None, c:d]).sum(axis=2)
            miss2 = np.bitwise_count(right.bits[None, c:d] & ~left.bits[a:b, None]).sum(axis=2)
            fits = (num + den) * np.minimum(n - miss, n2 - miss2).astype(np.int64) >= num * (n + n2)
            fits &= left.groups[a:b, None] != right.groups[None, c:d]
            if same:
                fits &= np.arange(a, b)[:, None] < np.arange(c, d)[None]
            for i, j in zip(*np.nonzero(fits), strict=True):
                yield a + int(i), c + int(j)


def _hot_counts(k: int):
    """(shingle, documents) of shingles that several documents of one slice have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                sets = shingles(batch.column(0)[a:b], k)
                own, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
                often = n >= max(3, len(sets) // 64)
                yield pa.RecordBatch.from_arrays([pa.array(own[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    return run


def _describe(k: int, num: int, den: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        for batch in batches:
            for a, b in slices(batch.column(2)):
                rows, texts = [], batch.column(2)[a:b]
                for own, text in zip(shingles(texts, k), texts, strict=True):
                    n = len(own)
                    lead = n - least_overlap(n, num, den) + 1 if n else 0
                    prefix = own[:lead]
                    if len(frequent) and n:
                        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        late = frequent[at] == own
                        prefix = np.concatenate([own[~late][:lead], own[late]])[:lead]
                    same = hashlib.blake2b(b" ".join(words_of(text.as_py())), digest_size=16).digest()
                    rows.append((n, same, prefix.view(np.int64), bitmap(own).tobytes() if n else b""))
                cols = list(zip(*rows, strict=True))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[2]])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[2]))), pa.array(cols[3], pa.binary())],
                    ["doc_id", "text_key", "n", "digest", "prefix", "bits"],
                )

    return run


def _screen(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, bits, b, nb, bits2 = (batch.column(i) for i in range(6))
            near = [may_link(np.frombuffer(x.as_py(), np.uint64), n.as_py(), np.frombuffer(y.as_py(), np.uint64), m.as_py(), num, den) for x, n, y, m in zip(bits, na, bits2, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def similarity(left: list[bytes], right: list[bytes], k: int) -> tuple[int, int]:
    """Shingles in both and in either of two lists of words, counted on the words: each gets a number, then each run of words.

    (0, 1) where one list has ``k`` words and the other fewer, or one has none: they share nothing.
    """
    numbers: dict[bytes, int] = {}
    sides = [np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64) for own in (left, right)]
    if min(map(len, sides)) < k:  # a whole text is one shingle, unlike any of k words
        if not left or not right or max(map(len, sides)) >= k:
            return 0, 1
        return (1, 1) if left == right else (0, 2)
    runs = sides
    for j in range(1, k):
        runs = [run[: len(own) - j] * len(numbers) + own[j:] for run, own in zip(runs, sides, strict=True)]
        if j < k - 1:
            _, number = np.unique(np.concatenate(runs), return_inverse=True)
            runs = [number[: len(runs[0])], number[len(runs[0]) :]]
    one, two = map(np.unique, runs)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both, len(one) + len(two) - both


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both, either = similarity(words_of(x.as_py()), words_of(y.as_py()), k)
                keep.append(both > 0 and den * both >= num * either)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _leaf_pairs(block: np.ndarray, sizes: np.ndarray, groups: np.ndarray, raw: list[bytes], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block (rows are in the order of blocks, none larger than a leaf) that may link."""
    one, two = [], []
    for step in range(1, LEAF):
        i = np.flatnonzero(block[step:] == block[:-step])
        if not len(i):
            break
        j = i + step
        fits = (groups[i] != groups[j]) & (den * np.minimum(sizes[i], sizes[j]) >= num * np.maximum(sizes[i], sizes[j]))
        one.append(i[fits])
        two.append(j[fits])
    i, j = np.concatenate([np.empty(0, np.int64), *one]), np.concatenate([np.empty(0, np.int64), *two])
    width = np.array([len(x) for x in raw], np.int64) // 8
    rows = {int(w): (own := np.flatnonzero(width == w), np.frombuffer(b"".join(raw[k] for k in own), np.uint64).reshape(len(own), w)) for w in np.unique(width)}
    good = np.zeros(len(i), bool)
    for w, (own, bits) in rows.items():
        for w2, (own2, bits2) in rows.items():
            at = np.flatnonzero((width[i] == w) & (width[j] == w2))
            for a in range(0, len(at), 1 << 16):
                k = at[a : a + (1 << 16)]
                x, y = bits[np.searchsorted(own, i[k])], bits2[np.searchsorted(own2, j[k])]
                x, y = fold(x, min(w, w2)), fold(y, min(w, w2))
                both = np.minimum(sizes[i[k]] - np.bitwise_count(x & ~y).sum(axis=1), sizes[j[k]] - np.bitwise_count(y & ~x).sum(axis=1))
                good[k] = (num + den) * both.astype(np.int64) >= num * (sizes[i[k]] + sizes[j[k]])
    return i[good], j[good]


def _compare(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        """Candidate pairs of the blocks, and pairs of chunks of large blocks, that were dealt here."""
        group = group.sort_by([(c, "ascending") for c in ("center", "i", "j", "node")])
        ids, sizes, groups, sides, center, ci, cj = (group[c].to_numpy() for c in ("node", "n", "component", "side", "center", "i", "j"))
        raw = group["bits"].to_pylist()
        width = np.array([len(x) for x in raw], np.int64) // 8
        change = np.concatenate([[True], (center[1:] != center[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])])
        lot, starts = np.cumsum(change) - 1, np.flatnonzero(change)
        ends = np.append(starts[1:], len(ids))
        small = ((ends - starts) <= LEAF) & (ci[starts] == cj[starts])
        leaf = np.flatnonzero(small[lot])
        i, j = _leaf_pairs(lot[leaf], sizes[leaf], groups[leaf], [raw[k] for k in leaf], num, den)
        out = [(ids[leaf[i]], ids[leaf[j]])]

        def trees(rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            """By width, in rising order: the rows, smallest sets first, and their bitmaps."""
            rows = rows[np.lexsort((ids[rows], sizes[rows]))]
            parted = {int(w): rows[width[rows] == w] for w in np.unique(width[rows])}
            return {w: (own, np.frombuffer(b"".join(raw[k] for k in own), np.uint64).reshape(len(own), w)) for w, own in parted.items()}

        for a, b in zip(starts[~small], ends[~small], strict=True):
            rows = np.arange(a, b)
            alone = ci[a] == cj[a]
            left, right = trees(rows[sides[a:b] == 0]), trees(rows[sides[a:b] == 1])
            right = left if alone else right
            for w, (own, bits) in left.items():
                for w2, (other, bits2) in right.items():
                    if alone and w2 < w or den * sizes[own[-1]] < num * sizes[other[0]] or den * sizes[other[-1]] < num * sizes[own[0]]:
                        continue
                    narrow = min(w, w2)
                    first = Tree(fold(bits, narrow), sizes[own], groups[own])
                    same = alone and w == w2
                    second = first if same else Tree(fold(bits2, narrow), sizes[other], groups[other])
                    found = np.array(list(traverse(first, second, num, den, same)), np.int64).reshape(-1, 2)
                    out.append((ids[own[found[:, 0]]], ids[other[found[:, 1]]]))
        x, y = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


_ROW_KEY = ["id_key", "text_key"]


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, text`` of ``ids`` (node, id_key, text_key). A bitmap of hashed keys, of fixed size, spares shuffling most other texts."""
    place = F.pmod(F.xxhash64(*_ROW_KEY), F.lit(FILTER_BITS))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    maps = F.broadcast(maps)  # at most FILTER_BITS / 8 bytes
    near = docs.withColumn("p", place).withColumn("bucket", F.bitmap_bucket_number("p")).join(maps, "bucket")
    near = near.filter(F.expr("shiftright(cast(conv(hex(substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(p) % 8 as int)) & 1 = 1"))
    return near.groupBy(*_ROW_KEY).agg(F.first("text").alias("text")).join(ids, _ROW_KEY).select("node", "text")


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that link by the words of their whole texts."""
    pairs = saved(pairs, "ngram-pairs")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = saved(heads.select("node", *_ROW_KEY).join(ids, "node", "left_semi"), "ngram-ids")
    texts = saved(_only(docs, ids), "ngram-texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_verify(k, num, den), "a long, b long")


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their digests, the classes, and their heads with what finds candidates, in buckets of nodes."""
    counts = docs.select("text").mapInArrow(_hot_counts(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n_docs = docs.count()
    often = counts.filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * n_docs)).orderBy(F.desc("n"), "token").limit(HOT_TOKENS).collect()
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["token"] for r in often], np.int64).view(np.uint64)))
    sets = docs.select("doc_id", "text_key", "text").mapInArrow(_describe(k, num, den, frequent), "doc_id long, text_key long, n long, digest binary, prefix array<long>, bits binary")
    sets = saved(sets.withColumn("node", F.monotonically_increasing_id()), "ngram-sets")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key")).alias("first")
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("class_id"), first, F.count("*").alias("copies"))
    classes = saved(classes, "ngram-classes")
    chosen = classes.select("node")
    heads = bucketed(sets.filter("n > 0").drop("digest"), ["node"], n_docs, lambda parted: parted.join(chosen, "node", "left_semi"), "ngram_heads")
    heads = heads.withColumn("id_key", F.coalesce("doc_id", F.lit(-1))).drop("doc_id")
    rows = saved(sets.select("doc_id", "text_key", "n", "digest"), "ngram-rows")
    discard(sets)  # all that is needed of it is written
    return rows, classes, heads


def _sizes(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows by ``keys``, written, and which of the keys are hot."""
    sizes = saved(df.groupBy(*keys).agg(F.count("*").alias("copies")), name)
    return sizes, hot_keys(sizes, keys, sizes.agg(F.sum("copies")).first()[0])


def _links(heads: DataFrame, docs: DataFrame, k: int, num: int, den: int, every: bool) -> DataFrame:
    """Links (a, b) between nodes: all of them with ``every``, else enough to connect all that are linked."""
    members = heads.select("node", "n", F.explode("prefix").alias("token"))
    shared = members.groupBy("token").agg(F.min("node").alias("center"), F.max("node").alias("other"), F.count("*").alias("copies")).filter("center < other")
    shared = saved(shared.drop("other"), "ngram-shared")
    hot = hot_keys(shared, ["token"], shared.agg(F.sum("copies")).first()[0])
    blocks = salted_join(members, shared.select("token", "center"), ["token"], hot, "node").select("center", "node", "n").distinct()
    blocks = saved(blocks, "ngram-blocks")
    links = None
    if not every:
        star = blocks.filter("node > center").select(F.col("center").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b"))
        _, hot = _sizes(star, ["a"], "ngram-centers")

        def side(name: str, *columns: str) -> DataFrame:
            return heads.select(*(F.col(c).alias(f"{c}_{name}") for c in columns)).withColumnRenamed(f"node_{name}", name)

        sized = salted_join(star, side("a", "node", "n"), ["a"], hot, "b").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        signed = salted_join(sized.join(side("b", "node", "bits"), "b"), side("a", "node", "bits"), ["a"], hot, "b")
        near = signed.select("a", "n_a", "bits_a", "b", "n_b", "bits_b").mapInArrow(_screen(num, den), "a long, b long").distinct()
        links = saved(verified(near, heads, docs, k, num, den), "ngram-links")
        blocks = blocks.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        blocks = blocks.withColumn("component", F.col("node"))

    # Sets that link are at most one band apart; the width is a little more than their ratio, for rounding.
    band = F.floor(F.log("n") / (1.0001 * max(math.log(den / num), 1e-6))).cast("int")
    named = saved(blocks.withColumn("band", band), "ngram-named")
    bands = saved(named.groupBy("center", "band").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("copies")), "ngram-bands")
    hot = hot_keys(bands, ["center", "band"], bands.agg(F.sum("copies")).first()[0])
    near = bands.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = near.groupBy("center", "band").agg(F.min("c").alias("c"), F.max("d").alias("d")).filter("c < d").select("center", "band")
    open_rows = saved(salted_join(named, near, ["center", "band"], hot, "node").drop("band"), "ngram-open")
    weight = F.col("n") + ROW_BYTES
    mixed = saved(open_rows.groupBy("center").agg(F.count("*").alias("copies"), F.sum(weight).alias("bytes")), "ngram-sizes")
    chunks = F.greatest(F.ceil(F.col("copies") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    mixed = mixed.withColumn("chunks", chunks)
    whole = mixed.agg(F.coalesce(F.sum(F.col("bytes") * F.col("chunks")), F.lit(0)).alias("bytes"), F.sum("copies").alias("copies")).first()
    hot = hot_keys(mixed, ["center"], whole["copies"])
    open_blocks = salted_join(open_rows, mixed.select("center", "chunks"), ["center"], hot, "node")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spread = open_blocks.withColumn("own", chunk).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("center", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "node", "n", "component")
    bucket = F.pmod(F.xxhash64("center", "i", "j"), F.lit(max(1, -(-whole["bytes"] // BUCKET_BYTES)))).cast("int")
    dealt = spread.join(heads.select("node", "bits"), "node").withColumn("bucket", bucket)
    compared = dealt.groupBy("bucket").applyInArrow(_compare(num, den), "a long, b long").distinct()
    more = saved(verified(compared, heads, docs, k, num, den), "ngram-links")
    return more if links is None else links.unionByName(more)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    id_ = F.col(id_col).cast("long")
    return df.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-1)).alias("id_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def jaccard_components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, class_id, component_id, first`` of every row.

    Two documents link when ``den * intersection >= num * union`` of their distinct ``k``-word shingles; words are runs of
    other bytes than space and tab to carriage return, with A-Z in lower case. A text with fewer words is one shingle;
    a null text or one without words has no shingle, links with nothing and is its own class and component.
    ``class_id`` is the smallest id with the same words, ``component_id`` the smallest id reachable by links (null ids
    count as greatest, and where no document has an id both are null). Rows are told apart by id and text
    (``text_key``, xxhash64 of the text): rows with one id and different texts are different documents. ``first`` is true
    for the row of a component with the smallest id, then text key, and for rows without shingles; repeated rows are
    repeated. Empty tables give no row, and other columns are not read.
    """
    docs = _keyed(df, id_col, text_col)
    rows, classes, heads = _classes(docs, k, num, den)
    final = components(_links(heads, docs, k, num, den, False))
    linked = saved(classes.join(final, "node").select("component", "node", "class_id", "first"), "ngram-linked")
    least = linked.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min("first").alias("leader"), F.count("*").alias("copies"))
    least = saved(least, "ngram-components")
    hot = hot_keys(least, ["component"], least.agg(F.sum("copies")).first()[0])
    led = salted_join(linked.select("component", "node"), least.drop("copies"), ["component"], hot, "node").drop("component")
    told = classes.join(led, "node", "left").select("digest", "copies", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("leader", "first").alias("leader"))
    told = saved(told, "ngram-told")
    hot = hot_keys(told, ["digest"], told.agg(F.sum("copies")).first()[0])
    out = salted_join(rows.filter("n > 0"), told.drop("copies"), ["digest"], hot, "doc_id")
    own = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("text_key"))
    out = out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class_id", "component_id", (own == F.col("leader")).alias("first"))
    none = rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(none)


def jaccard_join(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: all links (``a, b``) between classes, and ``doc_id, text_key, n_shingles, class, n_links`` of every row.

    A class is the documents with the same words, by a number of its own (null without words); copies are not expanded
    into pairs. Links, rows and edge cases are those of ``jaccard_components``, but no pair is left out because it
    lies in one component. A family of n near copies has up to n * n / 2 links, which is the size of this result.
    """
    docs = _keyed(df, id_col, text_col)
    rows, classes, heads = _classes(docs, k, num, den)
    links = saved(_links(heads, docs, k, num, den, True), "ngram-all-links")
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    told = classes.join(ends, "node", "left").select("digest", "copies", F.col("node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    hot = hot_keys(told, ["digest"], told.agg(F.sum("copies")).first()[0])
    out = salted_join(rows.filter("n > 0"), told.drop("copies"), ["digest"], hot, "doc_id").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class", "n_links")
    none = rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.lit(0).cast("long").alias("n_links"))
    return links, out.unionByName(none)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` joined on four-word shingles with a similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w
), classes AS (SELECT sh, min(doc_id) AS class_id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT class_id, n, unnest(sh) AS g FROM classes),
pairs AS (
  SELECT a.class_id AS a, b.class_id AS b FROM t a JOIN t b ON a.g = b.g AND a.class_id < b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT class_id AS a, class_id AS r FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.r = edges.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT classes.sh, x.component_id FROM classes JOIN (SELECT a, min(r) AS component_id FROM reach GROUP BY a) x ON x.a = classes.class_id) c
  ON s.sh = c.sh
"""
