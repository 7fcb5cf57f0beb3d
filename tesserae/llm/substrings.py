"""Removal of byte strings that also start in a document with a smaller id, by a distributed, hash-compared suffix sort.

Every string of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes; a gram with the least hash among
them is an anchor, and equal strings have the same anchors. So only the suffixes at anchors (about one position
in 16) are compared, each with its context: the bytes before and behind it that such a string can reach.

1.  Blocks of documents give (anchor hash, context hash, smallest id), once for each context. Grouped by anchor,
    those of an anchor with a single row go.
2.  Where documents with an equal context exist in another block or in this, all but the smallest id lose the whole
    context. Where one anchor has several contexts, one of each goes on with its bytes.
3.  Those contexts are sorted by the suffix that starts at the anchor: a merge sort that compares two suffixes by the
    length of their common extension, found by a binary search on prefix polynomial hashes. Neighbours in that order
    are verified byte by byte, and a hash collision makes the bucket be sorted by its bytes instead. The common extensions
    of neighbours cut the order into runs for each length; with the bytes before the anchor, hashed and
    verified likewise, the runs tell for each of the strings around the anchor the smallest id that has it.
4.  Blocks apply the outcome to their texts.

Blocks, anchors and buckets are as many as the input needs at a fixed size of each. Texts are dealt out twice, hashes once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .rolling import between, joined, mix, prefixes, slices

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # the farthest that a string begins before its anchor
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` over each ``w`` neighbours."""
    n = 1
    while n * 2 <= w:
        a = f(a[:-n], a[n:])
        n *= 2
    return f(a[: len(a) - (w - n)], a[w - n :]) if n < w else a


class Anchors:
    """The anchors of a slice of texts: places, documents, contexts (from, to) and the two hashes."""

    def __init__(self, column: pa.Array, bits: int):
        self.data, self.start, self.end = joined(column)
        p = prefixes(self.data)
        count = len(self.data) - GRAM + 1
        empty = np.empty(0, np.int64)
        self.place = self.doc = self.low = self.high = empty
        self.a = self.f = np.empty(0, np.uint64)
        if count < REACH + 1:
            return
        here = np.arange(count)
        h = mix(between(p, here, here + GRAM))
        least = _slide(h, REACH + 1, np.minimum)  # of the grams of the string that starts here
        doc = np.repeat(np.arange(len(self.start)), self.end - self.start)
        inside = doc[: len(least)] == doc[LENGTH - 1 : LENGTH - 1 + len(least)]
        # A gram is an anchor if some string that lies in one document, and holds it, has it as its least.
        pad = np.zeros(REACH, np.uint64)
        top = _slide(np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad]), REACH + 1, np.maximum)
        self.place = np.flatnonzero(top == h)
        self.place = self.place[doc[self.place] == doc[self.place + GRAM - 1]]
        self.doc = doc[self.place]
        own = self.end[self.doc] - self.start[self.doc] >= LENGTH
        self.place, self.doc = self.place[own], self.doc[own]
        self.low = np.maximum(self.start[self.doc], self.place - REACH)
        self.high = np.minimum(self.end[self.doc], self.place + LENGTH)
        self.a = h[self.place] >> np.uint64(64 - bits)
        shape = ((self.place - self.low) * 64 + (self.high - self.place)).astype(np.uint64)
        self.f = mix(between(p, self.low, self.high) + shape * np.uint64(0xD6E8FEB86659FD93))


def _smallest(f: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``f`` in order, the smallest id of each and the row where that stands."""
    order = np.lexsort((ids, f))
    first = np.concatenate([[True], f[order][1:] != f[order][:-1]]) if len(order) else np.empty(0, bool)
    rows = order[first]
    return f[rows], ids[rows], rows


def _scan(table_: pa.Table, bits: int):
    """Slices of a block: ids of documents and their anchors."""
    whole = table_.select(["doc_id", "text"]).combine_chunks()
    ids, texts = whole["doc_id"].to_numpy(), whole["text"].combine_chunks() if whole.num_rows else pa.array([], pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for a, b in slices(texts):
        yield ids[a:b], Anchors(texts[a:b], bits)


def _hashes(bits: int):
    def run(block: pa.Table) -> pa.Table:
        got = [(x.a, x.f, ids[x.doc]) for ids, x in _scan(block, bits)]
        a, f, ids = (np.concatenate([g[i] for g in got]) for i in range(3))
        rows = np.sort(_smallest(f, ids)[2])  # in the order of documents, which packs better
        return pa.table({"f": f[rows].view(np.int64), "a": a[rows].view(np.int64), "doc": ids[rows]})

    return run


def _contexts(bits: int):
    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        """Of each context that is asked for, its bytes: those before the anchor, and those from it on."""
        want, out = np.sort(asked["f"].to_numpy()), []
        if len(want):
            for ids, x in _scan(block, bits):
                f = x.f.view(np.int64)
                at = np.minimum(np.searchsorted(want, f), len(want) - 1)
                for i in np.flatnonzero(want[at] == f):
                    out.append((f[i], x.a[i].astype(np.int64), ids[x.doc[i]], x.data[x.low[i] : x.place[i]].tobytes(), x.data[x.place[i] : x.high[i]].tobytes()))
        if out:
            f, a, ids, left, right = zip(*out, strict=True)
            keep = _smallest(np.array(f), np.array(ids))[2]
            out = [out[i] for i in keep]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["f", "a", "doc", "before", "from"])

    return run


class Suffixes:
    """Strings of at most ``LENGTH`` bytes in one array, compared by prefix hashes."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.p = prefixes(self.data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The lengths of common prefixes of the strings ``i`` and ``j``, by binary search on hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.start[i], self.start[j]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = between(self.p, a, a + mid) == between(self.p, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string ``i`` comes before ``j``; of equal ones the smaller number."""
        n = self.extension(i, j)
        ended, ended2 = n == self.size[i], n == self.size[j]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + n, last)], self.data[np.minimum(self.start[j] + n, last)]
        return np.where(ended & ended2, i < j, np.where(ended | ended2, ended, x < y))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Merge sort within each group, from the bottom: places in a merged run are found by binary search in the other."""
        n, width = len(self.size), 1
        order = np.argsort(group, kind="stable")
        begins = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        first = np.flatnonzero(begins)
        lot = np.cumsum(begins) - 1
        start, end = first[lot], np.append(first, n)[1:][lot]
        at = np.arange(n)
        live = at[end - start > 1]
        while len(live):
            base = start[live] + (live - start[live]) // (2 * width) * (2 * width)
            middle, stop = np.minimum(base + width, end[live]), np.minimum(base + 2 * width, end[live])
            left = live < middle
            other = np.where(left, middle, base)
            low, high = other.copy(), np.where(left, stop, middle)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) >> 1
                less = self.before(order[mid], order[live[open_]])
                low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
            merged = order.copy()
            merged[np.where(left, live, live - (middle - base)) + low - other] = order[live]
            order, width = merged, width * 2
            live = live[end[live] - start[live] > width]
        return order

    def verified(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order in each group, checked by bytes, with the common extension of each string and the one before it."""
        rows = np.zeros((len(order), LENGTH), np.int16)
        column = np.arange(LENGTH)
        inside = column < self.size[:, None]
        rows[inside] = self.data + np.int16(1) if len(self.data) else 0

        def shared(order: np.ndarray) -> np.ndarray:
            differ = rows[order[1:]] != rows[order[:-1]]
            n = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
            return np.concatenate([[0], np.minimum(n, np.minimum(self.size[order[1:]], self.size[order[:-1]]))])

        got = shared(order)
        rises = rows[order[1:]], rows[order[:-1]]
        at = np.minimum(got[1:], LENGTH - 1)[:, None]
        up, down = np.take_along_axis(rises[0], at, 1)[:, 0], np.take_along_axis(rises[1], at, 1)[:, 0]
        if ((up < down) & (group[order[1:]] == group[order[:-1]])).any():  # a collision of hashes: by bytes instead
            order = np.lexsort(rows.T[::-1])
            got = shared(order)
        return order, got


def smallest_owner(before: list[bytes], behind: list[bytes], ids: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """For each context the strings (bit j: beginning j bytes before the anchor) that a smaller id also has.

    Only contexts with one of ``anchors`` in common can share a string, so each anchor's suffixes are sorted by themselves.
    """
    suffixes = Suffixes(behind)
    order, common = suffixes.verified(suffixes.sort(anchors), anchors)
    ids, left = ids[order], [before[i] for i in order]
    lead, tail = np.array([len(x) for x in left], np.int64), suffixes.size[order]
    flat = np.frombuffer(b"".join(left), np.uint8)
    ends = np.cumsum(lead)
    p = prefixes(flat)
    mask = np.zeros(len(ids), np.int64)
    for j in range(REACH + 1):
        fits = np.flatnonzero((lead >= j) & (tail >= LENGTH - j))
        if len(fits) < 2:
            continue
        run = np.cumsum(common < LENGTH - j)[fits]
        key = mix(between(p, ends[fits] - j, ends[fits]) + mix(run.astype(np.uint64)))
        own = np.lexsort((ids[fits], key))
        first = np.concatenate([[True], key[own][1:] != key[own][:-1]])
        lowest = own[first][np.cumsum(first) - 1]
        mine, his = fits[own], fits[lowest]
        same = run[own] == run[lowest]
        for x in range(1, j + 1):
            same &= flat[ends[mine] - x] == flat[ends[his] - x]
        if not same.all():  # a collision of hashes: by bytes instead
            owner: dict[tuple, int] = {}
            for i, r in zip(fits, run, strict=True):
                k = (int(r), left[i][len(left[i]) - j :])
                owner[k] = min(owner.get(k, int(ids[i])), int(ids[i]))
            has = np.array([owner[int(r), left[i][len(left[i]) - j :]] < ids[i] for i, r in zip(fits, run, strict=True)])
            mask[fits[has]] |= 1 << j
        else:
            mask[mine[ids[his] < ids[mine]]] |= 1 << j
    out = np.empty(len(ids), np.int64)
    out[order] = mask
    return out


def _sorted_bucket(bucket: pa.Table) -> pa.Table:
    ids, f = bucket["doc"].to_numpy(), bucket["f"].to_numpy()
    mask = smallest_owner(bucket["before"].to_pylist(), bucket["from"].to_pylist(), ids, bucket["a"].to_numpy())
    own = mask != 0
    return pa.table({"f": f[own], "doc": ids[own], "mask": mask[own]})


def _removed(bits: int, keep_text: bool):
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        """Bytes of each document that lie in strings of smaller ids, from what is ``found`` of its contexts."""
        f, lowest, mask = (found[c].to_numpy() for c in ("f", "doc", "mask"))
        order = np.argsort(f, kind="stable")
        f, lowest, mask = f[order], lowest[order], mask[order]
        scans = list(_scan(block, bits))
        own_f, own_min = [x.f.view(np.int64) for _, x in scans], [ids[x.doc] for ids, x in scans]
        own_f, own_min, _ = _smallest(np.concatenate([np.empty(0, np.int64), *own_f]), np.concatenate([np.empty(0, np.int64), *own_min]))
        rows = []
        for ids, x in scans:
            cover = np.zeros(len(x.data) + 1, np.int32)
            if len(x.place):
                mine, here = x.f.view(np.int64), ids[x.doc]
                least = own_min[np.searchsorted(own_f, mine)]
                some = np.zeros(len(mine), np.int64)
                if len(f):
                    at = np.searchsorted(f, mine)
                    for step in (0, 1):  # a smaller id from another block, and strings found one by one
                        k = np.minimum(at + step, len(f) - 1)
                        hit = f[k] == mine
                        least = np.where(hit & (mask[k] == 0), np.minimum(least, lowest[k]), least)
                        some = np.where(hit & (mask[k] != 0) & (lowest[k] == here), mask[k], some)
                whole = here > least
                np.add.at(cover, x.low[whole], 1)
                np.add.at(cover, x.high[whole], -1)
                part = np.flatnonzero(~whole & (some != 0))
                for j in range(REACH + 1):
                    begin = x.place[part[(some[part] >> j) & 1 == 1]] - j
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for i, (a, b) in enumerate(zip(x.start.tolist(), x.end.tolist(), strict=True)):
                cut = gone[a:b]
                kept = x.data[a:b][~cut].tobytes()
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                rows.append((ids[i], b - a, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every whole text.

    Bytes covered by a 50-byte string that also starts in a document with a smaller id are removed; strings are judged on
    the input, matches never cross documents. ``kept`` is the rest as text (bytes of a cut character become
    U+FFFD), or null without ``keep_text``. A null text counts as empty, shorter texts lose nothing, rows with one id don't
    count against each other, a null id counts as the smallest long; an empty table gives no row; other columns are not read.
    """
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    docs = df.select(id_.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks, n_buckets = (max(1, -(-total // x)) for x in (BLOCK_BYTES, BUCKET_BYTES))
    bits = min(64, max(32, 2 * max(1, total).bit_length() - 18))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    dealt = docs.withColumn("block", block("doc_id")).groupBy("block")
    hashes = dealt.applyInArrow(_hashes(bits), "f long, a long, doc long")
    by_anchor = Window.partitionBy("a")
    several = hashes.withColumn("n", F.count("*").over(by_anchor)).withColumn("mixed", F.min("f").over(by_anchor) != F.max("f").over(by_anchor)).filter("n > 1")
    lowest = several.withColumn("lowest", F.min("doc").over(Window.partitionBy("a", "f")))
    useful = (F.col("lowest") < F.col("doc")) | F.col("mixed")
    contexts = saved(lowest.filter(useful).select("f", "doc", "lowest"), "suffix-contexts")
    texts = docs.withColumn("block", block("doc_id"))
    asked = contexts.filter("lowest = doc").select("f", block("doc").alias("block"))
    bytes_ = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_contexts(bits), "f long, a long, doc long, before binary, `from` binary")
    bucket = F.pmod(F.xxhash64("a"), F.lit(n_buckets)).cast("int")
    parts = bytes_.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_sorted_bucket, "f long, doc long, mask long")
    whole = contexts.filter("lowest < doc").select("f", F.col("lowest").alias("doc"), F.lit(0).cast("long").alias("mask"), block("doc").alias("block"))
    found = whole.unionByName(parts.withColumn("block", block("doc")))
    return (
        texts.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(_removed(bits, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from all ``documents``."""
    done = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
own AS (SELECT g, min(doc_id) AS lowest FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS earlier FROM s JOIN own ON own.g = s.g WHERE own.lowest < s.doc_id),
run AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM (
  SELECT doc_id, i, sum((earlier IS NULL OR i > earlier + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
cut AS (SELECT run.doc_id, a, b, h, coalesce(lag(b) OVER (PARTITION BY run.doc_id ORDER BY a), 0) AS since FROM run JOIN d ON d.doc_id = run.doc_id),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM cut GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
