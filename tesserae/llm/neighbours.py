"""Approximate nearest neighbours by balanced posting lists (Euclidean distance, double precision).

Lists are ``2 sqrt(n)`` for n distinct vectors, so the lists that a query visits and their lengths both grow slower than
the input. Centroids are fitted by k-means on a bounded sample (32 vectors for each list, ``SAMPLE`` at most, in the order of
a hash); a list that holds more than twice its share is split and the smallest ones give up their centroids, so that lists are
balanced. The centroids, an eighth of the sample at most and so of bounded size, are broadcast with a graph of their nearest
neighbours, which is searched best first in memory. Every distinct vector is indexed: it goes to its nearest list and, near
a boundary, to further lists whose centroid is at most ``1 + CLOSURE`` times as far away (``REPLICAS`` in all). A
query visits every list whose centroid is at most ``ratio`` times as far as its nearest one (or as is usual, for a query that
lies on its centroid), and more until the visited lists hold ``FEWEST`` entries for each neighbour asked for. The ratio is fitted on
the sample: the least with which ``TARGET`` of the sample's true neighbours are in a visited list. Where the data
has no structure it grows until all lists are visited.

``exact`` searches again every list that, by the distance of its centroid and its radius, may hold a vector nearer than
the k-th found; this loses none.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that a query can return of them. Lists and
the queries that visit them are dealt out in blocks of bounded size, so a cluster with a third of all rows is many
groups. All distances that are returned are those of the original vectors.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

K = 10
SAMPLE, PER_LIST, ITERATIONS = 262_144, 32, 6
DEGREE, BEAM = 16, 32
CLOSURE, REPLICAS = 0.1, 5
TARGET, TRIALS, FEWEST = 0.96, 256, 8
BLOCK = 2_048


@dataclass
class Centroids:
    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    ratio: float = 1.0
    usual: float = 0.0  # the median distance of a sample's vector and its centroid

    def within(self, vector: np.ndarray, ratio: float, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Lists at most ``ratio`` times as far as the nearest (or as ``least``), and distances, by best-first search: nearest first,
        of equally near ones the smaller number. It goes on as long as a list within that range, or a better beam, may follow."""
        seen = np.zeros(len(self.points), bool)
        todo: list[tuple[float, int]] = []
        beam: list[float] = []  # negated, so the worst is on top
        found: list[tuple[float, int]] = []
        fresh, nearest = self.entries, np.inf
        while True:
            seen[fresh] = True
            gap = self.points[fresh] - vector
            for d, c in zip(np.einsum("ij,ij->i", gap, gap).tolist(), fresh.tolist(), strict=True):
                found.append((d, c))
                heapq.heappush(todo, (d, c))
                heapq.heappush(beam, -d) if len(beam) < BEAM else heapq.heappushpop(beam, -d)
            nearest = min(nearest, *(d for d, _ in found[-len(fresh) :]))
            limit = ratio * ratio * max(nearest, least * least)
            fresh = np.empty(0, np.int64)
            while todo and not len(fresh):
                d, c = heapq.heappop(todo)
                if len(beam) == BEAM and d > max(-beam[0], limit):
                    todo = []
                    break
                fresh = self.graph[c]
                fresh = fresh[~seen[fresh]]
            if not len(fresh):
                break
        near = sorted(x for x in found if x[0] <= limit)
        return np.array([c for _, c in near], np.int64), np.sqrt([d for d, _ in near])

    def distances(self, vector: np.ndarray) -> np.ndarray:
        gap = self.points - vector
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


def fit(sample: np.ndarray, lists: int, seed: int = 3) -> Centroids:
    """Centroids of about equally large clusters of ``sample`` and their neighbour graph."""
    sample = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(sample)))
    rng = np.random.default_rng(seed)
    points = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(ITERATIONS):
        own = np.concatenate([_squares(sample[a : a + 2048], points).argmin(1) for a in range(0, len(sample), 2048)])
        size = np.bincount(own, minlength=lists)
        for c in np.flatnonzero(size):
            points[c] = sample[own == c].mean(0)
        large = np.argsort(-size, kind="stable")[: np.count_nonzero(size > 2 * len(sample) / lists)]
        for big, small in zip(large, np.argsort(size, kind="stable"), strict=False):
            if size[small] * 4 < size[big]:
                points[small] = sample[rng.choice(np.flatnonzero(own == big))]
    degree = min(DEGREE, lists - 1)
    near = np.empty((lists, degree), np.int64)
    for a in range(0, lists, 1024):
        d = _squares(points[a : a + 1024], points)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + 1024] = np.argsort(d, axis=1, kind="stable")[:, :degree]
    step = max(1, lists // 32)
    index = Centroids(points, near, np.arange(0, lists, step)[:64])
    index.usual = float(np.median([index.distances(x).min() for x in sample[:: max(1, len(sample) // TRIALS)]]))
    index.ratio = _ratio(index, sample, min(K, len(sample) - 1))
    return index


def _ratio(index: Centroids, sample: np.ndarray, k: int) -> float:
    """The ratio of distances up to which queries of the sample must visit lists to meet ``TARGET`` of their neighbours in it."""
    needed = []
    for q in sample[:: max(1, len(sample) // TRIALS)][:TRIALS]:
        far = index.distances(q)
        gap = sample - q
        near = np.argsort(np.einsum("ij,ij->i", gap, gap), kind="stable")[1 : k + 1]  # without itself
        for n in near:
            lists, _ = index.within(sample[n], 1 + CLOSURE)
            needed.append(far[lists[:REPLICAS]].min() / max(far.min(), index.usual, 1e-300))
    return float(max(1.0, np.quantile(needed, TARGET))) if needed else 1.0


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, finite throughout and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _visits(shared, held: dict[int, int] | None = None, fewest: int = 0):
    """Rows (key, vector, ...) to one row for each list that they join, with the distance of its centroid; with ``held``, the
    numbers of entries by list, to those that they visit."""
    sizes = None if held is None else np.array([held.get(c, 0) for c in range(len(shared.value.points))])

    def visited(index: Centroids, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, d = index.within(v, index.ratio, index.usual)
        if sizes[c].sum() >= min(fewest, sizes.sum()):
            return c, d
        far = index.distances(v)
        c = np.argsort(far, kind="stable")
        c = c[: 1 + np.searchsorted(np.cumsum(sizes[c]), fewest)]
        return c, far[c]

    def run(batches):
        index: Centroids = shared.value
        for batch in batches:
            lists, rows, far = [], [], []
            for i, v in enumerate(batch.column(1)):
                own = np.array(v.as_py())
                c, d = (x[:REPLICAS] for x in index.within(own, 1 + CLOSURE)) if held is None else visited(index, own)
                lists += c.tolist()
                far += d.tolist()
                rows += [i] * len(c)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(far, pa.float64()), *(x.take(take) for x in batch.columns)], ["list", "far", *batch.schema.names])

    return run


def _visits_all(shared, radius: dict[int, float]):
    """Rows (query_id, vector, bound) to one row for each list that may hold a vector within the bound."""
    sizes = np.array([radius.get(c, -np.inf) for c in range(len(shared.value.points))])

    def run(batches):
        for batch in batches:
            lists, rows = [], []
            for i, (v, bound) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                far = shared.value.distances(np.array(v.as_py()))
                c = np.flatnonzero(far - sizes <= bound.as_py() * (1 + 1e-9) + 1e-12)
                lists += c.tolist()
                rows += [i] * len(c)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(batch.column(i).take(take) for i in (0, 1))], ["list", "query_id", "vector"])

    return run


def _compare(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each query in this block its k nearest entries of this block, by exact distance and smallest id."""
        out: list[tuple[int, list[int], float]] = []
        if left.num_rows and right.num_rows:
            to = lambda t: np.array(t["vector"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            a, b = to(left), to(right)
            ids = right["ids"].to_pylist()
            lead = np.array([x[0] for x in ids])
            step = max(1, (2 << 20) // b.size)
            for s in range(0, len(a), step):
                gap = a[s : s + step, None] - b[None]
                d = np.sqrt(np.einsum("qpd,qpd->qp", gap, gap))
                for q, row in zip(left["query_id"][s : s + step].to_pylist(), d, strict=True):
                    # One entry more than asked for, as the query's own may be among them.
                    edge = np.partition(row, k)[k] if len(row) > k + 1 else np.inf
                    near = np.flatnonzero(row <= edge)
                    near = near[np.lexsort((lead[near], row[near]))][: k + 1]
                    out += [(q, ids[i], float(row[i])) for i in near]
        cols = list(zip(*out, strict=True)) or [()] * 3
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_id", "ids", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row with ``is_query`` its ``k`` nearest other rows found.

    Nearest first, ties to the smaller id; all candidates if fewer. ``exact`` finds the nearest for certain. Unusable vectors (see ``usable``), null ids and vectors
    whose length isn't the commonest (of equally common ones the greatest) take no part. Rows repeated with one id are
    one candidate, at the distance of the nearest of its vectors; a query repeated with another vector asks for
    both. Empty tables give no row; other columns are read by ``is_query`` only.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("vector") == (size["n"] if size else 0))
    least = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = rows.select("vector", "vec_id").distinct().withColumn("nth", least).filter(F.col("nth") <= k + 1)
    entries = saved(entries.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    n = entries.count()
    lists = min(SAMPLE // 8, max(1, n // 8), math.ceil(2 * math.sqrt(n)))
    chosen = entries.withColumn("h", F.xxhash64("vector")).orderBy("h").limit(min(SAMPLE, PER_LIST * max(1, lists))).select("vector").collect()
    index = fit(np.array([r["vector"] for r in chosen]).reshape(len(chosen), -1), lists) if chosen else Centroids(np.zeros((1, 1)), np.zeros((1, 0), int), np.zeros(1, int))
    shared = spark.sparkContext.broadcast(index)
    posted = saved(entries.select("ids", "vector").mapInArrow(_visits(shared), "list int, far double, ids array<long>, vector array<double>"), "ann-lists")
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "vector")
    stats = {r["list"]: r for r in posted.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}  # a row for each list
    held = {c: r["n"] for c, r in stats.items()}
    asked = saved(queries.mapInArrow(_visits(shared, held, FEWEST * (k + 1)), "list int, far double, query_id long, vector array<double>"), "ann-queries")
    found = _ranked(posted, asked, k)
    if not exact:
        return found
    found = saved(found, "ann-found")
    radius = {c: r["r"] for c, r in stats.items()}
    bound = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    wider = queries.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return _ranked(posted, saved(wider.mapInArrow(_visits_all(shared, radius), "list int, query_id long, vector array<double>"), "ann-again"), k)


def _ranked(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest entries of each query among the lists that it visits."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    plan = blocks(posted, "n_entries").join(blocks(asked, "n_queries"), "list")  # a row for each list, so bounded
    plan = F.broadcast(plan)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = posted.join(plan, "list").withColumn("e", F.pmod(F.xxhash64("vector"), F.col("n_entries")).cast("int")).withColumn("q", every("n_queries"))
    left = asked.join(plan, "list").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("n_queries")).cast("int")).withColumn("e", every("n_entries"))
    key = ["list", "e", "q"]
    near = (
        left.select(*key, "query_id", "vector")
        .groupBy(*key)
        .cogroup(right.select(*key, "ids", "vector").groupBy(*key))
        .applyInArrow(_compare(k), "query_id long, ids array<long>, score double")
    )
    each = near.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every ``embeddings`` row whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
