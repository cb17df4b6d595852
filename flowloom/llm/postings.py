"""Nearest neighbours by largest inner product, from balanced posting lists.

Vectors get one more coordinate that makes all norms equal, so the largest
inner product is the smallest distance. A bounded sample is cut into leaves of
equal size; the leaves' means are the lists' centroids, held in memory in a
neighbour graph. A vector goes to its nearest lists: those within ``BORDER``
times the nearest distance, unless a list already chosen is nearer to them than
the vector is. A query reads the lists within a ratio of its nearest one; the
ratio is fitted on the sample so that ``TARGET`` of the true neighbours there
are in lists that are read. There is no limit on the lists a query reads.

Equal vectors are one entry with their smallest ids, which is all that a result
can hold of them. Lists and the queries on them are cut into tiles of bounded
size, so a list with a third of all vectors or queries is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import slim
from flowloom.runtime import write_table

SAMPLE = 20_000       # distinct vectors that the lists are fitted on, at most
LEAF = 80             # sample vectors to a list
DEGREE, BEAM = 16, 24
BORDER, REPLICAS = 1.1, 8
TARGET = 0.97
TILE_VECTORS, TILE_QUERIES = 4096, 1024


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in parts of equal size (give or take one), by halving along
    the direction of most variance."""
    done, todo = [], [np.arange(len(points))]
    rng = np.random.default_rng(5)
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        own = points[rows] - points[rows].mean(axis=0)
        axis = rng.normal(size=own.shape[1])
        for _ in range(8):
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = np.argsort(own @ axis, kind="stable")
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


@dataclass
class Lists:
    """Centroids, their neighbour graph, and the fitted ratio."""

    bound: float          # largest norm
    centroids: np.ndarray
    ratio: float = 1.0

    def __post_init__(self) -> None:
        c = self.centroids
        near = np.argsort(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if len(c) <= 256 else
                          np.concatenate([(c[i:i + 64] ** 2).sum(axis=1)[:, None] - 2 * c[i:i + 64] @ c.T + (c ** 2).sum(axis=1) for i in range(0, len(c), 64)]),
                          axis=1, kind="stable")
        links = near[:, 1:1 + DEGREE]
        # A ring over all nodes keeps the graph in one piece.
        ring = np.roll(np.arange(len(c)), 1)[:, None]
        self.graph = np.concatenate([links, ring], axis=1) if len(c) > 1 else np.zeros((len(c), 1), np.int64)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the coordinate that equals norms (0 for queries)."""
        v = vectors.astype(np.float64)
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.bound ** 2 - (v ** 2).sum(axis=1)))
        return np.concatenate([v, rest[:, None]], axis=1)

    def walk(self, points: np.ndarray, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Nearest lists of each point, by a best-first walk over the graph with
        a beam of ``width``, as long as a list within ``ratio`` times the nearest
        distance is not expanded. Unfilled places have distance infinity."""
        n, c = len(points), len(self.centroids)
        width = min(width, c)
        rows = np.arange(n)
        seen = np.zeros((n, c), bool)
        ids = np.zeros((n, width), np.int64)
        dist = np.full((n, width), np.inf)
        open_ = np.zeros((n, width), bool)
        starts = np.unique(np.linspace(0, c - 1, min(8, width)).astype(int))
        ids[:, :len(starts)] = starts
        dist[:, :len(starts)] = np.sqrt(((points[:, None, :] - self.centroids[starts][None]) ** 2).sum(axis=2))
        open_[:, :len(starts)] = True
        seen[:, starts] = True
        while True:
            want = np.where(open_, dist, np.inf)
            best = want.argmin(axis=1)
            active = want[rows, best] <= np.maximum(ratio, 1.0) * dist.min(axis=1)
            active &= np.isfinite(want[rows, best])
            a = np.flatnonzero(active)
            if not len(a):
                break
            open_[a, best[a]] = False
            next_ = self.graph[ids[a, best[a]]]
            d = np.sqrt(((points[a][:, None, :] - self.centroids[next_]) ** 2).sum(axis=2))
            d[seen[a[:, None], next_]] = np.inf
            seen[a[:, None], next_] = True
            all_ids = np.concatenate([ids[a], next_], axis=1)
            all_d = np.concatenate([dist[a], d], axis=1)
            all_open = np.concatenate([open_[a], np.isfinite(d)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids[a], dist[a], open_[a] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_d, all_open))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def homes(self, vectors: np.ndarray) -> list[list[int]]:
        """The lists that hold each vector."""
        ids, dist = self.walk(self.lifted(vectors), BEAM, BORDER)
        out = []
        for row, d in zip(ids, dist):
            chosen = [int(row[0])]
            for i, x in zip(row[1:], d[1:]):
                if x > BORDER * d[0] or len(chosen) == REPLICAS:
                    break
                if all(((self.centroids[i] - self.centroids[j]) ** 2).sum() > x * x for j in chosen):
                    chosen.append(int(i))
            out.append(chosen)
        return out

    def reads(self, queries: np.ndarray) -> list[list[int]]:
        """The lists that each query reads."""
        ids, dist = self.walk(self.lifted(queries, True), len(self.centroids), self.ratio)
        keep = dist <= self.ratio * dist[:, :1]
        return [row[k].tolist() for row, k in zip(ids, keep)]


def fit(sample: np.ndarray, bound: float, leaf: int = LEAF, target: float = TARGET, top: int = 20, queries: int = 400) -> Lists:
    """Lists from a sample of distinct vectors, and their ratio."""
    lists = Lists(bound, np.zeros((0, sample.shape[1] + 1)))
    points = lists.lifted(sample)
    lists = Lists(bound, np.stack([points[r].mean(axis=0) for r in leaves(points, leaf)]))
    homes = lists.homes(sample)
    needed = []
    for i in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
        q = sample[i].astype(np.float64)
        s = sample @ q
        s[i] = -np.inf
        d = np.sqrt(((lists.centroids - lists.lifted(q[None], True)) ** 2).sum(axis=1))
        near = np.argsort(-s, kind="stable")[:min(top, len(sample) - 1)]
        needed += [min(d[j] for j in homes[k]) / d.min() for k in near]
    ratio = float(np.quantile(needed, target)) + 1e-9 if needed else 1.0
    return Lists(bound, lists.centroids, ratio)


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embedding.isNotNull() & good & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.float32)


def nearest(vectors: DataFrame, queries: Column, top: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds its
    ``top`` rows of largest inner product other than itself, nearest first,
    ties to the smaller vec_id; all of them if there are fewer.

    Rows with a null id, or a vector that is null, zero, or holds null or
    non-finite components, take no part; nor do vectors of another length than
    the most frequent one (the shorter on ties). Exact copies of a row count
    once. Extra columns are ignored, an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"),
                          F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == length["d"])
    # One entry for equal vectors: the smallest ids, one more than a result needs.
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    distinct_ids = rows.select("vec_id", "embedding").distinct().withColumn("place", place).filter(F.col("place") <= top + 1)
    entries = write_table(distinct_ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                          .select(F.col("ids")[0].alias("entry"), "ids", "embedding"), "vector_entries")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bound = entries.agg(F.max(norm)).first()[0]
    some = entries.orderBy(F.xxhash64("embedding"), "entry").limit(sample).select("embedding").toArrow()
    lists = fit(_matrix(some.column("embedding")), bound, top=top)
    shared = spark.sparkContext.broadcast(lists)  # bounded by the sample

    def route(asking: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in parts:
                for b in slim(whole, 512):
                    v = _matrix(b.column("embedding"))
                    found = (shared.value.reads(v) if asking else shared.value.homes(v)) if len(v) else []
                    yield b.append_column("lists", pa.array(found, pa.list_(pa.int32())))
        return run

    asked = write_table(rows.filter("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct(), "queries")
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("query_id"))
    asking = asked.withColumn("place", place).filter("place = 1").select(F.col("query_id").alias("asker"), "embedding")
    put = write_table(entries.mapInArrow(route(False), "entry long, ids array<long>, embedding array<float>, lists array<int>"), "vector_lists")
    ask = write_table(asking.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(
        route(True), "asker long, embedding array<float>, lists array<int>"), "query_lists")
    put = put.select("entry", "ids", "embedding", F.explode("lists").alias("list"))
    ask = ask.select("asker", F.col("embedding").alias("wanted"), F.explode("lists").alias("list"))
    # Tiles: blocks of a list's vectors by chunks of its queries, by counts per list.
    sizes = put.groupBy("list").agg(F.ceil(F.count("*") / TILE_VECTORS).cast("int").alias("blocks"))
    chunks = ask.groupBy("list").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("chunks"))
    plan = {r["list"]: (r["blocks"], r["chunks"]) for r in sizes.join(chunks, "list").collect()}  # one row for each list
    blocks, chunks = ([plan.get(i, (0, 0))[j] for i in range(len(lists.centroids))] for j in (0, 1))
    count = lambda which: F.element_at(F.array(*[F.lit(x) for x in which]), F.col("list") + 1)
    put = put.filter(count(chunks) > 0).select(
        "list", F.pmod(F.xxhash64("entry"), count(blocks)).cast("int").alias("block"), "entry", "ids", "embedding",
        F.explode(F.sequence(F.lit(0), count(chunks) - 1)).alias("chunk"))
    ask = ask.filter(count(blocks) > 0).select(
        "list", F.pmod(F.xxhash64("asker"), count(chunks)).cast("int").alias("chunk"), "asker", "wanted",
        F.explode(F.sequence(F.lit(0), count(blocks) - 1)).alias("block"))
    most = top + 1

    def tile(own: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"asker": [], "ids": [], "score": []}
        if own.num_rows and asking.num_rows:
            v = _matrix(own.column("embedding")).astype(np.float64)
            q = _matrix(asking.column("wanted")).astype(np.float64)
            entry, ids = own.column("entry").to_numpy(), own.column("ids").to_pylist()
            order = np.argsort(entry)  # ties go to the smaller id
            v, entry = v[order], entry[order]
            for i, who in enumerate(asking.column("asker").to_pylist()):
                s = (v * q[i]).sum(axis=1)  # the same order of additions for each pair, wherever it is
                near = np.argsort(-s, kind="stable")[:most]
                out["asker"] += [who] * len(near)
                out["ids"] += [ids[order[j]] for j in near]
                out["score"] += s[near].tolist()
        return pa.table({"asker": pa.array(out["asker"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int64())),
                         "score": pa.array(out["score"], pa.float64())})

    key = ["list", "block", "chunk"]
    found = put.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(tile, "asker long, ids array<long>, score double")
    found = found.groupBy("asker", F.col("ids")[0].alias("entry")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "entry")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    found = found.select("asker", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= most).select("asker", "score", "vec_id")
    # Rows with equal vectors share a search; each leaves itself out.
    named = asked.join(asking.select("asker", "embedding"), "embedding").select("query_id", "asker")
    found = named.join(found, "asker").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
