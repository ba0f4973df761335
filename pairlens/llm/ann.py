"""Approximate nearest neighbours by inner product, with an adaptive scan over blocks of dimensions.

Index: inner product becomes distance by one more coordinate, which brings all vectors to the largest norm. Centroids
are fitted on a bounded sample (``SAMPLE`` vectors); every vector is rotated by one random orthogonal matrix and put in
the list of its nearest centroid, and lists are cut into blocks of ``BLOCK`` vectors stored dimension by dimension; the
queries of a list are dealt in groups of ``ASKS``, so that no task grows with a list or with what probes it.

Search: a query first scans its nearest list for a threshold, then the other probed lists. A scan adds up distances
over blocks of dimensions; after each, a candidate whose partial distance, scaled to all dimensions, exceeds the
threshold by more than the sampling error of a random rotation allows is abandoned (the test of adaptive sampling,
with its error factor as a parameter). How many lists are probed is measured: as many as hold the wanted share of the
exact neighbours of a few hundred vectors. Survivors are scored exactly, in double precision, on the original vectors.

Equal vectors are one vector with its ids: the smallest ``k + 1`` for results (no query can return more of them) and,
where the vector is a query, one search for all its ids. So a vector that a third of all rows repeat is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SAMPLE, MOST_LISTS, BLOCK, ASKS, DIMS, FIT_ROUNDS, TUNING = 20_000, 4096, 1024, 1024, 16, 12, 256


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that brings them to the norm."""
    gap = np.maximum(norm * norm - (v * v).sum(1), 0)
    return np.hstack([v, np.sqrt(gap)[:, None]])


def fit_centroids(v: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k distinct rows."""
    rng = np.random.default_rng(seed)
    c = v[rng.permutation(len(v))[:k]]
    for _ in range(FIT_ROUNDS):
        near = nearest(v, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=v[:, j], minlength=k) for j in range(v.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(v: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """Indexes of the m nearest centroids of each row, nearest first."""
    d = (c * c).sum(1)[None, :] - 2 * v @ c.T
    part = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(v), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def scan(block: np.ndarray, q: np.ndarray, bound: float, error: float) -> np.ndarray:
    """Columns of a block (dimensions by vectors) whose distance to q may be within the squared bound."""
    d = len(q)
    alive = np.arange(block.shape[1])
    part = np.zeros(block.shape[1])
    for j in range(0, d, DIMS):
        step = block[j : j + DIMS, alive] - q[j : j + DIMS, None]
        part = part + (step * step).sum(0)
        seen = min(j + DIMS, d)
        # A random rotation spreads a difference evenly; the partial share strays by error / sqrt(seen) at most, mostly.
        limit = bound * (1 + error / np.sqrt(seen)) ** 2 * seen / d if seen < d else bound * (1 + 1e-5) + 1e-9
        keep = part <= limit
        alive, part = alive[keep], part[keep]
        if not len(alive):
            break
    return alive


def _matrix(col: pa.Array, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


def _search(batches: Iterator[pa.RecordBatch], norm: float, k: int, error: float) -> Iterator[pa.RecordBatch]:
    """Within each block, its vectors come first and then the queries that probe it."""
    key, held, block = None, [], None
    for b in batches:
        out = []
        for list_, sub, group, kind, vec, turned, ids, rep, bound in zip(*(c.to_pylist() for c in b.columns)):
            if (list_, sub, group) != key:
                key, held, block = (list_, sub, group), [], None
            if kind == 0:
                held.append((np.frombuffer(vec, np.float64), np.frombuffer(turned, np.float32), ids))
                continue
            if not held:
                continue
            if block is None:
                vecs = np.stack([h[0] for h in held])
                block = np.ascontiguousarray(np.stack([h[1] for h in held]).T)
            q, t = np.frombuffer(vec, np.float64), np.frombuffer(turned, np.float32)
            reach = float(q @ q) + norm * norm
            if bound is None and len(held) > k:
                scores = vecs @ q
                bound = float(np.partition(scores, -k - 1)[-k - 1])
            alive = np.arange(len(held)) if bound is None else scan(block, t, max(reach - 2 * bound, 0.0), error)
            scores = np.array([float(np.dot(vecs[i], q)) for i in alive])
            best = sorted(range(len(alive)), key=lambda i: -scores[i])
            found = [(-scores[i], x) for i in best if bound is None or scores[i] >= bound - 1e-12 for x in held[alive[i]][2]]
            found.sort()
            out += [(rep, x, -s) for s, x in found[: k + 1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["rep", "vec_id", "score"])


def _needed_probes(index: DataFrame, centroids: np.ndarray, k: int, recall: float, scratch: Scratch) -> int:
    """Nearest lists that hold the share ``recall`` of the exact neighbours of ``TUNING`` vectors, found by brute force.

    Each batch of the index returns its k best for each tuning vector, so what meets again is bounded by their number.
    """
    asked = np.stack([np.frombuffer(r.vec, np.float64) for r in index.orderBy(F.xxhash64("rep", F.lit("tuning"))).limit(TUNING).select("vec").collect()])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = asked @ _matrix(b.column(1), np.float64).T
                at = np.argsort(-scores, axis=1)[:, : k + 1]
                list_ = b.column(0).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked), dtype=np.int32), at.shape[1])), pa.array(list_.ravel()), pa.array(np.take_along_axis(scores, at, 1).ravel())], names=["q", "list", "score"])

    found = index.select("list", "vec").mapInArrow(best, "q int, list int, score double")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).where(F.col("r") <= k + 1)
    found = scratch.save(found.select("q", "list")).collect()  # TUNING * (k + 1) rows
    order = nearest(np.hstack([asked, np.zeros((len(asked), 1))]), centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    return int(np.quantile([place[r.q, r.list] for r in found], recall, method="higher")) + 1


def nearest_neighbours(
    vectors: DataFrame,
    queries: str = "vec_id % 20 = 0",
    k: int = 20,
    recall: float = 0.97,
    probes: int | None = None,
    error: float = 2.1,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each row that ``queries`` (SQL over vec_id) selects.

    Best first by inner product in double precision, ties to the smaller id, never the query's own id. Rows whose
    vector is null, empty, zero, holds null or non-finite components or is not of the commonest length take no part,
    nor do rows without id; repeated rows are one. With k or fewer candidates all are returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    df = df.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    common = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = common["d"]
    df = scratch.save(df.where(F.size("v") == d).dropDuplicates(["vec_id", "v"]))
    few = df.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = scratch.save(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    n, norm2 = distinct.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    norm = float(np.sqrt(norm2))
    sample = np.array([r.v for r in distinct.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()])
    lists = max(1, min(MOST_LISTS, int(np.sqrt(n))))
    turn = rotation(d + 1, seed)
    centroids = spark.sparkContext.broadcast(fit_centroids(lifted(sample, norm), lists, seed))  # at most MOST_LISTS rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(0).to_pylist())
            x = lifted(v, norm)
            turned = (x @ turn).astype(np.float32)
            flat = [r.tobytes() for r in v]
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x, centroids.value, 1)[:, 0].astype(np.int32)), pa.array(flat, pa.binary()), pa.array([r.tobytes() for r in turned], pa.binary()), b.column(1), b.column(2)], names=["list", "vec", "turned", "ids", "rep"])

    index = distinct.select("v", "ids", "rep").mapInArrow(place, "list int, vec binary, turned binary, ids array<long>, rep long")
    index = scratch.save(index)
    probes = min(lists, probes or _needed_probes(index, centroids.value, k, recall, scratch))
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("subs"))  # a row for each list
    sizes = F.broadcast(scratch.save(sizes))
    blocks = index.join(sizes, "list").withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    blocks = blocks.select("list", "sub", F.lit(0).alias("kind"), "vec", "turned", "ids", "rep", F.lit(None).cast("double").alias("bound"))

    # One search for each distinct query vector.
    asked = scratch.save(df.where(queries).select("vec_id", "v", F.xxhash64("v").alias("h")))
    keyed = distinct.select(F.xxhash64("v").alias("h"), F.col("v").alias("w"), "rep")
    asked = scratch.save(asked.join(keyed, "h").where("v = w").select(F.col("vec_id").alias("query_id"), "rep"))
    wanted = distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("v", "rep")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(0).to_pylist())
            x = np.hstack([v, np.zeros((len(v), 1))])
            near = nearest(x, centroids.value, probes).astype(np.int32)
            turned = (x @ turn).astype(np.float32)
            m = near.shape[1]
            flat, spun = [r.tobytes() for r in v], [r.tobytes() for r in turned]
            reps = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel()), pa.array(np.tile(np.arange(m, dtype=np.int32), len(v))), pa.array([f for f in flat for _ in range(m)], pa.binary()), pa.array([f for f in spun for _ in range(m)], pa.binary()), pa.array([r for r in reps for _ in range(m)], pa.int64())],
                names=["list", "turn", "vec", "turned", "rep"],
            )

    probed = scratch.save(wanted.mapInArrow(probe, "list int, turn int, vec binary, turned binary, rep long"))
    width = max(16, spark.sparkContext.defaultParallelism * 2, lists // 4)

    def run(asks: DataFrame) -> DataFrame:
        # Blocks of a list meet its queries in groups of both, so a list that all queries probe is many groups.
        groups = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("groups"))
        groups = F.broadcast(scratch.save(groups))
        asks = asks.join(sizes, "list").join(groups, "list").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        asks = asks.withColumn("group", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int"))
        asks = asks.select("list", "sub", "group", F.lit(1).alias("kind"), "vec", "turned", F.array().cast("array<long>").alias("ids"), "rep", "bound")
        held = blocks.join(groups, "list").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        rows = held.select(asks.columns).unionAll(asks).repartition(width, "list", "sub", "group").sortWithinPartitions("list", "sub", "group", "kind")
        return rows.mapInArrow(lambda b: _search(b, norm, k, error), "rep long, vec_id long, score double")

    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    home = scratch.save(run(probed.where("turn = 0").withColumn("bound", F.lit(None).cast("double"))))
    ranked = home.withColumn("r", F.row_number().over(best))
    bounds = scratch.save(ranked.where(F.col("r") == k + 1).select("rep", F.col("score").alias("bound")))
    rest = run(probed.where("turn > 0").join(bounds, "rep", "left"))
    found = home.unionAll(rest).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    tops = scratch.save(found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("top")))
    out = asked.join(tops, "rep").withColumn("top", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return out.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
