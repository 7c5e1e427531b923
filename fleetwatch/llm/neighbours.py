"""Operator 5: approximate nearest neighbours over balanced posting lists.

* Centroids are fitted by balanced k-means on a sample of about ``SAMPLE`` distinct vectors
  (their number is N / ``LIST_ROWS``, at most ``MAX_LISTS``); they and a neighbour graph over them are
  broadcast, so that broadcast is bounded. A batched best-first walk on the graph finds the
  nearest centroids of a vector.
* Every vector goes to its nearest list and, if it lies near a boundary, to up to ``REPLICAS``
  lists whose distance is within ``BOUNDARY`` of the nearest.
* A query visits the lists within ``PRUNE`` of its nearest centroid's distance, at least
  ``MIN_LISTS`` and at most 1/``SHARE`` of all, and more where these hold too few vectors. Both
  bounds are arguments; without them all lists are visited and the result is exact.
* Lists are stored as parts of ``PART`` vectors and queries as blocks of ``QUERIES``, joined by
  list and scored by matrix product, so a list with a third of all vectors is many rows.

The measure is the inner product of the original vectors in double precision; routing uses the
Euclidean distance after the usual extra component that makes all norms equal.

Defined cases: null, zero and non-finite vectors and those with a null component take no part,
nor do vectors whose dimension is not the most frequent one; repeated rows of an id count as
one candidate with its best score; rows without id take no part; ties go to the smaller
vec_id; fewer candidates than ``k`` give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 20_000
LIST_ROWS = 256
MAX_LISTS = 1024
REPLICAS = 4
BOUNDARY = 0.15
PRUNE = 0.15
MIN_LISTS = 12
SHARE = 4
DEGREE = 24
PART = 1024
QUERIES = 256
HELD = 1_000_000


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means whose assignment pays for crowded clusters; empty ones restart at far points."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    fee = np.zeros(k)
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T + fee
        own = d.argmin(1)
        size = np.bincount(own, minlength=k)
        c = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1) / np.maximum(size, 1)[:, None]
        empty = np.flatnonzero(size == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d[np.arange(len(x)), own])[:len(empty)]]
        fee = 0.05 * (d.max() - d.min()) * (size / size.mean() - 1).clip(0, 1)
    return c


def neighbour_graph(c: np.ndarray) -> np.ndarray:
    """Nearest centroids of each centroid, the last links replaced by far ones for reach."""
    n = min(DEGREE, max(1, len(c) - 1))
    d = (c * c).sum(1) - 2 * c @ c.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :n]
    far = np.random.default_rng(3).integers(0, len(c), (len(c), max(1, n // 6)))
    near[:, n - far.shape[1]:] = far
    return near


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of about the ``beam`` nearest centroids of each query, nearest first:
    all queries expand their four best unexpanded centroids at a time."""
    m, k = len(q), len(c)
    norm, qq = (c * c).sum(1), (q * q).sum(1)
    beam = min(beam, k)
    seeds = np.linspace(0, k - 1, min(k, max(beam, 16))).astype(int)
    ids = np.tile(seeds, (m, 1))
    dist = norm[seeds] - 2 * q @ c[seeds].T
    seen = np.zeros((m, k), bool)
    seen[:, seeds] = True
    done = np.zeros(ids.shape, bool)
    rows = np.arange(m)[:, None]
    while True:
        order = np.argsort(dist, axis=1)[:, :beam]
        ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
        if done.all():
            break
        pick = np.argsort(done, axis=1, kind="stable")[:, :4]
        fresh = ~done[rows, pick]
        done[rows, pick] = True
        new = graph[ids[rows, pick]].reshape(m, -1)
        skip = seen[rows, new] | np.repeat(~fresh, graph.shape[1], axis=1)
        ordered = np.sort(np.where(skip, k, new), axis=1)
        new = np.where(np.diff(ordered, axis=1, prepend=-1) == 0, k, ordered)
        width = int((new < k).sum(axis=1).max())
        if not width:
            continue
        new = np.sort(new, axis=1)[:, :width]
        real = new < k
        at = np.minimum(new, k - 1)
        d = np.where(real, norm[at] - 2 * np.einsum("md,mnd->mn", q, c[at]), np.inf)
        seen[np.nonzero(real)[0], at[real]] = True
        ids, dist = np.concatenate([ids, at], 1), np.concatenate([dist, d], 1)
        done = np.concatenate([done, ~real], 1)
    return ids, np.sqrt(np.maximum(dist + qq[:, None], 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _routed(rows: DataFrame, dim: int, choose) -> DataFrame:
    """(list, id, vec) for the lists ``choose`` gives to the vectors of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = _matrix(part.column(1), dim)
                who, lists = choose(x)
                ids = part.column(0).take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), ids, pa.array([v.tobytes() for v in x[who]], pa.binary())],
                    ["list", "id", "vec"])
    return rows.select("id", "v").mapInArrow(run, "list int, id long, vec binary")


def _packed(rows: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """(list, ids, vecs) rows of about ``most`` vectors; a list's vectors are dealt by the
    stored row order, so equal vectors and ids spread too."""
    parts = {k: -(-n // most) for k, n in sizes.items()}
    many = F.create_map(*[x for k, n in parts.items() for x in (F.lit(k), F.lit(n))]) if parts else None
    part = F.monotonically_increasing_id() % F.coalesce(many[F.col("list")], F.lit(1)) if parts else F.lit(0)
    pair = F.collect_list(F.struct("id", "vec"))
    return (rows.withColumn("part", part).groupBy("list", "part").agg(pair.alias("p"))
            .select("list", F.col("p.id").alias("ids"), F.col("p.vec").alias("vecs")))


def _top(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best candidates per query, an id once with its best score, ties to smaller ids."""
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    pairs = np.lexsort((np.arange(len(who)), ids, who))
    again = np.zeros(len(who), bool)
    again[pairs[1:]] = (who[pairs[1:]] == who[pairs[:-1]]) & (ids[pairs[1:]] == ids[pairs[:-1]])
    who, ids, score = who[~again], ids[~again], score[~again]
    keep = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
    return who[keep], ids[keep], score[keep]


def _best(ids: np.ndarray, v: np.ndarray, who: np.ndarray, q: np.ndarray, k: int):
    """Per query the k best of one part: (query, id, score) arrays. The matrix product finds
    what may be among them, the score is computed pair by pair."""
    s = q @ v.T
    s[who[:, None] == ids[None, :]] = -np.inf
    near = s > -np.inf
    if len(ids) > k and len(np.unique(ids)) == len(ids):
        bar = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        near &= s >= (bar - 1e-9 * np.maximum(1, np.abs(bar)))[:, None]
    i, j = np.nonzero(near)
    score = np.concatenate([(q[i[a:a + 16384]] * v[j[a:a + 16384]]).sum(axis=1) for a in range(0, max(1, len(i)), 16384)])
    return _top(who[i], ids[j], score, k)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           prune: float | None = PRUNE, share: int | None = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``queries`` holds, the k nearest of
    all other rows that were found. ``prune`` bounds the distance ratio of the lists visited and
    ``share`` their part of all lists; None lifts a bound, and without both every list is
    visited and the answer is exact."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = (rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top"))
             .orderBy(F.desc("n"), "dim").first())
    schema = "query_id long, rank int, vec_id long, score double"
    if facts is None:
        return spark.createDataFrame([], schema)
    dim, n, top = facts
    rows = rows.where(F.size("v") == dim)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE).select("v").limit(2 * SAMPLE).toPandas()
    x = np.unique(np.array(sample["v"].tolist(), float).reshape(len(sample), dim), axis=0)
    lists = min(MAX_LISTS, max(1, n // LIST_ROWS), max(1, len(x)))
    c = balanced_centroids(_lifted(x, top), lists) if len(x) else np.zeros((1, dim + 1))
    shared = spark.sparkContext.broadcast((c, neighbour_graph(c), top))

    def homes(x):
        c, graph, top = shared.value
        ids, d = walk(_lifted(x, top), c, graph, 2 * REPLICAS)
        ids, d = ids[:, :REPLICAS], d[:, :REPLICAS]
        who, at = np.nonzero(d <= d[:, :1] * (1 + BOUNDARY))
        return who, ids[who, at]

    postings = stored(_routed(rows, dim, homes), "postings")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # at most MAX_LISTS
    counts = np.array([sizes.get(i, 0) for i in range(lists)])
    need = REPLICAS * (k + 1)

    def visits(x):
        c, graph, _ = shared.value
        q = np.concatenate([x, np.zeros((len(x), 1))], 1)
        if prune is None and share is None:
            return np.repeat(np.arange(len(q)), len(c)), np.tile(np.arange(len(c)), len(q))
        most = len(c) if share is None else min(len(c), max(MIN_LISTS, len(c) // share))
        ids, d = walk(q, c, graph, most + most // 2)
        ids, d = ids[:, :most], d[:, :most]
        near = np.ones(d.shape, bool) if prune is None else d <= d[:, :1] * (1 + prune)
        take = near | (np.arange(ids.shape[1]) < MIN_LISTS)
        who, at = np.nonzero(take)
        out = ids[who, at]
        for i in np.flatnonzero((counts[ids] * take).sum(axis=1) < need):  # too few vectors: go on in distance order
            order = np.argsort(((c - q[i]) ** 2).sum(1))
            upto = int(np.searchsorted(np.cumsum(counts[order]), need)) + 1
            more = np.setdiff1d(order[:upto], out[who == i])
            who, out = np.concatenate([who, np.full(len(more), i)]), np.concatenate([out, more])
        return who, out

    asked = stored(_routed(rows.where("asked"), dim, visits), "queries")
    loads = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    left = _packed(asked, loads, QUERIES).select("list", F.col("ids").alias("who"), F.col("vecs").alias("q"))
    pairs = left.join(_packed(postings, sizes, PART), "list").select("who", "q", "ids", "vecs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the lists that one task reads are merged per query, up to HELD at a time."""
        unpack = lambda col: np.frombuffer(b"".join(col.as_py()), float).reshape(-1, dim)
        held, size = [], 0

        def merged():
            return _top(*[np.concatenate(c) for c in zip(*held)], k)

        for batch in batches:
            for i in range(batch.num_rows):
                who, q, ids, v = (col[i] for col in batch.columns)
                held.append(_best(np.array(ids.as_py()), unpack(v), np.array(who.as_py()), unpack(q), k))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(f) for f in held[0]], ["query_id", "vec_id", "score"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in merged()], ["query_id", "vec_id", "score"])

    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (pairs.mapInArrow(score, "query_id long, vec_id long, score double")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
