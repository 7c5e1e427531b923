"""Operator 13: hard negatives by a GNAT-style multiway tree.

* Vectors are whole numbers (floor(256 x)). One more component makes all rows equally long, so a
  score (inner product with the anchor) is a distance and a window of scores is an annulus
  around the anchor.
* The tree has two levels of split points, drawn from a sample of about ``SAMPLE`` rows: a row belongs
  to the nearest split point, and within it to the nearest of that one's own (hyperplane domains).
  Every row is dealt through the tree. Each split point stores, for each of its siblings'
  subtrees, the least and the largest distance from it to any row there.
* An anchor visits a subtree only if, for every sibling split point, the stored range meets the
  annulus moved by the anchor's distance to that point. The rows of the leaves that remain are
  scored exactly (whole numbers, while scores stay below 2^53) against the anchor's windows.
* Two rounds: the nearest leaves give each window its k-th best score so far, which becomes the
  window's lower end; the second round visits what the narrower annulus still meets.
  No subtree is left out on any other ground, so the result is exact.

Positives are the first rows of the anchor's label (a window without ends), negatives the first
rows of other labels in the window that a positive's score gives. Leaves are stored in parts
of ``PART`` rows and anchors in blocks of ``BLOCK``, so a leaf with a third of all rows is many rows, and a
task merges its results per window. The broadcast tree has at most ``LEAVES`` leaves.

Defined cases: rows with a null label, id or vector, or with any null or non-finite component take no
part, nor do vectors whose dimension is not the most frequent one; zero vectors do; of rows that share an
id the one with the least (label, vector) counts; ties go to the smaller id; an anchor without
positives, or a positive without negatives, has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 20_000
LEAF_ROWS = 512
LEAVES = 1024
NEAR = 2
PART = 1024
BLOCK = 256
HELD = 500_000
SLACK = 1e-6


def whole_vector(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(256 * x.cast("double")).cast("double"))


class Tree:
    """Split points of two levels; ``inner[g]`` lists the leaves of group g."""

    def __init__(self, x: np.ndarray, leaves: int, longest: float):
        self.longest, self.slack = longest, SLACK * (1 + longest ** 0.5)
        rng = np.random.default_rng(11)
        x = self.lifted(x[rng.permutation(len(x))])
        fan = max(1, min(len(x), round(leaves ** 0.5)))
        self.outer = self._spread(x, fan)
        home = self._nearest(x, self.outer)
        points, groups = [], []
        for g in range(len(self.outer)):
            own = x[home == g] if (home == g).any() else self.outer[g:g + 1]
            mine = self._spread(own, max(1, round(leaves * len(own) / len(x))))
            points.append(mine)
            groups += [g] * len(mine)
        self.points, self.group = np.concatenate(points), np.array(groups)
        self.inner = [np.flatnonzero(self.group == g) for g in range(len(self.outer))]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))[:, None]], 1)

    @staticmethod
    def _spread(x: np.ndarray, k: int) -> np.ndarray:
        """k split points far from each other, out of the first 4k distinct rows."""
        pool = np.unique(x[:4 * k], axis=0)
        far = np.full(len(pool), np.inf)
        picked = [0]
        for _ in range(min(k, len(pool)) - 1):
            far = np.minimum(far, ((pool - pool[picked[-1]]) ** 2).sum(1))
            picked.append(int(far.argmax()))
        return pool[picked]

    @staticmethod
    def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T
        return np.sqrt(np.maximum(square, 0))

    @classmethod
    def _nearest(cls, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return cls.distances(x, points).argmin(1)

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of each row, and its distances to the outer and to its group's inner points."""
        x = self.lifted(x)
        outer = self.distances(x, self.outer)
        group, inner = outer.argmin(1), self.distances(x, self.points)
        own = np.where(self.group[None, :] == group[:, None], inner, np.inf)
        return own.argmin(1), outer, own

    def home(self, q: np.ndarray) -> np.ndarray:
        """The NEAR nearest leaves of each anchor."""
        d = self.distances(np.concatenate([q, np.zeros((len(q), 1))], 1), self.points)
        return np.argsort(d, axis=1, kind="stable")[:, :NEAR]

    def meets(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, ranges: tuple) -> np.ndarray:
        """Which leaves may hold a row whose score lies in [low, high] of an anchor."""
        (o_min, o_max), (i_min, i_max) = ranges
        with np.errstate(invalid="ignore"):
            reach = (q * q).sum(1) + self.longest
            near = np.sqrt(np.maximum(reach - 2 * high, 0)) - self.slack
            far = np.sqrt(np.maximum(reach - 2 * low, 0)) + self.slack
        q = np.concatenate([q, np.zeros((len(q), 1))], 1)

        def alive(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            # a row at r in [near, far] from the anchor lies between |d - r| and d + r from the point
            least = np.maximum(np.maximum(d - far[:, None], near[:, None] - d), 0)
            most = d + far[:, None]
            return ((lo[None] <= most[:, :, None] + self.slack) & (hi[None] >= least[:, :, None] - self.slack)).all(1)

        groups = alive(self.distances(q, self.outer), o_min, o_max)
        out = np.zeros((len(q), len(self.points)), bool)
        for g, own in enumerate(self.inner):
            out[:, own] = groups[:, g, None] & alive(self.distances(q, self.points[own]), i_min[np.ix_(own, own)], i_max[np.ix_(own, own)])
        return out & (low <= high)[:, None]


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _block(column: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.as_py()), np.float64).reshape(-1, dim)


def _rows_of(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


class Index:
    """The dealt rows with the tree and its ranges."""

    def __init__(self, rows: DataFrame, dim: int, n: int, longest: float):
        spark = rows.sparkSession
        self.dim, self.n = dim, n
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE).select("v").limit(2 * SAMPLE).toPandas()
        x = np.array(sample["v"].tolist(), float).reshape(len(sample), dim)
        tree = Tree(x if len(x) else np.zeros((1, dim)), max(1, min(LEAVES, n // LEAF_ROWS)), longest)
        self.tree = spark.sparkContext.broadcast(tree)
        shared = self.tree

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    part = batch.slice(k, 1024)
                    x = _numbers(part.column(2), dim)
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value.deal(x)[0], pa.int32()), part.column(0), part.column(1), _rows_of(x)],
                                                     ["leaf", "id", "label", "vec"])

        self.rows = stored(rows.select("id", "label", "v").mapInArrow(deal, "leaf int, id long, label long, vec binary"), "leaves")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row per split point and subtree that the task has seen."""
            tree = shared.value
            g, m = len(tree.outer), len(tree.points)
            found = [np.full((g, g), np.inf), np.full((g, g), -np.inf), np.full((m, m), np.inf), np.full((m, m), -np.inf)]
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
                for k in range(0, len(x), 1024):
                    leaf = batch.column(0).slice(k, 1024).to_numpy(zero_copy_only=False)
                    _, outer, inner = tree.deal(x[k:k + 1024])
                    for lo, hi, at, d in ((found[0], found[1], tree.group[leaf], outer), (found[2], found[3], leaf, inner)):
                        for s in np.unique(at):
                            own = d[at == s]
                            lo[:, s], hi[:, s] = np.minimum(lo[:, s], own.min(0)), np.maximum(hi[:, s], own.max(0))
            for level, (lo, hi) in enumerate((found[:2], found[2:])):
                p, s = np.nonzero(np.isfinite(lo))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), level), pa.int32()), pa.array(p, pa.int32()), pa.array(s, pa.int32()),
                                                  pa.array(lo[p, s]), pa.array(hi[p, s])], ["level", "point", "subtree", "low", "high"])

        spans = (self.rows.select("leaf", "vec").mapInArrow(measure, "level int, point int, subtree int, low double, high double")
                 .groupBy("level", "point", "subtree").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas())
        ranges = []
        for level, size in enumerate((len(tree.outer), len(tree.points))):
            # what no row has been seen in stays an empty range, which meets nothing
            lo, hi = np.full((size, size), np.inf), np.full((size, size), -np.inf)
            own = spans[spans["level"] == level]
            lo[own["point"], own["subtree"]], hi[own["point"], own["subtree"]] = own["low"], own["high"]
            ranges.append((lo, hi))
        self.ranges = spark.sparkContext.broadcast(tuple(ranges))
        self.sizes = {r["leaf"]: r["count"] for r in self.rows.groupBy("leaf").count().collect()}  # at most LEAVES

    def _packed(self, rows: DataFrame, sizes: dict[int, int], most: int, fields: list[str]) -> DataFrame:
        parts = [F.lit(v) for leaf, n in sizes.items() for v in (leaf, -(-n // most))]
        part = F.monotonically_increasing_id() % F.create_map(*parts)[F.col("leaf")] if parts else F.lit(0)
        return (rows.withColumn("part", part).groupBy("leaf", "part").agg(F.collect_list(F.struct(*fields)).alias("p"))
                .select("leaf", *[F.col("p")[f].alias(f"{f}s") for f in fields]))

    def _visits(self, asked: DataFrame, nearest: bool) -> DataFrame:
        """Anchors (one row with its windows as arrays) -> one row per anchor and leaf to visit."""
        tree, ranges, dim = self.tree, self.ranges, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 128):
                    part = batch.slice(k, 128)
                    q = _numbers(part.column("v"), dim)
                    if nearest:
                        own = tree.value.home(q)
                        who, leaf = np.repeat(np.arange(len(q)), own.shape[1]), own.ravel()
                    else:
                        lows, highs = part.column("low"), part.column("high")
                        at = np.repeat(np.arange(len(q)), lows.value_lengths().to_numpy(zero_copy_only=False))
                        meets = tree.value.meets(q[at], lows.flatten().to_numpy(zero_copy_only=False),
                                                 highs.flatten().to_numpy(zero_copy_only=False), ranges.value)
                        any_window = np.zeros((len(q), meets.shape[1]), bool)
                        np.logical_or.at(any_window, at, meets)
                        who, leaf = np.nonzero(any_window)
                    take = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf, pa.int32()), take.column("id"), take.column("label"), _rows_of(q[who]),
                         *[take.column(c) for c in ("slot", "low", "high")]], ["leaf", "id", "label", "vec", "slot", "low", "high"])

        return stored(asked.select("id", "label", "v", "slot", "low", "high").mapInArrow(
            run, "leaf int, id long, label long, vec binary, slot array<long>, low array<double>, high array<double>"), "visits")

    def _scored(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, slot, found, score): per window the k best of each task."""
        loads = {r["leaf"]: r["count"] for r in visits.groupBy("leaf").count().collect()}
        blocks = self._packed(visits, loads, BLOCK, ["id", "label", "vec", "slot", "low", "high"])
        parts = self._packed(self.rows, self.sizes, PART, ["id", "label", "vec"]).select(
            "leaf", F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"), F.col("vecs").alias("row_vecs"))
        dim = self.dim

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i] for name in batch.schema.names}
                    held.append(_windows(row, dim, same, k))
                    size += len(held[-1][0])
                    if size > HELD:
                        held = [_best(held, k)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield _result(held[0])
                            held, size = [], 0
            if held:
                yield _result(_best(held, k))

        found = blocks.join(parts, "leaf").drop("leaf").mapInArrow(score, "id long, slot long, found long, score long")
        order = F.row_number().over(Window.partitionBy("id", "slot").orderBy(F.desc("score"), "found"))
        return found.withColumn("rank", order).where(F.col("rank") <= k)

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """``asked``: (id, label, v, slot[], low[], high[]), one row per anchor with its windows.
        -> (id, slot, rank, found, score), the k best rows of each window, of the anchor's label or of others."""
        first = self._scored(self._visits(asked, True), same, k)
        floor = first.groupBy("id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        windows = asked.select("id", F.explode(F.arrays_zip("slot", "low", "high")).alias("w")).select("id", "w.*")
        raised = (windows.join(floor, ["id", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("least", F.lit(float("-inf")))))
                  .groupBy("id").agg(F.collect_list(F.struct("slot", "low", "high")).alias("w")))
        again = asked.drop("slot", "low", "high").join(raised, "id").select("id", "label", "v", "w.slot", "w.low", "w.high")
        return stored(self._scored(self._visits(again, False), same, k), "found")


def _windows(row: dict, dim: int, same: bool, k: int):
    """The k best rows of one part for each window of one block of anchors."""
    ids, labels = np.array(row["ids"].as_py()), np.array(row["labels"].as_py())
    row_ids, row_labels = np.array(row["row_ids"].as_py()), np.array(row["row_labels"].as_py())
    s = _block(row["vecs"], dim) @ _block(row["row_vecs"], dim).T  # whole numbers below 2^53: exact
    fits = (labels[:, None] == row_labels[None]) == same
    s[~fits | (ids[:, None] == row_ids[None])] = -np.inf
    by_id = np.argsort(row_ids, kind="stable")
    s, row_ids = s[:, by_id], row_ids[by_id]
    out = []
    for i, (slots, lows, highs) in enumerate(zip(row["slots"].as_py(), row["lows"].as_py(), row["highs"].as_py())):
        for slot, low, high in zip(slots, lows, highs):
            inside = (s[i] >= low) & (s[i] <= high) & (s[i] > -np.inf)
            at = np.flatnonzero(inside)
            if len(at) > k:
                bar = np.partition(s[i, at], len(at) - k)[len(at) - k]
                at = at[s[i, at] >= bar]
                at = at[np.argsort(-s[i, at], kind="stable")[:k]]  # equal scores stay in id order
            out.append((np.full(len(at), ids[i]), np.full(len(at), slot), row_ids[at], s[i, at].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _best(held: list, k: int):
    who, slot, found, score = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((found, -score, slot, who))
    who, slot, found, score = who[order], slot[order], found[order], score[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0)) if len(who) else np.zeros(0, int)
    keep = np.arange(len(who)) - start < k
    return who[keep], slot[keep], found[keep], score[keep]


def _result(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["id", "slot", "found", "score"])


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3,
         window: tuple[int, int] = (50, 95), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor
    and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of another
    label whose score lies within the window, in percent of the positive's score."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole_vector(v)).alias("v"),
                          F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = stored(rows.groupBy("id").agg(F.min(F.struct("label", "v", "asked")).alias("r")).select("id", "r.*"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = (rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("longest"))
             .orderBy(F.desc("n"), "dim").first())
    if facts is None or not facts["dim"]:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.size("v") == facts["dim"])
    index = Index(rows, facts["dim"], facts["n"], float(facts["longest"]))
    asked = rows.where("asked").drop("asked")
    ends = lambda x: F.array(F.lit(float(x)))
    near = index.search(asked.select("*", F.array(F.lit(0).cast("long")).alias("slot"), ends("-inf").alias("low"), ends("inf").alias("high")), True, positives)
    least, most = window
    # 100 score >= least * positive and 100 score <= most * positive, in whole numbers
    low, high = -F.floor(-F.col("score") * least / 100), F.floor(F.col("score") * most / 100)
    windows = near.groupBy("id").agg(F.collect_list(F.struct("found", low.cast("double").alias("low"), high.cast("double").alias("high"))).alias("w"))
    hard = index.search(asked.join(windows, "id").select("id", "label", "v", F.col("w.found").alias("slot"), "w.low", "w.high"), False, negatives)
    pairs = near.select("id", F.col("found").alias("slot"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["id", "slot"]).select(F.col("id").alias("anchor_id"), F.col("slot").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                                   F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(vectors: DataFrame) -> DataFrame:
    """The registered result: every 50th row mines, labels of every 7th are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 50 == 0, label)
