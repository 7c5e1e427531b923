"""Operator 8: quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described by character
class and punctuation shares, word repetition and its words hashed into ``BUCKETS`` columns, encoded by a learned layer, weighted by gated
attention (tanh times sigmoid) within its document, and the weighted sum is scored by a logistic
unit. All parts are learned together from document labels by gradient descent.

The model is fitted on a sample of at most about ``LEARN`` labelled documents per label (by hash of the
id, weighted back to the label shares of all learning rows), with every passage of each. Features
of the sample are computed by Spark; only they go to the driver. Scoring covers every passage of
every text.

Defined cases: a null or empty text is one passage of zero features; labels other than 0 and 1
and null labels are not learned from; several labels of one id are samples of their own;
without labels of both kinds every score is the share of label 1 (0.5 without any); a null id
is scored and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

PASSAGE = 96
LEARN = 2000
HIDDEN, ATTEND = 16, 8
ROUNDS, STEP = 250, 0.02
THRESHOLD = 0.7
ROWS = 256
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
WIDTH = 8 + len(PUNCTUATION)
BUCKETS = 64


def passages(text: bytes | None) -> list[list[bytes]]:
    words = text.split() if text else []
    cut = [words[i:i + PASSAGE] for i in range(0, len(words), PASSAGE)]
    if len(cut) > 1 and len(cut[-1]) < PASSAGE // 3:  # a short rest belongs to the passage before it
        cut[-2:] = [cut[-2] + cut[-1]]
    return cut or [[]]


def describe(words: list[bytes]) -> list[float] | np.ndarray:
    out = np.zeros(WIDTH)
    if not words:
        return out
    n = len(words)
    raw = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
    size = raw.sum()
    sizes = [len(w) for w in words]
    out[:8] = (1.0, raw[65:91].sum() / size, raw[48:58].sum() / size, raw[128:].sum() / size, len(set(words)) / n,
               sum(map(eq, words, words[1:])) / n, size / n / 10, max(sizes) / 50)
    out[8:] = raw[PUNCTUATION] / size
    return out


def encode(words: list[bytes]) -> np.ndarray:
    """What the attention layer sees of a passage: its description and the square roots of the
    shares of its lower-cased words by bucket."""
    out = np.zeros(WIDTH + BUCKETS)
    out[:WIDTH] = describe(words)
    if words:
        marks = np.fromiter(map(crc32, b" ".join(words).lower().split(b" ")), np.uint32, len(words))
        out[WIDTH:] = np.sqrt(np.bincount(marks % BUCKETS, minlength=BUCKETS) / len(words))
    return out


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, y, x): the passages of the sample, row-wise in one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [np.concatenate([encode(w) for w in passages(t.as_py())]).astype(np.float32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "y", "x"])
    return docs.mapInArrow(run, "doc_id long, y int, x binary")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(m: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Scores of bags whose passages stand in consecutive rows of ``x``."""
    h = np.tanh((x - m["mean"]) / m["std"] @ m["W"] + m["b"])
    a, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (a * g) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(h * weight[:, None], starts, axis=0)
    return _sigmoid(z @ m["c"] + m["c0"]), (h, a, g, weight, z)


def fit(bags: list[np.ndarray], y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
    """Full-batch Adam on the weighted cross entropy."""
    rng = np.random.default_rng(5)
    x = np.concatenate(bags).astype(float)
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    std = x.std(axis=0)
    m = {"mean": x.mean(axis=0), "std": np.where(std > 1e-9, std, 1.0)}
    shapes = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTEND), "U": (HIDDEN, ATTEND), "w": (ATTEND,),
              "c": (HIDDEN,), "c0": (1,)}
    for k, s in shapes.items():
        m[k] = rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b", "c0") else np.zeros(s)
    inputs = (x - m["mean"]) / m["std"]
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for t in range(1, ROUNDS + 1):
        p, (h, a, g, weight, z) = forward(m, x, starts, sizes)
        dl = (p - y) * importance / importance.sum()
        dz = dl[:, None] * m["c"]
        dw = (dz[bag] * h).sum(axis=1)
        de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, starts), sizes))
        da, dg = de[:, None] * m["w"] * g * (1 - a * a), de[:, None] * m["w"] * a * g * (1 - g)
        dh = (weight[:, None] * dz[bag] + da @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
        grad = {"W": inputs.T @ dh, "b": dh.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de,
                "c": z.T @ dl, "c0": dl.sum(keepdims=True)}
        for k, d in grad.items():
            d = d + 1e-5 * m[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            m[k] = m[k] - STEP * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | float:
    """A model from rows (doc_id, text) and (doc_id, quality); only the share of label 1 if
    there are not labels of both kinds."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("y")).distinct()
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(count) < 2:
        return float(next(iter(count), 0.5))
    total = F.create_map(*[F.lit(v) for pair in count.items() for v in pair])[F.col("y")]
    sample = marks.where(F.pmod(F.xxhash64("doc_id"), total) < LEARN)  # about LEARN ids per label, whatever the input
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("text"))
    got = _features(rows).toPandas().sort_values(["doc_id", "y"])
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return count[1] / sum(count.values())
    importance = np.array([count[k] / (y == k).sum() for k in (0, 1)])[y]
    return fit([np.frombuffer(b, np.float32).reshape(-1, WIDTH + BUCKETS) for b in got["x"]], y, importance)


def score(docs: DataFrame, model: dict[str, np.ndarray] | float) -> DataFrame:
    """(doc_id, score) of every text."""
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                bags = [[encode(w) for w in passages(t.as_py())] for t in part.column(1)]
                sizes = np.array([len(b) for b in bags])
                p, _ = forward(m, np.array([x for b in bags for x in b]), np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.select("doc_id", "text"), labels.where(id_remainder(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
