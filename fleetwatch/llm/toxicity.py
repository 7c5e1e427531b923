"""Operator 9: toxicity by a chain of linear classifiers.

Words (lower-cased runs of letters and digits) and the first ``STEM`` bytes of longer words are
hashed into ``BUCKETS`` columns, so that unseen forms of a word share its stem's weight; a text is
the vector of the square roots of their shares, so its length matters little, beside a few
shares of character classes and repetition. The categories form a chain: each has a logistic
model over these and the log odds of all earlier categories. While
learning, those come from models that have not seen the document (``FOLDS`` folds, by a hash of the
text, so copies of a document are unseen together); while
scoring, from the models before it in the chain.

The label table names one toxicity category and whether a text is junk; the registered chain is
``poor`` (quality 0), then ``toxic``. The operator takes any list of 0/1 columns.

The chain is fitted on a sample of at most about ``LEARN`` documents per combination of labels (by
hash of the id, weighted back to the shares of all labelled rows). Its features come from
Spark tasks, columns of fewer than ``LEAST_DOCS`` of its documents (a twentieth of a small sample)
get no weight; each model has BUCKETS weights and is broadcast. Scoring covers whole texts.

Defined cases: a null or empty text has no words and gets the score of the constant; null labels
and values other than 0 and 1 are not learned from; several labels of one id are samples of their
own; a category with one label value only scores that value; without labels all scores are 0;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import words
from .quality import WIDTH, describe

BUCKETS = 1 << 18
STEM = 4
LEAST_DOCS = 10
LEARN = 2500
FOLDS = 4
ROUNDS, STEP, RIDGE = 150, 0.5, 1e-5
THRESHOLD = 0.3
ROWS = 512


def word_shares(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and square roots of the shares of words and stems."""
    own = words(text)
    marks = own + [b"^" + w[:STEM] for w in own if len(w) > STEM]
    columns, counts = np.unique(np.fromiter(map(crc32, marks), np.uint32, len(marks)) % BUCKETS, return_counts=True)
    return columns.astype(np.int32), np.sqrt(counts / max(1, len(own)))


class Rows:
    """Sparse rows with dense extra columns."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = np.array([len(c) for c, _ in rows], np.int64)
        self.columns = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], len(self.sizes))

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[self.row], width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Rows, extra: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the words and of the dense columns (the last is the constant), by Adam."""
    dense = np.concatenate([extra, np.ones((len(y), 1))], axis=1)
    share = float((y * importance).sum() / importance.sum())
    w, v = np.zeros(BUCKETS), np.zeros(dense.shape[1])
    if share in (0.0, 1.0):
        v[-1] = 30.0 if share else -30.0
        return w, v
    v[-1] = np.log(share / (1 - share))
    used, columns = np.unique(rows.columns, return_inverse=True)
    small = Rows([])
    small.sizes, small.columns, small.values, small.row = rows.sizes, columns, rows.values, rows.row
    u, state = np.zeros(len(used)), [np.zeros(len(used) + len(v)), np.zeros(len(used) + len(v))]
    for t in range(1, ROUNDS + 1):
        r = (_sigmoid(small.dot(u) + dense @ v) - y) * importance / importance.sum()
        d = np.concatenate([small.back(r, len(used)) + RIDGE * u, dense.T @ r])
        state[0] = 0.9 * state[0] + 0.1 * d
        state[1] = 0.999 * state[1] + 0.001 * d * d
        move = STEP * (state[0] / (1 - 0.9 ** t)) / (np.sqrt(state[1] / (1 - 0.999 ** t)) + 1e-9)
        u, v = u - move[:len(used)], v - 0.1 * move[len(used):]
    w[used] = u
    return w, v


def _log_odds(rows: Rows, extra: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w, v = model
    return np.clip(rows.dot(w) + extra @ v[:-1] + v[-1], -30, 30)


def _scaled(style: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (style - scale[0]) / scale[1] / np.sqrt(WIDTH)


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], style: np.ndarray, y: np.ndarray, importance: np.ndarray,
              fold: np.ndarray):
    """Scale of the style columns and one model per column of ``y``; the earlier categories'
    log odds are out of ``fold``."""
    std = style.std(axis=0)
    scale = style.mean(axis=0), np.where(std > 1e-9, std, 1.0)
    extra, models = _scaled(style, scale), []
    every = Rows(rows)
    for k in range(y.shape[1]):
        models.append(fit_linear(every, extra, y[:, k], importance))
        if k + 1 == y.shape[1]:
            break
        unseen = np.zeros(len(rows))
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                part = fit_linear(Rows([rows[i] for i in inside]), extra[inside], y[inside, k], importance[inside])
                unseen[outside] = _log_odds(Rows([rows[i] for i in outside]), extra[outside], part)
        extra = np.concatenate([extra, unseen[:, None]], axis=1)
    return scale, models


def run_chain(chain, rows: list[tuple[np.ndarray, np.ndarray]], style: np.ndarray) -> np.ndarray:
    scale, models = chain
    every, extra = Rows(rows), _scaled(style, scale)
    for model in models:
        extra = np.concatenate([extra, _log_odds(every, extra, model)[:, None]], axis=1)
    return _sigmoid(extra[:, WIDTH:])


def _style(text: bytes | None) -> np.ndarray:
    return describe(text.split() if text else [])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]):
    """The chain from (doc_id, text) and the label columns of ``categories``; None without
    labels."""
    names = list(categories)
    marks = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()])
    for n in names:
        marks = marks.where(F.col(n).isin(0, 1))
    marks = marks.where(F.col("doc_id").isNotNull()).distinct().withColumn("__kind", F.concat(*[F.col(n).cast("string") for n in names]))
    count = {r["__kind"]: r["count"] for r in marks.groupBy("__kind").count().collect()}
    if not count:
        return None
    total = F.create_map(*[F.lit(v) for pair in count.items() for v in pair])[F.col("__kind")]
    sample = marks.where(F.pmod(F.xxhash64("doc_id"), total) < LEARN)  # about LEARN ids per kind, whatever the input
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "__kind", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            got = [word_shares(t) for t in texts]
            blobs = ([c.tobytes() for c, _ in got], [v.astype(np.float32).tobytes() for _, v in got],
                     [_style(t).tobytes() for t in texts])
            folds = [crc32(t or b"") % FOLDS for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(b, pa.binary()) for b in blobs], pa.array(folds, pa.int32())],
                                             ["doc_id", "kind", "c", "v", "style", "fold"])

    got = rows.mapInArrow(run, "doc_id long, kind string, c binary, v binary, style binary, fold int").toPandas().sort_values(["doc_id", "kind"])
    if got.empty:
        return None
    kinds = got["kind"].to_numpy()
    y = np.array([[int(b) for b in k] for k in kinds], float)
    importance = np.array([count[k] for k in kinds]) / np.array([(kinds == k).sum() for k in kinds])
    pairs = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32).astype(float)) for c, v in zip(got["c"], got["v"])]
    common = np.bincount(np.concatenate([c for c, _ in pairs]), minlength=BUCKETS) >= min(LEAST_DOCS, len(pairs) // 20 + 1)
    style = np.array([np.frombuffer(b, float) for b in got["style"]])
    return fit_chain([(c[common[c]], v[common[c]]) for c, v in pairs], style, y, importance, got["fold"].to_numpy())


def score(docs: DataFrame, models, names: list[str]) -> DataFrame:
    """doc_id and a score per category for every text."""
    columns = [f"{n}_score" for n in names]
    if models is None:
        return docs.select("doc_id", *[F.lit(0.0).alias(c) for c in columns])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = [t.as_py() for t in part.column(1)]
                p = run_chain(models, [word_shares(t) for t in texts], np.array([_style(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, j]) for j in range(len(columns))]], ["doc_id", *columns])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, ", ".join(["doc_id long", *[f"{c} double" for c in columns]]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")}
    out = score(docs, train(docs.select("doc_id", "text"), labels, chain), list(chain))
    return out.withColumns({n: F.col(f"{n}_score") >= THRESHOLD for n in chain})
