"""Operator 4: language identification with multinomial naive Bayes.

Character 1- to 3-grams of the lower-cased text are hashed into ``BUCKETS`` buckets. Training
counts every n-gram of every learning row (one pass, partial counts per task, summed by
bucket). The log-probability matrix has ``BUCKETS`` x languages entries, at most
``BUCKETS * MAX_LANGUAGES`` (checked), and is broadcast. Scoring gathers matrix rows for the
n-grams of a batch of texts in numpy; texts are cut into pieces of ``PIECE`` characters so that
memory does not depend on the longest text, and all pieces of a text are summed.

Defined cases: malformed UTF-8 is read as U+FFFD (and stays as it is in the rows); a null text or one without a letter is ``und`` with score 0, as is every text if
nothing was learned; equal posteriors go to the alphabetically first language; repeated rows
are counted and predicted each; rows with a null id are predicted, not learned from, and not
held out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PIECE = 1 << 17
MAX_LANGUAGES = 128
LETTER = re.compile(r"[^\W\d_]")
# odd multipliers of the rolling hash
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _texts(column: pa.Array) -> list[str | None]:
    """Texts of a column, whatever their bytes."""
    return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of pieces of about PIECE characters: row of each piece, its characters (with the
    overlap its last n-grams need) and how many n-grams start in it."""
    rows, parts, limits, size, over = [], [], [], 0, max(ORDERS) - 1
    for i, text in enumerate(texts):
        text = text.lower()
        for a in range(0, len(text), PIECE):
            rows.append(i)
            parts.append(text[a:a + PIECE + over])
            limits.append(min(PIECE, len(text) - a))
            size += limits[-1]
            if size >= PIECE:
                yield rows, parts, limits
                rows, parts, limits, size = [], [], [], 0
    if rows:
        yield rows, parts, limits


def ngram_buckets(parts: list[str], limits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that starts at each character (BUCKETS where
    none does), and where each piece begins."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths) - lengths
    room = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    owned = np.arange(len(codes)) < np.repeat(starts + np.array(limits), lengths)
    padded = np.concatenate([codes, np.zeros(max(ORDERS), np.uint32)])
    out = []
    for n in ORDERS:
        h = np.full(len(codes), n, np.uint32)
        for j in range(n):
            h = (h ^ padded[j:j + len(codes)]) * MIX[j % len(MIX)]
            h ^= h >> np.uint32(15)
        b = (h % np.uint32(BUCKETS)).astype(np.int64)
        b[(room < n) | ~owned] = BUCKETS
        out.append(b)
    return out, starts


def train(rows: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Languages and the (BUCKETS + 1) x languages matrix of log probabilities; the last row is
    the log prior. ``rows``: text, lang."""
    seen = (rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not be bounded")
    if not seen:
        return None
    langs = [r["lang"] for r in seen]
    index = {x: i for i, x in enumerate(langs)}
    width = BUCKETS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * width, np.int64)
        for batch in batches:
            which = [index[x] for x in batch.column(1).to_pylist()]
            for doc, parts, limits in _pieces(_texts(batch.column(0))):
                base = np.repeat([which[i] * width for i in doc], [len(p) for p in parts])
                for b in ngram_buckets(parts, limits)[0]:
                    total += np.bincount(base + b, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32()), pa.array(total[at])],
            ["lang", "bucket", "n"])

    counts = (rows.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).select("text", "lang")
              .mapInArrow(count, "lang int, bucket int, n long").where(F.col("bucket") < BUCKETS)
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    matrix = np.ones((width, len(langs)))
    matrix[counts["bucket"].to_numpy(int), counts["lang"].to_numpy(int)] += counts["n"].to_numpy(float)
    matrix = np.log(matrix / matrix[:BUCKETS].sum(axis=0))
    prior = np.array([r["count"] for r in seen], float)
    matrix[BUCKETS] = np.log(prior / prior.sum())
    return langs, matrix


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None,
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and posterior added under ``names`` (which replace columns of
    these names)."""
    if model is None:
        return docs.withColumn(names[0], F.lit("und")).withColumn(names[1], F.lit(0.0))
    langs, matrix = model
    table = matrix.astype(np.float32)
    prior, table[BUCKETS] = matrix[BUCKETS].copy(), 0
    shared = docs.sparkSession.sparkContext.broadcast((langs, table, prior))
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType())])
    at = kept.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, prior = shared.value
        for batch in batches:
            texts = _texts(batch.column(at))
            known = [t is not None and LETTER.search(t) is not None for t in texts]
            sums = np.tile(prior, (len(texts), 1))
            for doc, parts, limits in _pieces([t if k else "" for t, k in zip(texts, known)]):
                orders, starts = ngram_buckets(parts, limits)
                total = sum(np.add.reduceat(table[b], starts, axis=0, dtype=np.float64) for b in orders)
                np.add.at(sums, doc, total)
            best = sums.argmax(axis=1)
            post = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([langs[j] if k else "und" for j, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, post, 0.0))], [*batch.schema.names, *names])

    return kept.mapInArrow(score, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_remainder(F.col("doc_id"), 3) != 1).select("text", "lang")


def identify(docs: DataFrame) -> DataFrame:
    model = train(learning_rows(docs))
    scored = predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: rows whose language is known with at least ``least`` posterior."""
    scored = predict(docs, train(learning_rows(docs)), ("__lang", "__posterior"))
    return scored.where((F.col("__lang") != "und") & (F.col("__posterior") >= least)).select(docs.columns)
