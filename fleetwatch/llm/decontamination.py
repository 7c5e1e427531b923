"""Operator 2: benchmark decontamination over a distributed positional inverted index.

``build_index`` writes one row per segment of about ``SEGMENT`` words: the term list and, for
every term of the segment, its gap-coded positions. A document lies whole in one segment and
documents are one position apart, so no match runs over a document's end. Segments are dealt
by documents, not by terms: a frequent term is a list in every segment and never one group.

``phrase_matches`` searches all segments in one pass for up to ``BLOCK`` distinct windows (what is
sent to the executors, word numbers and the vocabulary, is bounded by that; a larger query set takes a
pass per block): in a segment the offset-adjusted lists of a window's terms are intersected from
the rarest term on. It names windows by number; which items hold a window is joined to the few
matches afterwards, so a window that a third of the items share is one number. ``proximity_matches``
finds the places where all terms of a query lie within ``slop`` positions, again around the
rarest term.

Defined cases: a null text has no words; an item without words has no window, one of fewer
than ``window`` words is one window; item ids may be of any type and count as strings; repeated items,
documents and windows count once per item and document row; an empty index or query set gives no match and
documents of zero words stay in the report; null ids are kept as null, and all items without
id count as one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from .common import sha256_hex, stored

WINDOW = 13
SEGMENT = 400_000
BLOCK = 200_000
# delimiters become spaces, A-Z become a-z, all other bytes stay
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
             for b in range(256))
INDEX_SCHEMA = ("segment long, doc_ids array<long>, text_hashes array<long>, doc_starts binary, n_words binary,"
                " terms binary, term_starts binary, gaps binary")
MATCH_SCHEMA = "segment long, ord int, matches array<struct<query: long, start: int, stop: int>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class _Segment:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.hashes: list[int | None] = []
        self.terms: dict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text_hash: int | None, text: bytes | None) -> None:
        own = words(text)
        self.ids.append(doc_id)
        self.hashes.append(text_hash)
        self.parts.append(np.fromiter(map(self.terms.__getitem__, own), np.int32, len(own)))
        self.size += len(own)

    def row(self, number: int) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in self.parts], np.int32)
        starts = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
        terms = np.concatenate(self.parts)
        positions = np.arange(len(terms), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(self.terms))
        begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        gaps = np.diff(positions[order], prepend=np.int32(0))
        gaps[begin[:-1]] = positions[order][begin[:-1]]
        columns = [pa.array([number]), pa.array([self.ids], pa.list_(pa.int64())),
                   pa.array([self.hashes], pa.list_(pa.int64()))]
        blobs = (starts.tobytes(), lengths.tobytes(), b" ".join(self.terms), begin.tobytes(),
                 gaps.astype(np.int32).tobytes())
        names = ["segment", "doc_ids", "text_hashes", "doc_starts", "n_words", "terms", "term_starts", "gaps"]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([b], pa.binary()) for b in blobs]], names)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, number, seg = TaskContext.get().partitionId() << 32, 0, _Segment()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            seg.add(*row)
            if seg.size >= SEGMENT or len(seg.ids) >= SEGMENT // 8:
                yield seg.row(base + number)
                number, seg = number + 1, _Segment()
    if seg.ids:
        yield seg.row(base + number)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores the index of ``docs`` (doc_id, text) and returns it."""
    path = path or work_dir(docs.sparkSession, "postings")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(_segments, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = words(text)
                for phrase in {b" ".join(own[k:k + length]) for k in range(max(1, len(own) - length + 1))} if own else ():
                    rows.append(i)
                    out.append(phrase)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())],
                                             ["item_id", "phrase"])
    return run


def item_windows(items: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(query, phrase) of each distinct window, and (query, item_id) for the items that hold it."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    pairs = stored(rows.mapInArrow(_windows(length), "item_id string, phrase binary").distinct(), "item-windows")
    # a number is given once, when the table is written
    windows = stored(pairs.select("phrase").distinct().select(F.monotonically_increasing_id().alias("query"), "phrase"), "windows")
    return windows, pairs.join(windows, "phrase").select("query", "item_id")


class _Postings:
    """One segment, its lists decoded when asked for."""

    def __init__(self, terms: bytes, starts: bytes, gaps: bytes, wanted: dict[bytes, int]) -> None:
        self.begin, self.gaps = np.frombuffer(starts, np.int32), np.frombuffer(gaps, np.int32)
        self.local = np.full(len(wanted) + 1, -1, np.int64)
        for i, t in enumerate(terms.split(b" ")):
            if (w := wanted.get(t)) is not None:
                self.local[w] = i
        counts = np.diff(self.begin)
        self.counts = np.where(self.local >= 0, counts[self.local] if len(counts) else 0, 0)
        self.lists: dict[int, np.ndarray] = {}

    def at(self, term: int) -> np.ndarray:
        if term not in self.lists:
            i = self.local[term]
            self.lists[term] = np.cumsum(self.gaps[self.begin[i]:self.begin[i + 1]], dtype=np.int64)
        return self.lists[term]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions, by intersecting the offset-adjusted lists from the rarest on."""
        order = np.argsort(self.counts[terms], kind="stable")
        found = self.at(terms[order[0]]) - order[0]
        for k in order[1:]:
            other = self.at(terms[k])
            near = np.searchsorted(other, found + k)
            found = found[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] == found + k)]
            if not len(found):
                break
        return found

    def near(self, terms: list[int], slop: int) -> list[tuple[int, int]]:
        """Smallest spans (start, stop) of at most ``slop`` words that hold all terms."""
        anchor = self.at(min(terms, key=lambda t: self.counts[t]))
        at, label = [], []
        for k, t in enumerate(terms):
            p = self.at(t)
            i = np.searchsorted(anchor, p)
            gap = np.minimum(np.abs(anchor[np.minimum(i, len(anchor) - 1)] - p), np.abs(anchor[np.maximum(i - 1, 0)] - p))
            p = p[gap < slop]
            at.append(p)
            label.append(np.full(len(p), k))
        at, label = np.concatenate(at), np.concatenate(label)
        order = np.argsort(at, kind="stable")
        last, out = [-1] * len(terms), []
        for p, k in zip(at[order].tolist(), label[order].tolist()):
            last[k] = p
            if min(last) >= 0 and p - min(last) < slop:
                if out and out[-1][0] == min(last):
                    continue
                out.append((min(last), p + 1))
        return out


def _grouped_matches(segment: int, doc_starts: np.ndarray, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Matches per document, the overlapping ones of a query merged into runs."""
    per: dict[int, list[dict]] = defaultdict(list)
    for query, start, stop in sorted(found):
        k = int(np.searchsorted(doc_starts, start, "right")) - 1
        runs, a, b = per[k], start - int(doc_starts[k]), stop - int(doc_starts[k])
        if runs and runs[-1]["query"] == query and a <= runs[-1]["stop"]:
            runs[-1]["stop"] = max(b, runs[-1]["stop"])
        else:
            runs.append({"query": query, "start": a, "stop": b})
    kind = pa.list_(pa.struct([("query", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([segment] * len(per), pa.int64()), pa.array(list(per), pa.int32()), pa.array(list(per.values()), kind)],
        ["segment", "ord", "matches"])


def _searched(index: DataFrame, search) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment, starts, *lists = (c[i].as_py() for c in batch.columns)
                yield _grouped_matches(segment, np.frombuffer(starts, np.int32), search(lists))

    return index.select("segment", "doc_starts", "terms", "term_starts", "gaps").mapInArrow(run, MATCH_SCHEMA)


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(segment, ord, matches): the places of all phrases of ``windows`` (query, phrase)."""
    spark = index.sparkSession
    blocks = max(1, -(-windows.count() // BLOCK))
    out = None
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).toPandas()
        vocabulary: dict[bytes, int] = {}
        terms = [[vocabulary.setdefault(w, len(vocabulary)) for w in bytes(p).split(b" ")] for p in rows["phrase"]]
        sizes = np.array([len(t) for t in terms], np.int64)
        flat = np.fromiter((w for t in terms for w in t), np.int32, int(sizes.sum()))
        shared = spark.sparkContext.broadcast((vocabulary, flat, np.cumsum(sizes) - sizes, sizes, rows["query"].to_numpy(np.int64)))

        def search(lists, shared=shared):
            vocabulary, flat, starts, sizes, queries = shared.value
            seg, found = _Postings(*lists, vocabulary), []
            if not len(sizes):
                return found
            absent = np.add.reduceat((seg.local[flat] < 0).astype(np.int32), starts)
            for j in np.flatnonzero(absent == 0).tolist():
                n = int(sizes[j])
                found += [(int(queries[j]), at, at + n) for at in seg.phrase(flat[starts[j]:starts[j] + n]).tolist()]
            return found

        part = _searched(index, search)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy("segment", "ord").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    return out


def proximity_matches(index: DataFrame, queries: dict[int, list[str]], slop: int) -> DataFrame:
    """Places where all terms of a query lie within ``slop`` words, in any order. The query set
    is the caller's list, at most BLOCK queries."""
    if len(queries) > BLOCK:
        raise ValueError(f"ask at most {BLOCK} queries at a time")
    vocabulary: dict[bytes, int] = {}
    wanted = {q: list(dict.fromkeys(vocabulary.setdefault(w, len(vocabulary))
                                    for t in terms for w in words(t.encode()))) for q, terms in queries.items()}

    def search(lists):
        seg = _Postings(*lists, vocabulary)
        return [(q, a, b) for q, terms in wanted.items() if terms and all(seg.local[t] >= 0 for t in terms)
                for a, b in seg.near(terms, slop)]

    return _searched(index, search)


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, ord, doc_id, text_hash, n_words) of every indexed document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, ids, hashes, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()),
                     pa.array(hashes, pa.int64()), pa.array(np.frombuffer(sizes, np.int32).astype(np.int64))],
                    ["segment", "ord", "doc_id", "text_hash", "n_words"])

    return index.select("segment", "doc_ids", "text_hashes", "n_words").mapInArrow(
        run, "segment long, ord int, doc_id long, text_hash long, n_words long")


def covered(matches: str) -> Column:
    """Words inside the union of the matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), m["stop"].alias("b"))))
    grown = F.aggregate(
        spans, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["b"]).alias("upto"),
                              (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["upto"], x["a"]))).alias("n")))
    return grown["n"]


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, text_hash,
    item_ids (strings)."""
    index = build_index(docs)
    windows, holders = item_windows(items)
    found = stored(phrase_matches(index, windows), "matches")
    named = (found.select("segment", "ord", F.explode(F.array_distinct(F.transform("matches", lambda m: m["query"]))).alias("query"))
             .join(holders, "query").select("segment", "ord", "item_id").distinct()
             # structs, since collect_list would drop a null id
             .groupBy("segment", "ord").agg(F.sort_array(F.collect_list(F.struct("item_id"))).alias("named")))
    rows = documents_of(index).join(found, ["segment", "ord"], "left").join(named, ["segment", "ord"], "left")
    ids = F.coalesce(F.transform("named", lambda i: i["item_id"]), F.array().cast("array<string>"))
    rows = rows.withColumn("n_hit", F.coalesce(covered("matches"), F.lit(0).cast("long"))).withColumn("item_ids", ids)
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       sha256_hex(F.array_join("item_ids", ",")).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                       "text_hash", "item_ids")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that are not contaminated."""
    bad = (report(docs, items).where("contaminated")
           .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    rows = docs.withColumn("__h", F.xxhash64("text"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("__h") == F.col("bad_hash")),
                     "left_anti").select(docs.columns)
