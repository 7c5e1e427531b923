"""Operator 1: SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes of the XXH64 of word 3-shingles. Links are searched
among distinct fingerprints only, so copies cost nothing.

Two fingerprints that differ in at most ``BOUND`` = 3 bits agree on one of four blocks of
bits. A *bucket* is a set of fingerprints that agree on such a masked pattern. A bucket of more
than ``BUCKET`` fingerprints is cut again into four blocks of its free bits, until none is that
large; since the fingerprints are distinct, a bucket with ``f`` free bits has at most 2^f, so
this ends whatever the data and no task ever gets more than BUCKET rows of a bucket.

Inside a bucket fingerprints stand in Gray-code order, so neighbours share many bits. Leaves of
``LEAF`` neighbours and nodes of ``FAN`` leaves keep the bits their members share, each level
only those its parent has not (mask and pattern). A query adds up the differences from node to
leaf to fingerprint and drops a whole group as soon as the sum exceeds the bound.

A bucket gives each fingerprint one link to the smallest one it is connected with inside the
bucket, not all pairs; connected components then run over these links.

Defined cases: a null or empty text and one without words has fingerprint zero, and such texts
link like any other; repeated rows keep one row each; a null id counts for no minimum, a group
without any id has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components

BOUND = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
LEAF = 16
FAN = 16
CHUNK = 1 << 15
CANDIDATES = 1 << 20


def fingerprint(text: bytes | None) -> int:
    """bytes.lower and bytes.split are exactly A-Z and the six ASCII white-space bytes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1
    span = min(SHINGLE, len(words))
    ends = (begin + sizes)[span - 1:].tolist()
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    starts = begin[:n].tolist()
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a long."""
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in (column, "text")],
                       F.col("text").cast("binary").alias("__text"))
    at = kept.columns.index("__text")
    fields = [f for f in kept.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column(at)], pa.int64())
            rest = [(c, n) for i, (c, n) in enumerate(zip(batch.columns, batch.schema.names)) if i != at]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in rest], prints], [*[n for _, n in rest], column])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField(column, T.LongType())]))


def _blocks(free: list[int]) -> list[list[int]]:
    size = -(-len(free) // (BOUND + 1))
    return [free[i:i + size] for i in range(0, len(free), size)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def buckets(prints: DataFrame) -> DataFrame:
    """(mask, pattern, fp): every pair within the bound shares a bucket, none is larger than
    BUCKET, single fingerprints are left out."""
    level = [(prints.select("fp"), list(range(64)), 0)]
    out = None
    while level:
        parts = []
        for rows, free, fixed in level:
            for block in _blocks(free):
                mask = fixed | _mask(block)
                fixed_bits = F.lit(mask).cast("long")
                parts.append((rows.select(fixed_bits.alias("mask"), F.col("fp").bitwiseAND(fixed_bits).alias("pattern"),
                                          "fp"), [b for b in free if b not in block], mask))
        every = parts[0][0]
        for rows, _, _ in parts[1:]:
            every = every.unionByName(rows)
        every = stored(every, "buckets")
        sizes = every.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1")
        fits = every.join(sizes.where(F.col("n") <= BUCKET).select("mask", "pattern"), ["mask", "pattern"], "left_semi")
        out = fits if out is None else out.unionByName(fits)
        large = sizes.where(F.col("n") > BUCKET).select("mask", "pattern")
        hot = {r["mask"] for r in large.select("mask").distinct().collect()}  # at most 4 masks per mask cut
        level = [(every.where(F.col("mask") == mask).join(large, ["mask", "pattern"], "left_semi"), free, mask)
                 for _, free, mask in parts if mask in hot]
    return out


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with start[i] <= j < stop[i]."""
    n = stop - start
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[i]


def _group(starts: np.ndarray, stops: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each range into groups of ``size``: first member, end, and how many groups each
    range has."""
    n = -(-(stops - starts) // size)
    which, k = _ranges(np.zeros(len(n), np.int64), n)
    first = starts[which] + k * size
    return first, np.minimum(first + size, stops[which]), n


def _shared(first: np.ndarray, any_bits: np.ndarray, all_bits: np.ndarray) -> np.ndarray:
    return ~(np.bitwise_or.reduceat(any_bits, first) ^ np.bitwise_and.reduceat(all_bits, first))


class GrayIndex:
    """Index over consecutive buckets of sorted keys; ``fp`` must be in (bucket, Gray) order."""

    def __init__(self, fp: np.ndarray, starts: np.ndarray) -> None:
        self.fp = fp
        stops = np.append(starts[1:], len(fp))
        self.bucket = np.repeat(np.arange(len(starts)), stops - starts)
        self.leaf, self.leaf_end, leaves = _group(starts, stops, LEAF)
        leaf_stop = np.cumsum(leaves)
        self.node, self.node_end, nodes = _group(leaf_stop - leaves, leaf_stop, FAN)
        self.node_stop = np.cumsum(nodes)
        self.node_start = self.node_stop - nodes
        ors, ands = np.bitwise_or.reduceat(fp, self.leaf), np.bitwise_and.reduceat(fp, self.leaf)
        leaf_mask = _shared(np.arange(len(ors)), ors, ands)
        self.node_mask = _shared(self.node, ors, ands)
        self.node_bits = fp[self.leaf[self.node]] & self.node_mask
        # bits of a node are factored out of its leaves, bits of a leaf out of its members
        up = np.repeat(self.node_mask, self.node_end - self.node)
        self.leaf_mask = leaf_mask & ~up
        self.leaf_bits = fp[self.leaf] & self.leaf_mask
        self.rest = ~leaf_mask

    def links(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), j > i, within the bound, for the queries at positions lo to hi."""
        own = self.bucket[lo:hi]
        i, node = _ranges(self.node_start[own], self.node_stop[own])
        i, node, diff = self._near(i + lo, node, 0, self.leaf_end[self.node_end - 1], self.node_bits, self.node_mask)
        at, leaf = _ranges(self.node[node], self.node_end[node])
        i, leaf, diff = self._near(i[at], leaf, diff[at], self.leaf_end, self.leaf_bits, self.leaf_mask)
        at, j = _ranges(self.leaf[leaf], self.leaf_end[leaf])
        i, diff, rest = i[at], diff[at], self.rest[leaf[at]]
        keep = (j > i) & (diff + np.bitwise_count((self.fp[i] ^ self.fp[j]) & rest) <= BOUND)
        return i[keep], j[keep]

    def _near(self, i, group, diff, end, bits, mask):
        """Adds a level's differences and prunes the groups that exceed the bound or hold only
        positions up to i."""
        diff = diff + np.bitwise_count((self.fp[i] ^ bits[group]) & mask[group])
        keep = (diff <= BOUND) & (end[group] > i + 1)
        return i[keep], group[keep], diff[keep]


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the trees of each pair; every tree points at its smallest position."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, pattern, Gray rank); whole buckets are handled together."""
    def handle(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
        index, root, lo = GrayIndex(fp, starts), np.arange(len(fp)), 0
        cost = np.cumsum(np.diff(np.append(starts, len(fp)))[index.bucket])
        while lo < len(fp):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CANDIDATES, "right")))
            root = _join_roots(root, *index.links(lo, hi))
            lo = hi
        at = np.flatnonzero(root != np.arange(len(fp)))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[root[at]].view(np.int64))],
                                             ["u", "v"])

    held = [np.zeros(0, np.uint64)] * 3
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy().view(np.uint64)]) for h, c in zip(held, batch.columns)]
        if len(held[0]) < 65536:
            continue
        change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(change):
            cut = change[-1] + 1
            yield from handle(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield from handle(*held)


def gray_rank(fp: Column) -> Column:
    """Position of the fingerprint in Gray-code order (prefix XOR of its bits)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links that connect exactly what links within the bound connect."""
    rows = buckets(prints)
    rank = gray_rank(F.col("fp"))
    return (rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", rank)
            .select("mask", "pattern", "fp").mapInArrow(_link_buckets, "u long, v long").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of ``docs``; ``root`` names the group,
    ``component_id`` is its smallest id, which groups may share if an id has several texts."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(fingerprints(rows, "fp"), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = stored(components(links(prints)), "components")
    member = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(member.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each group stays, that with the smallest id (of rows that
    share it, that with the smallest text hash, and of rows that share that too the least by all
    columns). Rows without id stay only where their whole group has none.

    Only ids and hashes are grouped. The rows that go are taken out by an anti-join, and full rows
    are grouped only where id and text repeat."""
    rows = classes(docs).groupBy("root", "component_id", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "group-rows")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    firsts = rows.where(own).groupBy("root").agg(F.min("text_hash").alias("first"))
    stays = own & (F.col("text_hash") == F.col("first"))
    fate = rows.join(firsts, "root").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), stays.alias("stays"), "n")
    hashed = docs.withColumn("__h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))
    changed = fate.where(~F.col("stays") | (F.col("n") > 1))
    alone = hashed.join(changed, same, "left_anti").select(docs.columns)
    whole = F.struct(*docs.columns)
    repeated = (hashed.join(fate.where(F.col("stays") & (F.col("n") > 1)), same, "left_semi").groupBy("doc_id", "__h")
                .agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__row.*"))
    return alone.unionByName(repeated)
