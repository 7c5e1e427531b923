"""Operator 11: mixing sources to target weights by systematic sampling, DataFrame functions only.

* The size of a document is its number of words. All sources together keep the size of the
  corpus; each gets a share by its weight, but no more than ``MOST`` times its own size, and
  what that leaves over goes to the other sources by weight.
* A document's expected copies are target / size of its source. They are added up within the
  source, one offset drawn from the seed is added, and a document is emitted once per whole
  number that its stretch of the sum crosses: rounded down or up, never more than ``MOST`` times.
* The sum runs in the order of size classes (an eighth wide) and of digests within a class, so
  the copies are spread evenly over sizes and the words taken come within about one long
  document of the target. Expected copies are whole multiples of 1/``SCALE``: exact in any order.

Weights (whole numbers, 0 or more) go 1, 2, 3, 1, ... over the sources by code point, null last,
or as a given list repeats.

Defined cases: a null text has size 0, a null source is a source, a source without words gets
target 0 and no copies; a null id is an id; repeated rows are documents of their own, each with its
own stretch; an empty table gives an empty mix. Other columns play no part in the sums;
``mixed`` returns exactly the given columns, whatever their names. Ties in the order exist only
between equal rows, so reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordered import running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SCALE = 10 ** 12


def offset(seed: int) -> int:
    """The random offset of the sample, in units of 1/SCALE copies."""
    return int(hashlib.md5(f"mix:{seed}".encode()).hexdigest(), 16) % SCALE


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Non-decreasing in size: the number of bits, then the leading four bits."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows -> (source, source_size, target). The source that needs the least per
    weight to be full comes first; a source is full if its part of what the ones before it left
    over is more than it can take."""
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running_sums(sources.withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull()),
                          [], ["last", "source"], "one")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.select("source", "source_size", F.get(cycle, (F.col("before") % len(weights)).cast("int")).cast("long").alias("weight"),
                            (most * F.col("source_size")).alias("full"))
    weighed = weighed.withColumn("need", F.when(F.col("weight") > 0, F.col("full") / F.col("weight")).otherwise(F.lit(float("inf")))).withColumn("last", F.col("source").isNull())
    order = ["need", "last", "source"]
    taken = running_sums(weighed, [], order, "full").withColumnRenamed("before", "given").drop("whole")
    filled = running_sums(taken, [], order, "weight").withColumnRenamed("before", "passed").withColumnRenamed("whole", "weights")
    total = filled.agg(F.sum("source_size")).first()[0] or 0
    as_double = lambda c: c.cast("double")
    is_full = (F.col("weight") > 0) & (as_double(F.col("full")) * (F.col("weights") - F.col("passed"))
               <= as_double(F.lit(total) - F.col("given")) * F.col("weight"))
    filled = stored(filled.withColumn("is_full", is_full), "targets")
    rest = filled.where("NOT is_full").agg(F.sum("weight")).first()[0] or 1
    left = total - (filled.where("is_full").agg(F.sum("full")).first()[0] or 0)
    target = F.when(F.col("is_full"), as_double(F.col("full"))).otherwise(
        F.lit(float(left)) * F.col("weight") / F.lit(float(rest)))
    return filled.select("source", "source_size", target.alias("target"))


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """Rows with ``source``, ``size``, ``key`` (text that tells unequal rows apart) and any others
    -> the same with ``source_size``, ``target`` and ``copies``."""
    rows = stored(rows, "sizes")
    goal = targets(rows.select("source", "size"), weights, most).withColumnRenamed("source", "goal_of")
    units = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * SCALE)).otherwise(0)
    expected = (rows.join(goal, F.col("source").eqNullSafe(F.col("goal_of"))).drop("goal_of")
                .withColumn("class", size_class(F.col("size"))).withColumn("expected", units.cast("decimal(20,0)")))
    summed = running_sums(expected, ["source"], ["class", "key"], "expected")
    start = F.col("before") + F.lit(offset(seed)).cast("decimal(20,0)")
    crossed = lambda at: F.call_function("div", at, F.lit(SCALE).cast("decimal(20,0)"))
    copies = (crossed(start + F.col("expected")) - crossed(start)).cast("int")
    return summed.withColumn("copies", copies).drop("before", "whole", "class", "expected", "key")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0,
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan says. The sums run on sizes and
    digests; the rows are shuffled once, equal ones as one, to meet their number of copies."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keyed = whole.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.to_json("row")).cast("binary")))
    planned = plan(keyed.select(F.col("row")[source_col].alias("source"), n_words(F.col("row")[text_col]).alias("size"),
                                "key", F.col("key").alias("kept")), weights, most, seed)
    copies = planned.groupBy(F.col("kept").alias("key")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = keyed.groupBy("key").agg(F.any_value("row").alias("row"))
    many = rows.join(copies, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.select("row.*")


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The registered result: per document its size and the words the mix takes from it."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))
    return plan(rows, seed=seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
