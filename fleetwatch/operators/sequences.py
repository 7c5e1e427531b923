"""Ordered work on groups that may hold a third of all rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. Here a
key is cut into buckets that follow the order (an hour of time, a range of sequence
numbers); each bucket is ordered on its own and a small per-bucket summary carries what
the next bucket needs. The bucket must be a non-decreasing function of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_bucket(ts: str, seconds: int) -> Column:
    return F.call_function("div", F.unix_seconds(F.col(ts)), F.lit(seconds))


def range_bucket(col: str, width: int) -> Column:
    return F.call_function("div", F.col(col), F.lit(width))


def _bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    """Rows without a bucket get one before all others, as nulls are ordered."""
    return df.withColumn("_bucket", F.coalesce(bucket, F.lit(-(1 << 63))))


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on the keys and the bucket in which null keys also meet. Without keys the rows, which lie by
    bucket, stay where they are."""
    cols = [*keys, "_bucket"]
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                           *[c for c in right.columns if c not in cols])
    cond = [*[F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], F.col("_bucket") == F.col("_r__bucket")]
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


def running_offsets(summary: DataFrame, keys: Sequence[str], bucket: str, count: str,
                    out: str) -> DataFrame:
    """Rows in earlier buckets of the same key. The summary has one row per bucket, so even
    without a key it is some million times smaller than the rows."""
    before = (W.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket)
              .rowsBetween(W.unboundedPreceding, -1))
    return summary.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0)))


def rank_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
              out: str = "rank") -> DataFrame:
    """1-based row numbers per key in ``order``, without sorting a key in one task."""
    keyed = _bucketed(df, bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = running_offsets(counts, keys, "_bucket", "_rows", "_before").drop("_rows")
    local = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return (_same_key(keyed.withColumn("_local", local), offsets, keys, "inner")
            .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
            .drop("_bucket", "_local", "_before"))


def previous_values(df: DataFrame, keys: Sequence[str], bucket: Column,
                    order: Sequence[str], value: str, n: int = 1) -> DataFrame:
    """Adds ``prev_1 .. prev_n``: the values of the n rows before each row of its key.

    Values inside a bucket come from ``lag``. For the first n rows of a bucket they come
    from the last n values of the buckets before it; a bucket is never empty, so n
    earlier buckets are enough."""
    keyed = _bucketed(df, bucket)
    w = W.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = (keyed.withColumn("_local", F.row_number().over(w))
            .select("*", *[F.lag(F.struct(value), i).over(w).alias(f"_lag_{i}")
                           for i in range(1, n + 1)],
                    F.lead(F.lit(1), n).over(w).alias("_more")))
    if n == 1:
        newest = F.max_by(F.struct(value), F.struct(*order))
        tails = keyed.groupBy(*keys, "_bucket").agg(F.array(newest).alias("_tail"))
    else:
        last = F.sort_array(F.collect_list(F.struct("_local", value)), asc=False)
        tails = (rows.where(F.col("_more").isNull()).groupBy(*keys, "_bucket")
                 .agg(F.transform(last, lambda s: F.struct(s[value].alias(value))).alias("_tail")))
    carried = _carry(tails, keys, n)
    joined = _same_key(rows.drop("_more"), carried, keys, "left")
    for i in range(1, n + 1):
        # the i-th previous row lies (i - local) rows into the carried tail
        from_tail = F.get(F.col("_carried"), F.lit(i) - F.col("_local"))[value]
        joined = joined.withColumn(
            f"prev_{i}", F.when(F.col("_local") > i, F.col(f"_lag_{i}")[value])
            .otherwise(from_tail))
    return joined.drop("_bucket", "_local", "_carried", *[f"_lag_{i}" for i in range(1, n + 1)])


def _carry(tails: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Per bucket, up to n newest values of the earlier buckets, newest first."""
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    parts = [F.coalesce(F.lag("_tail", i).over(w), F.array()) for i in range(1, n + 1)]
    return tails.select(*keys, "_bucket", F.slice(F.concat(*parts), 1, n).alias("_carried"))
