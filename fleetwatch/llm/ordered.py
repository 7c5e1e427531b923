"""Running sums along an order, for groups that may hold any share of the rows.

The rows are dealt out by ranges of (group, order), so a large group becomes many parts; every
part is summed on its own and the totals of the parts before it in the group are added. That
table of totals has at most one row per part and group. Equal rows are interchangeable: a random
column spreads them over parts without any effect on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """Adds ``before`` (the sum of ``amount`` over the rows before this one in its group) and
    ``whole`` (the sum over the group). Null groups are a group; nulls come first in the order."""
    keys = [*group, "part_"]
    dealt = stored(rows.withColumn("salt_", F.rand(7)).repartitionByRange(*group, *order, "salt_")
                   .withColumn("part_", F.spark_partition_id()), "ranges")
    local = W.partitionBy(*keys).orderBy(*order, "salt_").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(group or [F.lit(0)]))
    parts = (dealt.groupBy(*keys).agg(F.sum(amount).alias("sum_"))
             .withColumn("earlier_", F.sum("sum_").over(whole.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)))
             .withColumn("whole", F.sum("sum_").over(whole))
             .select(*[F.col(c).alias(f"r_{c}") for c in keys], "earlier_", "whole"))
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys]
    zero = F.lit(0)
    return (dealt.withColumn("here_", F.coalesce(F.sum(amount).over(local), zero)).join(parts, same)
            .withColumn("before", F.col("here_") + F.coalesce("earlier_", zero))
            .drop("salt_", "here_", "earlier_", "part_", *[f"r_{c}" for c in keys]))
