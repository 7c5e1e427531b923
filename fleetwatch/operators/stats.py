"""Statistical primitives over long tables.

Series operators expect one row per key and time step (an agent-day): such a series is
bounded by the calendar, not by traffic, so one key fits one task. Aggregate events with
``daily_cost`` or a similar ``groupBy`` first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R


_PIECE = 32


def _recurrence(values: Column, weight: float, start: Column) -> Column:
    """y[0] = start, then y[t] = weight * x[t] + (1 - weight) * y[t-1], as an array. Values
    are taken in pieces, so that appending copies a short array and seldom the long one."""
    step = lambda acc, x: F.concat(acc, F.array(x * weight + F.element_at(acc, -1) * (1.0 - weight)))

    def piece(acc: Column, i: Column) -> Column:
        run = F.aggregate(F.slice(values, i * _PIECE + 2, F.lit(_PIECE)),
                          F.array(F.element_at(acc, -1)), step)
        return F.concat(acc, F.slice(run, F.lit(2), F.lit(_PIECE)))

    last = F.call_function("div", F.size(values) - 2, F.lit(_PIECE)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), last), F.array(start), piece)


def ewma_card(series: DataFrame, keys: Sequence[str], order: str, value: str,
              min_obs: int = R.EWMA_WARMUP, calibrated: str | None = None) -> DataFrame:
    """EWMA control card. Per step: n, mu, sigma, z (null until armed), armed, alarm.

    The mean starts at the first value with variance zero; each later step moves the mean
    by alpha and the variance, taken around the moved mean, by beta. Both recurrences run
    over one array of days per key. A ``calibrated`` column keeps the card disarmed while
    false."""
    keys = list(keys)
    flag = F.col(calibrated) if calibrated else F.lit(True)
    step = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"), flag.alias("c"))
    days = series.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("_s"))
    xs = days.select("*", F.transform("_s", lambda s: s["x"]).alias("_x"))
    means = xs.select("*", _recurrence(F.col("_x"), R.EWMA_ALPHA, F.get("_x", F.lit(0))).alias("_mu"))
    gaps = means.select("*", F.zip_with("_x", "_mu", lambda x, m: (x - m) * (x - m)).alias("_d"))
    spread = gaps.select("*", _recurrence(F.col("_d"), R.EWMA_BETA, F.lit(0.0)).alias("_v"))
    rows = spread.select(*keys, F.posexplode(F.arrays_zip("_s", "_mu", "_v")).alias("_i", "_r"))
    out = rows.select(
        *keys, F.col("_r._s.o").alias(order), F.col("_r._s.x").alias(value),
        (F.col("_i") + 1).cast("bigint").alias("n"), F.col("_r._mu").alias("mu"),
        F.sqrt("_r._v").alias("sigma"), F.col("_r._s.c").alias("_c"))
    armed = (F.col("n") >= max(int(min_obs), 1)) & (F.col("sigma") > 0) & F.col("_c")
    z = F.when(armed, (F.col(value) - F.col("mu")) / F.col("sigma"))
    return out.select(
        *keys, order, value, "n", "mu", "sigma", z.alias("z"), armed.alias("armed"),
        F.coalesce(z > R.EWMA_Z_LIMIT, F.lit(False)).alias("alarm"))


def normalize_counts(counts: DataFrame, keys: Sequence[str], count: str,
                     out: str = "share") -> DataFrame:
    """Share of the key's total; null when the total is not positive."""
    total = F.sum(count).over(W.partitionBy(*keys))
    return counts.withColumn(out, F.col(count) / F.when(total > 0, total))


def _two_sided(counts: DataFrame, keys: Sequence[str], category: str, left: str,
               right: str, also: Sequence[str] = ()) -> DataFrame:
    """One row per key and category with both shares, smoothed."""
    merged = counts.groupBy(*keys, category).agg(
        F.sum(left).cast("double").alias("_l"), F.sum(right).cast("double").alias("_r"),
        *[F.sum(c).alias(c) for c in also])
    shares = normalize_counts(normalize_counts(merged, keys, "_l", "_p"), keys, "_r", "_q")
    return shares.select(*keys, (F.col("_p") + R.EPS).alias("p"), (F.col("_q") + R.EPS).alias("q"), *also)


def jsd(counts: DataFrame, keys: Sequence[str], category: str, left: str,
        right: str, also: Sequence[str] = ()) -> DataFrame:
    """Base-2 Jensen-Shannon divergence of two count columns, with its band. An empty
    side gives a null value and the band ``warming_up``. Columns in ``also`` are summed per
    key on the way."""
    pq = _two_sided(counts, keys, category, left, right, also)
    p, q = F.col("p"), F.col("q")
    m = (p + q) * 0.5
    term = p * 0.5 * F.log2(p / m) + q * 0.5 * F.log2(q / m)
    v = F.col("jsd")
    return (pq.groupBy(*keys).agg(F.sum(term).alias("jsd"), *[F.sum(c).alias(c) for c in also])
            .withColumn("jsd", F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))))
            .withColumn("band", F.when(v.isNull(), "warming_up").when(v < R.JSD_WATCH, "healthy")
                        .when(v <= R.JSD_ALARM, "watch").otherwise("alarm")))


def psi(counts: DataFrame, keys: Sequence[str], category: str, expected: str,
        actual: str) -> DataFrame:
    """Population stability index, natural log; an empty side gives null."""
    pq = _two_sided(counts, keys, category, expected, actual)
    p, q = F.col("p"), F.col("q")
    return (pq.groupBy(*keys).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
            .withColumn("large_shift", F.coalesce(F.col("psi") > R.PSI_LARGE, F.lit(False))))


def _middle(sorted_values: Column, n: Column) -> Column:
    at = lambda i: F.get(sorted_values, i.cast("int"))
    half = F.call_function("div", n, F.lit(2))
    return F.when(n % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) * 0.5)


def mad_z(series: DataFrame, keys: Sequence[str], order: str, value: str,
          x: Column | None = None) -> DataFrame:
    """Robust z of the newest value (or ``x``) of a bounded series. Fewer than three
    values, or no dispersion, give a null z and no alarm."""
    v = F.col(value).cast("double")
    g = (series.groupBy(*keys)
         .agg(F.sort_array(F.collect_list(v)).alias("_v"), F.count(v).alias("n"),
              F.max_by(v, F.col(order)).alias("_newest"))
         .withColumn("median", F.when(F.col("n") >= 3, _middle(F.col("_v"), F.col("n")))))
    dev = F.array_sort(F.transform("_v", lambda e: F.abs(e - F.col("median"))))
    g = g.withColumn("mad", F.when(F.col("n") >= 3, _middle(dev, F.col("n"))))
    return _robust_z(g.withColumn("x", x if x is not None else F.col("_newest"))
                     .drop("_v", "_newest"))


def _robust_z(df: DataFrame) -> DataFrame:
    z = F.when(F.col("mad") > 0,
               (F.col("x") - F.col("median")) * R.MAD_SCALE / F.col("mad"))
    return (df.withColumn("robust_z", z)
            .withColumn("alarm", F.coalesce(F.abs("robust_z") > R.MAD_Z_LIMIT, F.lit(False))))


# below so many rows a single column is ranked as a whole
_RANKED_WHOLE = 4000


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, ranks: Sequence[Column],
                     accuracy: int = 10_000) -> DataFrame:
    """Exact value at the given 1-based ranks (expressions over ``n``; their mean if two) per
    key of any size: (keys, n, quantile, max).

    A sketch whose rank error is bounded by 1 / ``accuracy`` brackets the quantile. One more
    pass counts, with partial sums, the rows below and above the bracket and each value inside;
    only these, about a thousandth of a key, are ordered."""
    keys = list(keys)
    v = F.col(value).cast("double")
    margin = 5 / accuracy
    p = F.percentile_approx(v, [max(0.0, q - margin), min(1.0, q + margin)], accuracy)
    span = df.groupBy(*keys).agg(p.alias("_p"), F.count(v).alias("n"), F.min(v).alias("_min"), F.max(v).alias("max"))
    low = F.col("_p")[0] if q - margin > 0 else F.col("_min")
    high = F.col("_p")[1] if q + margin < 1 else F.col("max")
    span = span.withColumn("_p", F.array(low, high))
    if not keys:  # ranks over n - 1 may lie one place beside the sketch's in a short column
        whole = F.col("n") < _RANKED_WHOLE
        span = span.withColumn("_p", F.when(whole, F.array("_min", "max")).otherwise(F.col("_p")))
        rows = df.select(v.alias("_v")).withColumn("_p", span.select("_p").scalar())
    else:
        rows = df.select(*keys, v.alias("_v")).join(span.select(*keys, "_p"), keys)
    cell = F.when(F.col("_v") < F.col("_p")[0], 0).when(F.col("_v") <= F.col("_p")[1], 1).otherwise(2)
    counted = (rows.where(F.col("_v").isNotNull()).withColumn("_cell", cell)
               .groupBy(*keys, "_cell", F.when(F.col("_cell") == 1, F.col("_v")).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell", "_v"))
    counted = counted.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    counted = counted.join(span.select(*keys, "n", "max"), keys) if keys else counted.withColumns(
        {c: span.select(c).scalar() for c in ("n", "max")})
    named = {f"_r{i}": r for i, r in enumerate(ranks)}
    hit = F.col("_cell") == 1
    at = lambda r: F.max(F.when(hit & (F.col("_from") < F.col(r)) & (F.col("_upto") >= F.col(r)), F.col("_v")))
    mean = sum((at(r) for r in named), F.lit(0.0)) / len(ranks)
    return counted.withColumns(named).groupBy(*keys).agg(
        F.max("n").alias("n"), mean.alias("quantile"), F.max("max").alias("max"))


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median per key, for keys of any size: (keys, n, median)."""
    n = F.col("n")
    ranks = [F.call_function("div", n + 1, F.lit(2)), F.call_function("div", n + 2, F.lit(2))]
    return grouped_quantile(df, keys, value, 0.5, ranks, accuracy).select(*keys, "n", F.col("quantile").alias("median"))


def grouped_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median and MAD per key of any size: (keys, n, median, mad)."""
    keys = list(keys)
    med = grouped_median(df, keys, value)
    dev = (df.join(med.select(*keys, "median"), keys)
           .select(*keys, F.abs(F.col(value).cast("double") - F.col("median")).alias("_dev")))
    mad = grouped_median(dev, keys, "_dev").select(*keys, F.col("median").alias("mad"))
    return med.join(mad, keys)


def wide_mad_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Robust z of every row against its own key, for event-grain groups of any size."""
    keys = list(keys)
    g = grouped_mad(df, keys, value)
    ready = (df.join(g, keys).withColumn("x", F.col(value).cast("double"))
             .withColumn("mad", F.when(F.col("n") >= 3, F.col("mad"))))
    return _robust_z(ready)


def cusum(series: DataFrame, keys: Sequence[str], order: str, value: str,
          mu0: Column, drift: float = R.CUSUM_DRIFT, limit: float = R.CUSUM_LIMIT) -> DataFrame:
    """C4: one-sided CUSUM. The reflected recurrence equals the running sum minus its
    running minimum (never above zero), so two window sums replace the loop."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    s = series.withColumn("_s", F.sum(F.col(value).cast("double") - mu0 - F.lit(drift)).over(w))
    g = F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))
    return s.withColumn("g", g).withColumn("alarm", F.col("g") > limit).drop("_s")


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row (n, quantile, max): the value at 0-based index round(q*(n-1)), half to even."""
    rank = (F.bround(F.lit(q) * (F.col("n") - 1), 0) + 1).cast("bigint")
    return grouped_quantile(df, [], value, q, [rank]).withColumn("n", F.coalesce("n", F.lit(0)))
