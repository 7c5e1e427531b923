"""HMAC-signed envelopes, their rejection reasons and the accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.hashing import hmac_sha256

# groups over which the deliveries of one nonce are spread
_SPREAD = 64


def authenticity(envelopes: DataFrame, pads: DataFrame, skew_s: int = R.REPLAY_WINDOW_S) -> DataFrame:
    """``reason`` of rejection without the replay test, null when authentic. The checks
    apply in this order: key, timestamp text, skew against arrival, nonce, signature. What is
    null fails its test; an envelope without arrival time has a skew that nobody knows.
    ``pads`` has one row per configured key."""
    seconds = F.when(F.trim("ts_text").rlike(r"^[+-]?\d+$"), F.trim("ts_text").try_cast("bigint"))
    message = F.concat(F.col("ts_text").cast("binary"), F.lit(".").cast("binary"),
                       F.col("nonce").cast("binary"), F.col("body").cast("binary"))
    skew = F.abs(F.unix_micros("received_at") / 1e6 - seconds)
    signed = hmac_sha256(F.col("ipad"), F.col("opad"), message)
    reason = (F.when(F.col("ipad").isNull(), "unknown_key")
              .when(seconds.isNull(), "bad_timestamp")
              .when(~F.coalesce(skew <= skew_s, F.lit(False)), "timestamp_skew")
              .when(F.coalesce("nonce", F.lit("")) == "", "missing_nonce")
              .when(~F.coalesce(signed == F.col("signature"), F.lit(False)), "bad_signature"))
    return (envelopes.join(F.broadcast(pads), "key_id", "left")
            .withColumn("reason", reason).drop("ipad", "opad"))


def verify(envelopes: DataFrame, pads: DataFrame, skew_s: int = R.REPLAY_WINDOW_S) -> DataFrame:
    """Every envelope with its ``reason``; of authentic ones with the same key and nonce
    only the first to arrive is accepted, also when a delivery is repeated under the same id."""
    return first_arrivals(authenticity(envelopes, pads, skew_s))


def first_arrivals(checked: DataFrame) -> DataFrame:
    """The replay test of ``verify`` over what ``authenticity`` gave; it needs no bodies.

    The first arrival is found in two steps, so that a flood of one nonce is spread over
    ``_SPREAD`` groups: the first of each group, then the first of those. Everything that lost the first
    step, and every rejected envelope, is in no common group any more."""
    lost = F.when(F.col("reason").isNotNull(), F.col("envelope_id"))
    checked = checked.withColumn("_lost", lost).withColumn(
        "_salt", F.monotonically_increasing_id() % _SPREAD)
    arrival = lambda *by: F.row_number().over(W.partitionBy("key_id", "nonce", "_lost", *by).orderBy("received_at", "envelope_id"))
    return (checked.withColumn("_nth", arrival("_salt"))
            .withColumn("_nth", F.when(F.col("_nth") > 1, F.col("_nth")).otherwise(arrival(F.when(F.col("_nth") > 1, F.col("_salt")))))
            .withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_nth") > 1), "replay")
                        .otherwise(F.col("reason"))).drop("_nth", "_salt", "_lost"))


def accepted(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("reason").isNull())


def accounting(verified: DataFrame) -> DataFrame:
    """Envelopes by outcome."""
    outcome: Column = F.coalesce(F.concat(F.lit("reject:"), F.col("reason")), F.lit("accepted"))
    return verified.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
